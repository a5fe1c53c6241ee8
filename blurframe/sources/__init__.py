"""Readers and writers: text datasets, hierarchy files, domains, and frames of any Spark source."""
