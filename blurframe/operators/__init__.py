"""Relational and set-valued operators on encoded tables."""
