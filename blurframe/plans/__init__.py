"""Whole plans: the anonymization pipelines, the fixture over the star schema, and the registered queries."""
