"""Bindings of tables to trial schemas, wide ingest, sinks and fitted-parameter tables."""
