"""Anomaly surveys over sky catalogs and event tables, as Spark jobs."""
