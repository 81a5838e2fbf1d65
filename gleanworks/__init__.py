"""Gleanworks: ingesting, profiling, decoding and scoring of record deliveries as Spark DataFrame programs."""
