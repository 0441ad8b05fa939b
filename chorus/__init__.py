"""chorus: comment analytics as Spark DataFrame jobs.

Sub-packages:
  functions  column expressions (text cleaning, link parsing, label maps, ...)
  sources    adapters over the driver tables, CSV / JSON / Parquet ingest and sinks
  operators  per-video questions, dataset profiling, statistics, evaluation, models
  streaming  Structured Streaming ingest and running counts
  plans      the registry of named queries and their SQL oracles
"""

__version__ = "0.1.0"
