"""fpengine: device-fingerprint analytics expressed as Spark DataFrame operators.

Sub-packages:
  sources    scans and sinks (nested JSON pages, CSV, partitioned parquet)
  functions  column-level helpers (scalar string/JSON functions, vector math)
  operators  DataFrame -> DataFrame operators (flatten, joins, windows, aggregates,
             graph, kNN, clustering, features, drift, metrics)
  plans      composed retrieval/decision pipelines and the registry of queries
             run against the driver's tables
  streaming  incremental (resumable) variants on Structured Streaming
"""

__version__ = "0.1.0"
