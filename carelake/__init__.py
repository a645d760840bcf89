"""carelake: Spark-native analytics over FHIR-shaped healthcare records.

Layers:
  sources/    bronze ingest (NDJSON, CSV), sinks, and the driver-table fixtures
  functions/  column expressions (reference ids, timestamps, names, flags)
  plans/      silver parsing and the gold reports (``build(sources) -> dict``)
  operators/  reusable relational operators (dedup, segmented lag, interval
              semi-join, data-quality rules, validation, profiling, CDC)
  streaming/  Structured Streaming ingest
  oracle/     DuckDB SQL twins of the registered queries
"""

__version__ = "0.1.0"
