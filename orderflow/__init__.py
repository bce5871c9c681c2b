"""orderflow: order-queue data operators written as Spark DataFrame plans.

Sub-packages:
  functions  - Column expressions (no UDFs)
  sources    - readers, ingest, sinks
  operators  - filters, ranking, joins, upserts, validation, archive, analytics
  plans      - driver-table adapters and the report layer
  streaming  - Structured Streaming twins of the batch operators
"""

__version__ = "0.1.0"
