"""evalflow: Spark-native evaluation of retrieval-augmented-generation runs.

Modules
-------
sources    fixtures derived from the shared tables, question/document
           loaders, the Parquet run store
functions  column helpers (tokens, JSON/variant, text, ordinals)
operators  frames, statistics, options, drill-down, metrics, ingest,
           retrieval
plans      sampling, work plans, resume, pipeline execution
streaming  continuous scoring and live status
"""

__version__ = "0.1.0"
