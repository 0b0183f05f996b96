"""Document ingest, retrieval and export on Spark."""
