"""leadloom: company-lead extraction, deduplication and routing as Spark DataFrame jobs."""
