"""Safety screening of chat traffic and text as Spark DataFrame operations."""
