"""Document analytics on Spark: sources, text and page operators, search, formats."""
