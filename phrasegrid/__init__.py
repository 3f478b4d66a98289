"""phrasegrid: positional full-text search and analytics on Spark DataFrames."""
