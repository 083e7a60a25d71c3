"""Tables derived from the given parquet tables, in Spark and in SQL."""
