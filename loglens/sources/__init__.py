"""Reading and writing: raw text, Parquet tables, JSON documents, model tables."""
