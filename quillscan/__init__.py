"""quillscan: static analysis of source text as relational queries on Spark."""
