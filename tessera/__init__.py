"""Document processing and hybrid-retrieval analytics on PySpark."""
