"""Source-corpus analytics on PySpark: rules over syntax nodes as relational plans."""
