"""codequarry: code-graph analytics and training-data preparation as PySpark plans."""
