"""quillgraph: a PySpark-native engine for correspondence, relationship and corpus data."""
