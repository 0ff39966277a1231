"""docloom: Spark-native building, maintaining and querying of retrieval corpora."""

__version__ = "0.1.0"
