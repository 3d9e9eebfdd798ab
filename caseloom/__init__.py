"""caseloom: a Spark-native engine for retrieval, relevance and evidence analytics over case collections.

Every operator takes DataFrames and returns DataFrames; nothing is collected on the driver unless its
size is bounded by a parameter.
"""
