"""Versioned key/value, document and property-graph analytics on Spark DataFrames."""
