"""Evidence retrieval and evaluation over DataFrames."""
