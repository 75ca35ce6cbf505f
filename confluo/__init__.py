"""confluo: entity resolution on Spark DataFrames, with a corpus-preparation subpackage."""
