"""A document-intelligence and analytics engine on Spark DataFrames."""
