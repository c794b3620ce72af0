"""quire: PDF analytics and document processing on Spark DataFrames."""
