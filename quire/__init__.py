"""quire: document-layout, review and corpus analytics on Spark DataFrames."""
