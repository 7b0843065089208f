"""orrery: document and table analytics on Spark DataFrames."""
