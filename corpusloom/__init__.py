"""corpusloom: corpus-scale document mirrors, ledgers and interval analytics on PySpark DataFrames."""
