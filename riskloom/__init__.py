"""riskloom: bank credit-risk portfolio analytics on PySpark DataFrames."""
