"""netloom: network-keyed record databases and their queries on PySpark."""
