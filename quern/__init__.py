"""quern: boolean document search, aggregation and percolation on PySpark."""
