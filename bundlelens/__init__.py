"""Cross-sell and sales-benchmark analytics over household snapshots, on Spark DataFrames."""
