"""motifloom: subgraph pattern mining on Spark DataFrames."""
