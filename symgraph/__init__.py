"""symgraph: a code-index analytics engine and corpus toolkit built on Spark DataFrames."""
