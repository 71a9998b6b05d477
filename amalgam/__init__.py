"""Entity resolution and data-quality engine on Spark DataFrames."""
