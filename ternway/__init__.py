"""Analytics over two-leg journeys with a stopover, on Spark DataFrames."""
