"""Order-book factor engine on Spark; every operator takes and returns DataFrames."""
