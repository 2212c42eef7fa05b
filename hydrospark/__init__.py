"""hydrospark: raster hydrology and text-corpus operators on Spark DataFrames."""
