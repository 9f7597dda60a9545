"""imagelake: image and texture analytics on Spark DataFrames."""
