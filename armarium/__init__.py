"""armarium: corpus analytics on Spark DataFrames."""
