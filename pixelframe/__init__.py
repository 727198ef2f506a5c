"""pixelframe: image time-lapses and the series measured from them, as Spark DataFrames."""
