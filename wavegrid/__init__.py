"""wavegrid: signals, pictures, event series and text corpora as Spark DataFrames."""
