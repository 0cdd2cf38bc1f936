"""Long-document analytics over tables of many books, expressed as Spark DataFrames."""
