"""quillmap: record, text and planar-shape analytics on Spark DataFrames."""
