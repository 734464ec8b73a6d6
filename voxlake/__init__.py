"""voxlake: transcript and text analytics on PySpark DataFrames and Structured Streaming."""
