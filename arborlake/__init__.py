"""arborlake: structured-document analytics as Spark DataFrames."""
