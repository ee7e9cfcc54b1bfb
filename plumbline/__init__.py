"""plumbline: table profiling, preprocessing, models and association mining as Spark plans."""
