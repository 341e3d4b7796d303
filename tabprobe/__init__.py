"""tabprobe -- Spark-native table profiling, statistics, cleaning, chart
aggregates and model preparation. Every operator maps DataFrame -> DataFrame."""

__version__ = "0.1.0"
