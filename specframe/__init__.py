"""Mass-spectrometry analytics as DataFrame operators on Spark."""
