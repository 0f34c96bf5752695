"""Forecast measurement as Spark DataFrame, ML and Structured Streaming operators."""
