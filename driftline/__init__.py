"""Regime analytics over many price series, as Spark DataFrame operators."""
