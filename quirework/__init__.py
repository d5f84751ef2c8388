"""Quirework: Spark-native analytics for page documents, delivery logs and frame streams.

Every operator is a function from DataFrame to DataFrame (plus options), so it
composes with ``df.transform`` and leaves the physical plan to Catalyst.
"""

__version__ = "0.1.0"
