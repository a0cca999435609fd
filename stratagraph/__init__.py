"""stratagraph: a Spark-native analytics engine for software-project memory.

Graph snapshots, chunks, claims, episodes and metrics are plain DataFrames; every operator takes
DataFrames and returns a lazy DataFrame, so Catalyst plans the whole query.
"""

__version__ = "0.1.0"
