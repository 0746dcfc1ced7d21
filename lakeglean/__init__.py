"""A Spark-native search, lake and data-preparation engine.

Every operator is a function from DataFrames to DataFrames: driver-side Python
validates the request and emits a plan, Catalyst and AQE choose how to run it.
"""

__version__ = "0.1.0"
