"""Course-content analytics on Spark DataFrames: matching, consolidation, validation and data preparation."""

__version__ = "0.1.0"
