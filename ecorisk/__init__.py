"""PySpark-native ecosystem risk analytics: extent, occupancy and Criterion B at cluster scale."""

__version__ = "0.1.0"
