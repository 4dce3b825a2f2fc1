"""tideframe: panel, network, spectral and signal analytics on PySpark DataFrames."""

__version__ = "0.1.0"
