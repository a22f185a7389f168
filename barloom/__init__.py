"""Time-series panel operators for futures bars, as PySpark DataFrame functions."""
