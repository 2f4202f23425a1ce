"""Spark operators for gappy multi-site hourly series with array-valued spectra."""
