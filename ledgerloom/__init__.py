"""ledgerloom: a PySpark-native engine for filings, lobbying records and legislation."""

__version__ = "0.1.0"
