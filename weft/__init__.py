"""weft: a Spark-first engine for analysing acquired web pages, search hits and fetch logs."""

__version__ = "0.1.0"
