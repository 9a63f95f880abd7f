"""gridlark: a pivot-style analytics engine whose every query is one Spark plan."""

__version__ = "0.1.0"
