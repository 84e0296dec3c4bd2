"""edgeweave: typed property-graph queries and dataset preparation on PySpark DataFrames."""

__version__ = "0.1.0"
