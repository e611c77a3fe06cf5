"""kinloom: record linkage, family graphs and text-to-table analytics on Spark."""

__version__ = "0.1.0"
