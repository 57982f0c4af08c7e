"""ledgerleaf: sales and inventory analytics as Spark DataFrame operators.

Every operator is a plain function from DataFrames (plus parameters) to
DataFrames, built from Spark's own expressions so that Catalyst can push
filters and prune columns down to the parquet scans and whole-stage codegen
keeps the hot path in the JVM.
"""

__version__ = "0.1.0"
