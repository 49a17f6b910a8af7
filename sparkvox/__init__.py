"""sparkvox: corpus analytics for short free-text documents on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
functions, so Catalyst plans the whole chain and the work scales with the
cluster. See README.md for the operator list.
"""

__version__ = "0.1.0"
