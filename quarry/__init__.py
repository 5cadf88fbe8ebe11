"""quarry: Spark-native corpus indexing and similarity search.

Every operator is a ``DataFrame -> DataFrame`` transformation built from
Spark SQL expressions, joins, aggregations and windows, so Catalyst plans
it; the few vectorised kernels run as Arrow-batched ``mapInPandas`` /
``applyInPandas`` tasks over Spark-partitioned data.
"""

__version__ = "0.1.0"
