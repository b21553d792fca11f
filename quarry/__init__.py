"""quarry: Spark-native batch analytics for click-propensity datasets,
booking reports and token-budgeted text review.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects;
reference dates, thresholds and column lists are arguments.
"""

__version__ = "0.1.0"
