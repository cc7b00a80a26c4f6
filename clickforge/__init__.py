"""clickforge: click-through-rate analytics as lazy Spark DataFrame operators.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects and
adds to the logical plan; actions happen only where a small, bounded piece of
metadata (a schema decision, a column statistic) is needed to build the plan.
"""

__version__ = "0.1.0"
