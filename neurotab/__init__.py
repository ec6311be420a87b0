"""neurotab: multichannel brain-signal analytics as Spark DataFrame operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` (so it
composes with ``DataFrame.transform``), takes column names as arguments and
never brings data rows to the driver; only fitted parameters whose size is
bounded by the number of features or classes are collected.
"""

__version__ = "0.1.0"
