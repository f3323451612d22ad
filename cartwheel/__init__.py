"""cartwheel: Spark-native recommendation analytics over a retail star schema.

Every public operator is a lazy ``DataFrame -> DataFrame`` function.  Nothing is
collected to the driver except scalars and explicitly bounded tables.
"""

__version__ = "0.1.0"
