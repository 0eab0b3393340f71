"""modengine: Spark-native operators for content-moderation tables.

Everything here is a Column function or a ``DataFrame -> DataFrame`` operator,
so plans compose with ``DataFrame.transform`` and Catalyst sees all of them.
"""

__version__ = "0.1.0"
