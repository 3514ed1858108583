"""mooring: Spark-native analytics for reasoning traces.

Everything public is a ``DataFrame -> DataFrame`` transform or a ``Column``
builder; nothing here opens its own cluster or collects unbounded data.
"""

__version__ = "0.1.0"
