"""outagelens: Spark-native energy and outage time-series analytics.

Every operator is a ``DataFrame -> DataFrame`` function; Catalyst plans the
work, ``site_id`` (plus a time block for long series) is the partition key.
"""

__version__ = "0.1.0"
