"""martflow: a Spark-native retail analytics pipeline.

Raw retail tables -> Silver (typed, cleaned) -> Gold (five business tables)
-> point-in-time churn features -> MLlib models and scores -> drift
monitoring -> KPI signals, findings and explorer queries. Every builder is
a lazy ``DataFrame -> DataFrame`` function over built-in Spark expressions.
"""

__version__ = "0.1.0"
