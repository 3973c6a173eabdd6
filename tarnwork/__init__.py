"""Spark-native table operators for evidence data and training-data preparation.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame in,
DataFrame out), ``sources`` (readers and sinks), ``plans`` (named queries with
their SQL twins), ``streaming`` (Structured Streaming variants) and ``llm``
(training-data operators, which nothing else imports).
"""

__version__ = "0.1.0"
