"""Dataset-integrity engine on Spark DataFrames.

Sub-packages: ``functions`` (scalar expressions), ``sources`` (readers and writers),
``operators`` (joins, graph, aggregations), ``plans`` (whole queries), ``streaming``
(content-hash de-duplication of streams) and ``llm`` (training-data operators, optional).
"""
