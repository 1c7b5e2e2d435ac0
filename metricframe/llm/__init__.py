"""Operators for preparing training text on Spark.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface; :mod:`metricframe.llm.entries` registers the thin
``opN_*`` queries over the driver's tables and their SQL.
"""
