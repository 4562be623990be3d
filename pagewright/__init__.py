"""pagewright: a PySpark-native document-to-table engine.

Operators take and return DataFrames (or Columns) and never collect unbounded
data.  Sub-packages: ``functions`` (column expressions), ``operators``
(DataFrame transformations), ``sources``, ``plans`` (named queries),
``streaming``; ``llm`` is optional and nothing else imports it.
"""

__version__ = "0.1.0"
