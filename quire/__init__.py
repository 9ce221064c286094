"""quire: a Spark-native engine that turns semi-structured documents into relational tables.

The core lives in ``functions`` (Column -> Column), ``operators`` (DataFrame ->
DataFrame), ``sources``, ``streaming`` and ``plans`` (the registered queries).
``quire.llm`` holds the training-data operators; nothing else imports it.
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
