"""lathe: a PySpark-native engine for code-graph, change-review and event analytics."""
