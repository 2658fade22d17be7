"""A PySpark-native analytics engine for policy-scoped relational queries."""
