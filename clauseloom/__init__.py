"""A PySpark-native engine that turns documents into reviewable decisions."""
