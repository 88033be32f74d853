"""Quarrystone: a PySpark-native analytics engine for schedules, linked notes, documents and declarative views."""
