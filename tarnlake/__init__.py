"""Tarnlake: a PySpark-native analytics engine for image- and document-corpus lakes."""
