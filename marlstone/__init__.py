"""Marlstone: a Spark-native analytics engine for evidence collections and corpora."""
