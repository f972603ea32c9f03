"""Operators for preparing training corpora, each a Spark job; queries are in ``queries``."""
