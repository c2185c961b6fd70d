"""Kerbside: priced-listing analytics as Spark DataFrame operators."""
