"""Labelled event-table analytics as Spark DataFrame operators."""
