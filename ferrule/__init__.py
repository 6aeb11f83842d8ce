"""Declarative entity queries and change sets on Spark."""
