"""Contextual click-through analytics expressed as Spark DataFrame, SQL and streaming operators."""
