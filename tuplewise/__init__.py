"""Declarative tuple-variable queries over annotated entities, lowered to one Spark DataFrame plan."""
