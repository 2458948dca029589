"""Scalar functions of the language as Spark columns."""
