"""Spark types used by Python functions (as objects, so that modules load without a session)."""

from pyspark.sql.types import ArrayType, IntegerType

INTS = ArrayType(IntegerType())
