"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType(), False)
POINTS = T.StructType([T.StructField("point_id", T.LongType(), False), T.StructField("descriptor", VECTOR, False)])
QUERIES = T.StructType([T.StructField("query_id", T.LongType(), False), T.StructField("descriptor", VECTOR, False)])
TRUTH = T.StructType([T.StructField("query_id", T.IntegerType(), False), T.StructField("neighbours", T.ArrayType(T.IntegerType(), False), False)])
NODES = T.StructType([T.StructField("level", T.IntegerType(), False), T.StructField("node_id", T.LongType(), False), T.StructField("descriptor", VECTOR, False)])
EDGES = T.StructType([T.StructField("level", T.IntegerType(), False), T.StructField("parent_id", T.LongType(), False), T.StructField("child_id", T.LongType(), False)])
NEIGHBOURS = T.ArrayType(T.StructType([T.StructField("dist", T.DoubleType()), T.StructField("point_id", T.LongType())]))
