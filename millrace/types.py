"""Schemas of the records that the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

DATA_POINT = T.StructType([T.StructField("question", T.StringType(), False), T.StructField("final_answer", T.StringType(), False), T.StructField("rationale", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
VECTOR_RECORD = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("vector", T.ArrayType(T.FloatType()), False), T.StructField("payload", T.StringType())])
MEMORY_RECORD = T.StructType([T.StructField("uuid", T.StringType(), False), T.StructField("role_at_backend", T.StringType()), T.StructField("content", T.StringType()), T.StructField("extra_info", T.MapType(T.StringType(), T.StringType())), T.StructField("timestamp", T.DoubleType()), T.StructField("agent_id", T.StringType())])
CONTEXT_RECORD = T.StructType([T.StructField("memory_record", MEMORY_RECORD), T.StructField("score", T.DoubleType()), T.StructField("timestamp", T.DoubleType())])
ALPACA = T.StructType([T.StructField(c, T.StringType()) for c in ("instruction", "input", "output")])
SHAREGPT = T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())]))
TOOL_CALL = T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())])
NODE = T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType()))])
RELATIONSHIP = T.StructType([T.StructField(c, T.StringType()) for c in ("subj", "obj", "type", "timestamp")])
MULTI_HOP_QA = T.StructType([T.StructField("question", T.StringType()), T.StructField("reasoning_steps", T.ArrayType(T.StringType())), T.StructField("answer", T.StringType()), T.StructField("supporting_facts", T.ArrayType(T.StringType())), T.StructField("type", T.StringType())])
VERIFICATION = T.StructType([T.StructField("status", T.StringType()), T.StructField("result", T.StringType()), T.StructField("duration", T.DoubleType()), T.StructField("error_message", T.StringType())])
TASK = T.StructType([T.StructField("task_id", T.StringType()), T.StructField("content", T.StringType()), T.StructField("state", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("dependencies", T.ArrayType(T.StringType()))])
