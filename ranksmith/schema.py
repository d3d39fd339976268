"""Fixed schemas and constants of the retrieval data model."""

from __future__ import annotations

from pyspark.sql import types as T

DEPTH = 1000  # length of a run per topic
RELEVANT = 2  # least grade that counts as relevant
RRF_K = 60
K1, B = 1.2, 0.75
MAX_TREE_NODES = 64
MAX_GRAPH_NODES = 256
MAX_SYMBOL = 30

_TYPES = {"long": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "string": T.StringType, "boolean": T.BooleanType}


def struct(fields: str) -> T.StructType:
    """A schema of plain types from 'name type, ...', without a session at hand."""
    return T.StructType([T.StructField(n, _TYPES[t]()) for n, t in (f.split() for f in fields.split(", "))])


RAW = struct("id long, post_id long, thread_id long, type string, comment_id string, old_visual_id string, visual_id string, issue string, formula string")
FORMULA_INDEX = struct("id long, post_id long, thread_id long, type string, comment_id string, old_visual_id string, visual_id string, issue string, retrievable boolean, latex string, opt string, slt string")
VISUAL_INDEX = struct("visual_id string, formula_id long, post_id long, type string, n_instances long, latex string, slt string, opt string")
SAMPLE = struct("id long, post_id long, type string, old_visual_id string, visual_id string, latex string, opt string, slt string")
TOPIC = struct("topic_id string, year int, formula_id string, latex string, slt string, opt string")
QRELS = struct("topic_id string, visual_id string, grade int")
RUN = struct("topic_id string, visual_id string, score double")
SUBMISSION = struct("topic_id string, pos long, formula_id string, score double")
EDGE = struct("src int, dst int, type string")
GRAPH = T.StructType([T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("symbols", T.ArrayType(T.StringType())), T.StructField("edges", T.ArrayType(EDGE))])
