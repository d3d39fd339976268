"""Incremental ingest: new raw files are picked up once each and appended to the parsed formula table.

The reference work has no streams; this is the batch parse as a file stream with ``availableNow``, so a scheduled run
processes what has arrived since the last one, exactly once through the checkpoint."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C
from ..functions.udfs import parse_formulas
from ..schema import RAW


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, representation: str = "slt", files_per_batch: int = 16) -> StreamingQuery:
    """Parse new tab-separated files of one representation (slt or opt) and append symbols and graphs to ``target``."""
    raw = spark.readStream.schema(RAW).options(sep="\t", header=True, multiLine=True, quote='"', escape='"', maxFilesPerTrigger=files_per_batch).csv(source)
    markup = C.blank_to_null("formula")
    none = F.lit(None).cast("string")
    rows = raw.select("id", "visual_id", C.union_flags("issue").alias("issue"), C.retrievable("issue").alias("retrievable"), (markup if representation == "slt" else none).alias("slt"), (markup if representation == "opt" else none).alias("opt"))
    return parse_formulas(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
