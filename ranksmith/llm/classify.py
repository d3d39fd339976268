"""Two text classifiers over hashed grams: document quality and toxicity.

Both fit on a bounded sample of labelled rows (at most ``most_rows``, half from either class, chosen by a hash of the key
so that reruns agree, and of those as many as ``most_grams`` different grams in all allow) and score every whole text.
What is collected is bounded in rows and bytes: the sample's keys, and its grams, 4 or 8 bytes each.  The fitted model is
a sparse vector, bounded by the gram space and in practice a few thousand weights.  The documents are scanned twice, once
for the sample and once for the scores, and are never shuffled.

Defined results for odd input
    null or empty text: no grams, the score of the bias alone.  Text of any length: scored whole.
    repeated rows or keys: scored each.  Empty table: an empty result; without labels, or with one class, the model is
    the constant share of label 1 (one half where nothing is known).
    null keys: held out by the crc32 of the empty text, never in training (labels cannot join).
    extra columns: kept, except those named like an output column, which the output replaces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, linear
from .shared import columns_free_of, fold, map_arrow, mark, stored, sweep

OUT = ("held_out", "score", "predicted")


@dataclass(frozen=True)
class Task:
    """A label column, its held-out fold, the grams and the training parameters."""

    label: str
    mod: int
    held_out: int
    spec: linear.GramSpec
    ftrl: linear.Ftrl
    most_rows: int
    most_grams: int = 1 << 24


#: Hashed word n-grams (one and two words, one to three shapes) weighted by their share of the text.
QUALITY = Task("quality", 3, 1, linear.GramSpec(words=((), (1,)), shapes=((), (1,), (1, 1)), scale=20.0), linear.Ftrl(), 6000)

#: Hashed words, neighbours and skip-grams, each once per text; the stronger L1 leaves a compact model.
TOXIC = Task("toxic", 5, 0, linear.GramSpec(words=((), (1,), (2,)), presence=True), linear.Ftrl(alpha=10.0, l1=8.0, epochs=10), 8192)


@dataclass
class Classifier:
    task: Task
    model: linear.Model
    trained_on: int = 0
    _weights: object = field(default=None, repr=False)

    def score(self, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """documents with held_out, score (0 to 1) and predicted (score >= 0.5)."""
        spark, spec, bias = documents.sparkSession, self.task.spec, self.model.bias
        if self._weights is None:
            self._weights = spark.sparkContext.broadcast((self.model.index, self.model.weight))
        shared, task = self._weights, self.task
        frame = columns_free_of(documents, *OUT)
        names, at = frame.columns, frame.columns.index(text)
        schema = frame.select("*", F.lit(0.0).alias("score")).schema
        state: dict = {}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            if "w" not in state:
                index, weight = shared.value
                state["w"] = linear.Model(spec, index, weight, bias).dense()
            margin = [linear.margins(p, spec, state["w"], bias) for p in kernel.slices(batch.column(at))]
            score = linear.probability(np.concatenate(margin))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*names, "score"])

        return map_arrow(frame, work, schema).select(
            "*", (fold(task.mod, key) == task.held_out).alias("held_out"), (F.col("score") >= 0.5).cast("int").alias("predicted")
        )


def fit(documents: DataFrame, labels: DataFrame, task: Task, key: str = "doc_id", text: str = "text") -> Classifier:
    """Fit on labelled rows outside the held-out fold, at most task.most_rows of them."""
    known = labels.select(key, F.col(task.label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col(key).isNotNull() & (fold(task.mod, key) != task.held_out)).dropDuplicates([key])
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rank = F.xxhash64(F.col(key), F.lit(task.ftrl.seed))
    half = task.most_rows // 2
    parts = [known.where(F.col("y") == y).orderBy(rank, key).limit(half) for y in (0, 1)]
    chosen = [(r[key], r["y"]) for p in parts for r in p.collect()]  # at most most_rows keys
    total = sum(counts.values())
    if len(counts) < 2:
        share = (counts.get(1, 0) + 0.5) / (total + 1)
        return Classifier(task, linear.Model(task.spec, np.empty(0, np.int32), np.empty(0, np.float32), math.log(share / (1 - share))), total)
    spark, since = documents.sparkSession, mark()
    wanted = F.broadcast(spark.createDataFrame(chosen, known.schema))
    sample = documents.select(key, text).join(wanted, key)
    spec = task.spec

    def work(batch: pa.RecordBatch):
        keys, y = batch.column(0), batch.column(2)
        for p in kernel.slices(batch.column(1)):
            got = linear.examples(p, spec)
            yield pa.RecordBatch.from_arrays(
                [keys[p.lo : p.hi], y[p.lo : p.hi], pa.array([len(c) for c, _ in got], pa.int64()), pa.array([c.tobytes() for c, _ in got], pa.binary()), pa.array([b"" if spec.presence else v.tobytes() for _, v in got], pa.binary())],
                ["key", "y", "n", "col", "value"],
            )

    kind = known.schema[key].dataType.simpleString()
    texts = stored(map_arrow(sample.select(key, text, "y"), work, f"key {kind}, y int, n long, col binary, value binary"), "training-sample")
    # In the order of the sample, every row that the grams left over have room for.
    left, out = task.most_grams, []
    for r in texts.select("key", "n").orderBy(F.xxhash64("key", F.lit(task.ftrl.seed)), "key", "n").collect():
        if r["n"] <= left:
            left -= r["n"]
        else:
            out.append((r["key"], r["n"]))
    if out:
        texts = texts.join(F.broadcast(spark.createDataFrame(out, f"key {kind}, n long").distinct()), ["key", "n"], "left_anti")
    got = texts.toArrow()
    sweep(spark, since)
    order = np.argsort(np.array([f"{k}" for k in got["key"].to_pylist()]), kind="stable")
    y = got["y"].to_numpy()[order].astype(float)
    cols, values = got["col"].combine_chunks(), got["value"].combine_chunks()
    rows = []
    for i in order:
        c = np.frombuffer(cols[int(i)].as_py(), np.int32)
        rows.append((c, np.ones(len(c), np.float32) if spec.presence else np.frombuffer(values[int(i)].as_py(), np.float32)))
    if len(set(y)) < 2:
        share = (counts[1] + 0.5) / (total + 1)
        return Classifier(task, linear.Model(spec, np.empty(0, np.int32), np.empty(0, np.float32), math.log(share / (1 - share))), total)
    model = linear.train(rows, y, spec, task.ftrl)
    taken = [(y == c).sum() for c in (0, 1)]
    model.bias += math.log(counts[1] / counts[0]) - math.log(taken[1] / taken[0])  # the classes' shares among all labels
    return Classifier(task, model, len(y))


def op1_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns: doc_id, held_out, score, predicted."""
    return fit(documents, labels, QUALITY).score(documents.select("doc_id", "text")).select("doc_id", "held_out", "score", "predicted")


def op4_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return fit(documents, labels, TOXIC).score(documents.select("doc_id", "text")).select("doc_id", "held_out", "score", "predicted")
