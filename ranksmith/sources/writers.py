"""Writers: tables, run and submission files, statistics, vocabularies, embedding caches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.conversion import to_lines
from ..schema import DEPTH


def table(df: DataFrame, path: str, force: bool = False) -> None:
    """Parquet (snappy); a table that exists is left alone unless forced."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)


def run_file(run: DataFrame, run_id: str, path: str, depth: int = DEPTH) -> None:
    """One text file of run lines, topics in order, ranks ascending (a run is topics times depth lines)."""
    to_lines(run, run_id, depth).coalesce(1).sortWithinPartitions("topic_id", "rank").select("value").write.mode("overwrite").text(path)


def submission_file(rows: DataFrame, path: str) -> None:
    """Tab-separated submission lines from operators.conversion.export_submission."""
    line = F.concat_ws("\t", "topic_id", F.col("formula_id").cast("string"), F.col("post_id").cast("string"), F.col("rank").cast("string"), F.col("score").cast("string"), "run_id")
    rows.coalesce(1).sortWithinPartitions("topic_id", "rank").select(line.alias("value")).write.mode("overwrite").text(path)


def conflicts_file(conflicts: DataFrame, path: str) -> None:
    conflicts.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def report(df: DataFrame, path: str) -> None:
    """Statistics or per-topic measures as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def vocabularies(vocabs: dict[str, dict], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(vocabs, f, ensure_ascii=False)


def load_vocabularies(path: str) -> dict[str, dict]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def cached(spark: SparkSession, path: str, fingerprint: str, make, marker: dict | None = None) -> DataFrame:
    """The table below path for this model fingerprint, made and written where it is missing.

    marker: what the table must have been made from (step, size, dim, ...).  It is written beside the table, after it, and a
    table whose marker is another or missing is made anew."""
    where = f"{path}/model={fingerprint}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    done, note = hadoop.Path(f"{where}/_SUCCESS"), hadoop.Path(f"{path}/marker-{fingerprint}.json")
    system = done.getFileSystem(spark._jsc.hadoopConfiguration())
    text = json.dumps(marker, sort_keys=True)
    known = system.exists(done) and (marker is None or system.exists(note) and spark.read.text(str(note), wholetext=True).first()[0] == text)
    if not known:
        make().write.mode("overwrite").parquet(where)
        if marker is not None:
            out = system.create(note, True)
            out.write(bytearray(text.encode()))
            out.close()
    return spark.read.parquet(where)


def graph_store(graphs: DataFrame, path: str, slt: str = "slt", opt: str = "opt", force: bool = False) -> DataFrame:
    """Write encoded graphs, and return their totals: (rep, graphs, nodes, edges, truncated)."""
    table(graphs, path, force)
    rows = graphs.sparkSession.read.parquet(path)
    part = lambda rep, c: rows.select(F.lit(rep).alias("rep"), F.size(f"{c}.tag").alias("n"), F.size(f"{c}.edges").alias("e"), F.col(f"{c}.truncated").alias("t")).where("n > 0")
    both = part("slt", slt).unionByName(part("opt", opt))
    return both.groupBy("rep").agg(F.count("*").alias("graphs"), F.sum("n").alias("nodes"), F.sum("e").alias("edges"), F.count_if("t").alias("truncated"))


def text_report(df: DataFrame, title: str, samples: int = 20, width: int = 90) -> str:
    """The first rows as an aligned table, long values cut to ``width``."""
    cut = lambda v: v if len(v) <= width else v[: width - 1] + "…"
    shown = [df.columns, *([cut(f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)) for v in r] for r in df.limit(samples).collect())]
    wide = [max(len(r[i]) for r in shown) for i in range(len(df.columns))]
    return "\n".join([title, *("  ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip() for r in shown)])
