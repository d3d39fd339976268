"""Helpers the operators share: the folder all executors see, tables that cut lineage, Arrow mapping, hashing in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.workers import ship

#: Below this the white-space pattern of the word contracts, for Spark's and DuckDB's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"

BATCH_BYTES = 8 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_OWN: dict[str, str] = {}


#: Tables and folders made so far, oldest first; see ``sweep``.
_MADE: list[str] = []

#: Most names of documents in one broadcast: 16 bytes each, some 64 MB as a hash table.
MOST_NAMES = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where the setting is absent and all tasks run in the
    driver's process.  On a cluster without the setting this is an error: executors could not see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="ranksmith-")
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/ranksmith/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs a re-read only."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time, for ``sweep``."""
    return len(_MADE)


def sweep(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete what was stored since the mark, but for the tables that the given frames read: call it once their results,
    and no others, are still wanted."""
    wanted = "\n".join(f for k in keep for f in k.inputFiles())
    gone = [p for p in _MADE[since:] if p.rsplit("/", 1)[1] not in wanted]
    for p in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _MADE.remove(p)


def name_of(key: Column, digest: Column) -> Column:
    """16 bytes that name a document: of its key (null is no key's text) and the digest of its text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")).cast("binary"), F.lit("|").cast("binary"), digest)))


def text_digest(text: Column) -> Column:
    """16 bytes; null counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def split_off(rows: DataFrame, names: DataFrame, how: str, on: str = "__name") -> DataFrame:
    """rows with (how = left_semi) or without (left_anti) the stored names.  A few names, counted, are broadcast, so that no
    text moves; more are joined by a shuffle."""
    small = names.count() <= MOST_NAMES
    return rows.join(F.broadcast(names) if small else names, on, how)


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow over single batches; ``work`` returns one batch or yields several."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            got = work(batch)
            if isinstance(got, pa.RecordBatch):
                yield got
            else:
                yield from got

    return stream_arrow(df, each, schema)


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df under neutral column names, and the neutral name of each; for stages that must return df's own columns whatever
    they are called."""
    new = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*new.values()), new


def stream_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow with the package at hand in the workers, and batches of at most BATCH_BYTES where the session has
    Spark's default of 64 MiB: a batch is bounded in bytes, however long the texts are."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


def fold(mod: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo ``mod``; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod


def digest_text(*parts: Column | str) -> Column:
    """md5 of the parts joined with '|': the same in any engine, so seeded choices can be checked in SQL."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws("|", *cols).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_free_of(df: DataFrame, *names: str) -> DataFrame:
    """df without the given columns (matched as Spark resolves them, whatever their case): an operator's own output
    columns replace clashing input columns."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
