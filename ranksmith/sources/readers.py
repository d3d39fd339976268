"""Readers: raw tables, topics, judgments, runs, submissions, features, samples.  Schemas are declared, never inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import strip
from ..schema import RAW, SAMPLE, TOPIC

SPLITS = {"train": 1, "dev": 2, "test": 3}


def resolve_split(spec: str) -> list[int]:
    """'train+dev' -> [1, 2]; repeated parts count once, unknown ones fail."""
    parts = list(dict.fromkeys(p.strip() for p in spec.split("+")))
    bad = [p for p in parts if p not in SPLITS]
    if bad or not parts:
        raise ValueError(f"unknown split {'+'.join(bad) or spec!r}; known: {', '.join(SPLITS)}")
    return [SPLITS[p] for p in parts]


def qrels_path(root: str, year: int, kind: str = "official") -> str:
    if kind not in ("official", "all"):
        raise ValueError(f"unknown kind of judgments: {kind!r}")
    if year not in SPLITS.values():
        raise ValueError(f"unknown year: {year}")
    return f"{root}/{'converted' if year == 1 else f'year{year}'}/qrels_{kind}.tsv"


def topics_dir(root: str, year: int) -> str:
    if year not in SPLITS.values():
        raise ValueError(f"unknown year: {year}")
    return f"{root}/year{year}/topics"


def raw_table(spark: SparkSession, path: str) -> DataFrame:
    """One representation's tab-separated files: header, quoted fields with line breaks and doubled quotes."""
    return spark.read.csv(path, sep="\t", header=True, schema=RAW, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1, pathGlobFilter="*.tsv")


def sample(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=SAMPLE)


def ordered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, at, value) of the lines that are not empty; ``at`` orders the lines of a file.  Files are split like any text:
    a line is known by its block and its place among the rows read, and nothing is shuffled."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.regexp_replace("value", "\r$", "").alias("value")).where("value <> ''")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value) with true line numbers from 1, empty lines counted and left out; each file's lines are sorted in
    one task."""
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.regexp_replace("value", "\r$", "").alias("value"))
    return rows.select("file", F.row_number().over(Window.partitionBy("file").orderBy("at")).alias("line"), "value").where("value <> ''")


def _refuse(spark: SparkSession, path: str | list[str], bad: DataFrame, why: str, cond) -> None:
    """An error that names the first bad line, if there is one; lines are numbered only then."""
    if not bad.isEmpty():
        first = _fields(numbered_lines(spark, path)).where(cond).orderBy("file", "line").first()
        raise ValueError(f"{first['file']}, line {first['line']}: {why}")


def _fields(lines: DataFrame) -> DataFrame:
    return lines.withColumn("f", F.split(strip("value"), r"(?U)\s+"))


def _last_wins(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct("file", "at")).alias(value))


def formula_qrels(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """(topic_id, formula_id, grade) of every valid line, repeated ones kept: fewer than four fields or a grade that is
    no number is skipped (headers; strict: such a grade is an error), grades are cut towards zero."""
    f = _fields(ordered_lines(spark, path)).where(F.size("f") >= 4)
    if strict:
        wrong = (F.size("f") >= 4) & F.get("f", F.lit(3)).try_cast("double").isNull()
        _refuse(spark, path, f.where(wrong), "the grade is no number", wrong)
    rows = f.select("file", "at", F.get("f", F.lit(0)).alias("topic_id"), F.get("f", F.lit(2)).alias("formula_id"), F.get("f", F.lit(3)).try_cast("double").cast("int").alias("grade"))
    return rows.where("grade is not null")


def qrels(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """(topic_id, visual_id, grade); of repeated pairs the last line counts."""
    return _last_wins(formula_qrels(spark, path, strict).withColumnRenamed("formula_id", "visual_id"), ["topic_id", "visual_id"], "grade")


def split_qrels(spark: SparkSession, root: str, spec: str, kind: str = "official") -> DataFrame:
    """The judgments of several splits, 'train+dev', as training reads them: a grade that is no number is an error.  Topics
    of different years have different ids."""
    return reduce(DataFrame.unionByName, [qrels(spark, qrels_path(root, y, kind), strict=True) for y in resolve_split(spec)])


def run(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, visual_id, score, run_id): exactly six fields a line or an error naming the line; blank lines pass."""
    f = _fields(ordered_lines(spark, path).where(strip("value") != ""))
    wrong = (strip("value") != "") & (F.size("f") != 6)
    _refuse(spark, path, f.where(wrong), "six columns expected", wrong)
    rows = f.select("file", "at", F.get("f", F.lit(0)).alias("topic_id"), F.get("f", F.lit(2)).alias("visual_id"), F.get("f", F.lit(4)).cast("double").alias("score"), F.get("f", F.lit(5)).alias("rid"))
    names = rows.groupBy("file").agg(F.max_by("rid", "at").alias("run_id"))
    return _last_wins(rows.join(F.broadcast(names), "file").withColumn("sr", F.struct("score", "run_id")), ["topic_id", "visual_id"], "sr").select("topic_id", "visual_id", "sr.score", "sr.run_id")


def submission(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, pos, formula_id, score) in file order; lines whose score is no number (headers) are skipped."""
    rows = numbered_lines(spark, path).withColumn("f", F.split("value", "\t")).where(F.size("f") >= 5)
    got = rows.select(strip(F.get("f", F.lit(0))).alias("topic_id"), F.col("line").cast("long").alias("pos"), strip(F.get("f", F.lit(1))).alias("formula_id"), strip(F.get("f", F.lit(4))).try_cast("double").alias("score"))
    return got.where("score is not null")


def topics(spark: SparkSession, path: str, year: int) -> DataFrame:
    """(topic_id, year, formula_id, latex) from topic XML; topics without a number or a formula id are skipped."""
    schema = "_number string, Formula_Id string, Latex string"
    rows = spark.read.format("xml").options(rowTag="Topic").schema(schema).load(path)
    return rows.where("_number is not null and Formula_Id is not null").select(strip("_number").alias("topic_id"), F.lit(year).alias("year"), strip("Formula_Id").alias("formula_id"), F.coalesce(strip("Latex"), F.lit("")).alias("latex"))


def only_file(spark: SparkSession, folder: str, pattern: str) -> str:
    """The one file of the folder that the pattern names, on any file system; none or several are an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = [str(f.getPath()) for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or ()]
    if len(found) != 1:
        raise ValueError(f"one file {pattern} expected in {folder}, found {len(found)}")
    return found[0]


def split_topics(spark: SparkSession, root: str, spec: str) -> DataFrame:
    """The topics of several splits, 'train+dev', with their markup."""

    def of(year: int) -> DataFrame:
        folder = topics_dir(root, year)
        markup = [topic_formulas(spark, only_file(spark, folder, f"*[{n[0]}{n[0].upper()}][{n[1]}{n[1].upper()}][{n[2]}{n[2].upper()}]*.tsv"), n) for n in ("slt", "opt")]
        return with_markup(topics(spark, only_file(spark, folder, "Topics*.xml"), year), *markup)

    return reduce(DataFrame.unionByName, map(of, resolve_split(spec)))


def query_latex(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(topic_id, latex) over all topic files, for diagnosis: topics without LaTeX are left out, of repeated ones the file
    that comes last counts."""
    rows = reduce(DataFrame.unionByName, [topics(spark, p, i) for i, p in enumerate(paths)]).where("latex <> ''")
    return rows.groupBy("topic_id").agg(F.max_by("latex", "year").alias("latex"))


def topic_formulas(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(formula_id, <name>) from a topic formula table: the markup is the fifth column whatever its header says; shorter
    rows are skipped, of repeated ids the last counts."""
    raw = spark.read.csv(path, sep="\t", header=False, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1, schema="id string, topic_id string, thread_id string, type string, markup string")
    rows = raw.where("markup is not null and id <> 'id'").withColumn("__n", F.monotonically_increasing_id())
    return rows.groupBy(F.col("id").alias("formula_id")).agg(F.max_by("markup", "__n").alias(name))


def with_markup(topic_rows: DataFrame, slt: DataFrame, opt: DataFrame) -> DataFrame:
    """Topics with their two representations (null where missing)."""
    return topic_rows.join(slt, "formula_id", "left").join(opt, "formula_id", "left").select(*TOPIC.fieldNames())


def features(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """A feature table; unknown names fail when the plan is analysed."""
    rows = spark.read.parquet(path)
    return rows if names is None else rows.select("topic_id", "visual_id", "grade", *names)
