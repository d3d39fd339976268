import pyarrow as pa
import pytest

from ranksmith.llm import kernel, shared


def test_stored_tables_are_swept(spark):
    since = shared.mark()
    keep, gone = shared.stored(spark.range(3), "keep"), shared.stored(spark.range(4), "gone")
    path = gone.inputFiles()[0]
    shared.sweep(spark, since, keep)
    assert keep.count() == 3 and shared.mark() == since + 1
    import os

    assert not os.path.exists(path.removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())


def test_split_off_is_the_same_by_broadcast_and_by_shuffle(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.range(100).withColumn("__name", shared.name_of(F.col("id"), shared.text_digest(F.lit("t"))))
    names = shared.stored(rows.where("id % 3 = 0").select("__name"), "some-names")
    for most in (1 << 19, 1):
        monkeypatch.setattr(shared, "MOST_NAMES", most)
        assert shared.split_off(rows, names, "left_anti").count() == 66 and shared.split_off(rows, names, "left_semi").count() == 34


def test_distinct_spans_whatever_the_hash(monkeypatch):
    texts = ["aa bb aa cc", "", "bb dd aa é é"]
    (piece,) = kernel.slices(pa.array(texts, pa.large_string()))
    for _ in range(2):
        w = kernel.words(piece)
        first, back = kernel.distinct(piece.data, w.start, w.end)
        spell = [piece.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
        assert [spell[first[i]] for i in back] == spell and len(first) == 5
        assert kernel.binary(piece.data, w.start, w.end).to_pylist() == [x.encode() for x in spell]
        monkeypatch.setattr(kernel, "content_hash", lambda data, start, end, parts=None: (end - start).astype("uint64"))
