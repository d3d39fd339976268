import hashlib
import re

import pytest

from ranksmith.llm import winnow

from .helpers import empty, lower, odd


def plain(docs, items):
    """(n_words, n_hit, n_items, digest, contaminated) per document, by comparing every window."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for k, t in items:
        w = cut(t)
        if k is not None and w:
            n = min(len(w), 10)
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(k)
    lengths = {len(w) for w in windows}
    out = []
    for _, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                ids = windows.get(tuple(w[i : i + n]))
                if ids:
                    hit |= set(range(i, i + n))
                    found |= ids
        s = ",".join(sorted(map(str, found)))
        out.append((len(w), len(hit), len(found), hashlib.sha256(s.encode()).hexdigest(), bool(hit)))
    return out


ITEM = "item_id long, text string"


@pytest.fixture
def items(spark):
    long_ = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long_), (2, "Short item, five WORDS!"), (3, None), (4, ""), (None, "no key here at all for this one item of the list"), (5, "solo"), (6, " ".join(f"w{i}" for i in range(9))), (10, long_), (7, "a a a a a a a a a a a a")]
    return rows, spark.createDataFrame(rows, ITEM)


def test_planted_cases_against_brute_force(spark, items):
    rows, frame = items
    w = [f"w{i}" for i in range(40)]
    docs = [
        (1, " ".join(["x"] * 5 + w[3:13] + ["y"])),
        (2, " ".join(["x"] + w[3:12] + ["y"])),
        (3, " ".join(w[i] for i in range(0, 40, 2))),
        (4, "here is a short ITEM five words indeed, and solo"),
        (5, " ".join(w + w[::-1] + w[5:30])),
        (6, " ".join(w[:9])),
        (7, None),
        (8, "a " * 30),
        (9, " ".join(w[:20] + ["cut"] + w[20:])),
        (10, "-".join(w[10:25])),
    ]
    got = {r["doc_id"]: tuple(r)[1:] for r in winnow.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), frame).collect()}
    want = {d[0]: p for d, p in zip(docs, plain(docs, rows))}
    assert got == want and want[1][1] == 10 and want[2][1] == 0


def test_against_brute_force_on_the_tables(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "benchmark"))
    got = {r["doc_id"]: tuple(r)[1:] for r in winnow.op5_decontamination(docs, bench).collect()}
    d = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain(d, [(r["item_id"], r["text"]) for r in bench.collect()])
    assert got == {k[0]: p for k, p in zip(d, want)} and any(p[4] for p in want)


def test_odd_rows(spark, items):
    rows, frame = items
    got = winnow.decontaminate(odd(spark, ["n_hit", "item_id", "same"]), frame).collect()
    assert len(got) == 12 and {r["n_words"] for r in got if r["doc_id"] in (2, 3, 4)} == {0}
    assert winnow.decontaminate(empty(spark), frame).count() == 0
    clean = winnow.decontaminate(odd(spark), spark.createDataFrame([], ITEM)).collect()
    assert len(clean) == 12 and not any(r["contaminated"] for r in clean)
    assert {r["items_sha256"] for r in clean} == {hashlib.sha256(b"").hexdigest()}
