import numpy as np
import pytest
import xxhash

from ranksmith.llm import simhash
from ranksmith.llm.components import components

from .helpers import empty, odd, words


def plain_fingerprint(t):
    w = words(t)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """key -> smallest key reachable over distances of at most 2; fps: list of (key, fingerprint)."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    f = np.array([x for _, x in fps], np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 2):
            parent[find(i)] = find(int(j))
    groups = {}
    for i, (k, _) in enumerate(fps):
        if k is not None:
            groups[find(i)] = min(groups.get(find(i), k), k)
    return [groups.get(find(i)) for i in range(len(fps))]


def test_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fps = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    want = {k: (f"{f:016x}", c) for (k, f), c in zip(fps, plain_components(fps))}
    assert got == want


def test_odd_rows(spark):
    rows = simhash.near_duplicates(odd(spark, ["fp", "component_id", "fingerprint"])).collect()
    assert len(rows) == 12
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    assert by[2] == by[3] == by[4] == {("0" * 16, 2)}
    assert by[1] == by[6] == by[7] and {c for _, c in by[1]} == {1}  # case and spacing play no part
    assert by[5] == by[10]
    assert simhash.near_duplicates(empty(spark)).count() == 0
    stay = simhash.first_of_each_group(odd(spark))
    # A row without a key stays: no key names it as the copy of another.
    assert sorted((r["doc_id"] for r in stay.collect()), key=str) == [1, 2, 5, 8, 9, None] and stay.columns == odd(spark).columns


def test_every_close_pair_meets_at_an_anchor():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 200, dtype=np.uint64)
    for distance in (0, 1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, distance, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        wx, ax = simhash.anchors(x)
        wy, ay = simhash.anchors(y)
        for i in range(len(x)):
            assert set(ax[wx == i].tolist()) & set(ay[wy == i].tolist())
        assert np.bincount(wx).max() <= 33


@pytest.mark.parametrize("seed", [0, 1])
def test_links_of_planted_clusters(spark, seed):
    """Chains and balls of close fingerprints among random ones: components as brute force finds them."""
    rng = np.random.default_rng(seed)
    fps = set(rng.integers(0, 1 << 63, 150).tolist())
    for _ in range(6):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(40):
            fps.add(x)
            for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
                x ^= 1 << int(b)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(5)
    root = {r["node"]: r["root"] for r in components(simhash.links(frame)).collect()}
    want = plain_components([(i, f % (1 << 64)) for i, f in enumerate(signed)])
    got = {}
    for f, c in zip(signed, want):
        got.setdefault(c, set()).add(root.get(f, f))
    assert all(len(v) == 1 for v in got.values()) and len({next(iter(v)) for v in got.values()}) == len(got)


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3), (7, 8), (8, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[1000 + i] for i in range(200)}) == 1
    assert got[0] != got[1000] and len(got) == 501
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_radius_plus_whole_threshold_finds_the_same_links(spark):
    rng = np.random.default_rng(7)
    fps = set(rng.integers(0, 1 << 63, 20).tolist())
    for x in list(fps)[:10]:
        for _ in range(3):
            for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(3)
    half, whole = ({}, {})
    for got, reach in ((half, 1), (whole, 2)):
        for r in components(simhash.links(frame, reach)).collect():
            got.setdefault(r["root"], set()).add(r["node"])
    assert half and sorted(map(sorted, half.values())) == sorted(map(sorted, whole.values()))
    which, anchor = simhash.anchors(np.array([12345], np.uint64), 2)
    assert set(simhash.anchors(np.array([12345], np.uint64))[1].tolist()) < set(anchor.tolist()) and len(anchor) > 600
