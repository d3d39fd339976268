"""First pairs by md5 against sorting all pairs by hashlib."""

import hashlib

import numpy as np
import pytest

from ranksmith.functions import digests


@pytest.mark.parametrize("size, most", [(1, 300), (7, 300), (25, 300), (26, 50), (90, 3)])
def test_first_pairs(size, most, monkeypatch):
    monkeypatch.setattr(digests, "CHUNK", 500)
    rng = np.random.default_rng(size)
    texts = [("é" * (i % 3) + str(10**int(rng.integers(0, size))))[:size].encode() for i in range(120)]
    grade = rng.integers(0, 4, 120)
    all_ = [(hashlib.md5(b"0|" + texts[i] + b"|" + texts[j]).hexdigest(), texts[i], texts[j]) for i in range(120) for j in range(120) if grade[i] > grade[j]]
    i, j = digests.first_pairs(b"0|", texts, grade, most)
    assert len(set(zip(i.tolist(), j.tolist()))) == most
    assert sorted((hashlib.md5(b"0|" + texts[x] + b"|" + texts[y]).hexdigest(), texts[x], texts[y]) for x, y in zip(i, j)) == sorted(all_)[:most]


def test_few_pairs_are_all_kept():
    assert sorted(zip(*(x.tolist() for x in digests.first_pairs(b"0|", [b"a", b"b", b"c"], np.array([0, 2, 0]), 2)))) == [(1, 0), (1, 2)]
    assert all(len(x) == 0 for x in digests.first_pairs(b"0|", [], np.zeros(0, int), 5))
