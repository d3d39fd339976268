import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ranksmith.llm import gru, kernel

from .helpers import empty, odd, thue_morse, words


def plain_base(rows):
    tokens = [(k, words(t) + [None]) for k, t in rows]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0 for k, _ in tokens]
    c = collections.Counter(w for h, (_, t) in zip(held, tokens) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(k, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for h, (k, t) in zip(held, tokens)]


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


def test_base_scores_against_counting(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = [tuple(r) for r in gru.op6_lm_scoring(docs).collect()]
    compare(got, plain_base([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert all(r[6] < 0 for r in got)


def test_rare_words_are_joined(spark, small, monkeypatch):
    """With a small head most counts come from the join; the base stays exact and the model a distribution."""
    monkeypatch.setattr(gru, "MOST_HEAD", 50)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = [tuple(r) for r in gru.op6_lm_scoring(docs).collect()]
    compare(got, plain_base([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_the_model_beats_the_base_on_held_out_text(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    rows = gru.op6_lm_scoring(docs).where("held_out").toPandas()
    assert rows.score.sum() > rows.base_score.sum()


def test_odd_rows(spark):
    rows = odd(spark, ["score", "hash", "c"]).collect()
    got = [tuple(r) for r in gru.op6_lm_scoring(odd(spark, ["score", "hash", "c"])).collect()]
    compare(got, plain_base([(r["doc_id"], r["text"]) for r in rows]))
    assert gru.op6_lm_scoring(empty(spark)).count() == 0


def test_the_network_learns_from_every_training_document(spark, small, monkeypatch):
    """The tokens the weights are averaged by are all those outside the held-out fold."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    weights, mean = [], gru._tree_mean
    monkeypatch.setattr(gru, "_tree_mean", lambda parts, n: (weights.append(sum(r["weight"] for r in parts.collect())), mean(parts, n))[1])
    net, _ = gru.fit(docs)
    assert weights == [net.lexicon.tokens] and net.lexicon.tokens > 0


def tokens(texts):
    return gru.Tokens.of(list(kernel.slices(pa.array(texts, pa.large_string()))))


def plain_score(text, net, c):
    """One token after the other, in double precision: gates, class, word in its class; counts of rare words from c."""
    lex, w, H = net.lexicon, {k: v.astype(np.float64) for k, v in net.w.items()}, gru.HIDDEN
    number = {lex.data[a:b].tobytes(): i for i, (a, b) in enumerate(zip(lex.offsets[:-1], lex.offsets[1:], strict=True))}
    sigmoid, softmax = lambda x: 1 / (1 + np.exp(-x)), lambda x: np.exp(x) / np.exp(x).sum()
    h, total = np.zeros(H), 0.0
    for word in [t.encode() for t in words(text)] + [b""]:
        i, classes = number.get(word), softmax(h @ w["Wc"] + w["bc"])
        if i is None:
            p, x = classes[gru.RARE] * (c[word] + 0.1) / lex.rare_mass, w["X"][gru.WORDS + gru.BANDS]
        elif i < gru.WORDS:
            k, place = divmod(i, gru.PER_CLASS)
            p, x = classes[k] * softmax(h @ w["Wo"][k] + w["bo"][k])[place], w["X"][i]
        else:
            octave = min(int(math.log2(lex.counts[i])), gru.BANDS - 1)
            alike = [n for j, n in enumerate(lex.counts.tolist()) if j >= gru.WORDS and min(int(math.log2(n)), gru.BANDS - 1) == octave]
            p, x = classes[gru.CLASSES + octave] * (lex.counts[i] + 0.1) / (sum(alike) + 0.1 * len(alike)), w["X"][gru.WORDS + octave]
        total += math.log10(p)
        u = h @ w["U"]
        r, z = sigmoid(x[:H] + u[:H]), sigmoid(x[H : 2 * H] + u[H : 2 * H])
        h = z * h + (1 - z) * np.tanh(x[2 * H :] + r * u[2 * H :])
    return total


def test_scores_against_one_token_at_a_time(spark, small, monkeypatch):
    monkeypatch.setattr(gru, "MOST_HEAD", 3000)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    net, counts = gru.fit(docs)
    assert gru.WORDS < len(net.lexicon.counts) < net.lexicon.types
    got = {r["doc_id"]: r["score"] for r in gru.score(docs, net, counts).collect()}
    c = collections.Counter({bytes(r["word"]): r["c"] for r in counts.collect()})
    for r in docs.collect():
        if len(r["text"] or "") < 3000:
            assert got[r["doc_id"]] == pytest.approx(plain_score(r["text"], net, c), rel=1e-4)


def test_words_of_one_hash_stay_apart(spark, monkeypatch):
    """With a hash that gives all words of a length the same value, and with words whose polynomial hashes are equal, counts
    and scores are those of the words' bytes."""
    a, b = thue_morse(10)
    rows = [(i, f"{a} {b} {a} short words here and there {'x' * 70} {'y' * 70}"[: 90 + 200 * i], "en", "s", 1) for i in range(12)] + [(12, b, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    compare([tuple(r) for r in gru.op6_lm_scoring(docs).collect()], plain_base([(r[0], r[1]) for r in rows]))
    monkeypatch.setattr(kernel, "content_hash", lambda data, start, end, parts=None: (end - start).astype(np.uint64))
    t = tokens([r[1] for r in rows])
    spelled = [[t.data[t.start[i] : t.end[i]].tobytes().decode() for i in ids] for ids in np.split(t.ids, np.cumsum(t.counts)[:-1])]
    assert spelled == [words(r[1]) + [""] for r in rows] and len({t.data[x:y].tobytes() for x, y in zip(t.start, t.end, strict=True)}) == len(t.start)
    lex = gru.Lexicon.of({w.encode(): 5 - i % 3 for i, w in enumerate(sorted({x for r in spelled for x in r})) if i % 2 == 0}, 99, 20)
    at = gru.Head(lex).find(t)
    for i, (x, y) in enumerate(zip(t.start, t.end, strict=True)):
        mine = [j for j in range(len(lex.counts)) if lex.data[lex.offsets[j] : lex.offsets[j + 1]].tobytes() == t.data[x:y].tobytes()]
        assert at[i] == (mine[0] if mine else -1)


def lexicon(v=40):
    rng = np.random.default_rng(0)
    c = {b"": 50} | {f"w{i}".encode(): int(n) for i, n in enumerate(rng.integers(1, 100, v - 1))}
    return gru.Lexicon.of(c, sum(c.values()) + 30, v + 12)


def test_it_is_a_distribution():
    """Over the head words, the rare ones (12 of count 30 in all) and one unseen word."""
    lex = lexicon()
    net = gru.Network(lex)
    rng = np.random.default_rng(1)
    net.w["Wc"] = rng.standard_normal(net.w["Wc"].shape).astype(np.float32)
    net.w["Wo"] = rng.standard_normal(net.w["Wo"].shape).astype(np.float32)
    h = np.repeat(rng.standard_normal((1, gru.HIDDEN)).astype(np.float32), len(lex.counts) + 1, axis=0)
    cls = np.append(lex.cls, gru.RARE)
    got, _ = net.output(h, cls, np.append(lex.place, 0))
    inner = np.append(np.where(lex.listed, 0.0, lex.within * math.log(10)), 0.0)
    assert np.exp(got + inner).sum() == pytest.approx(1, abs=1e-4)
    assert lex.rare_mass == pytest.approx(30 + 0.1 * 13)


def test_gradients_are_those_of_the_loss():
    """One window of one lane: the Adagrad accumulators hold the squared gradients, checked by differences."""
    lex = lexicon()
    rng = np.random.default_rng(2)
    block = gru.Block.of(tokens([" ".join([*(f"w{i}" for i in rng.integers(0, 39, 10)), "unheard"])]), lex, gru.Head(lex))
    assert len(block.head) == 12 and (block.head < 0).sum() == 1
    net = gru.Network(lex)
    for k in net.w:
        net.w[k] = (net.w[k].astype(np.float64) + 0.3 * rng.standard_normal(net.w[k].shape)).astype(np.float32)
    start = {k: v.copy() for k, v in net.w.items()}

    def loss(w):
        n = gru.Network(lex, {k: v.astype(np.float64) for k, v in w.items()})
        h, total = np.zeros((1, gru.HIDDEN)), 0.0
        for t in range(12):
            total -= n.output(h, block.cls[[t]], block.place[[t]])[0][0]
            h = n.step(h, block.input[[t]])[0]
        return total / 12

    state = {k: np.zeros_like(v) + 1e-30 for k, v in net.w.items()}
    gru.train_block(net, block, state)
    for k in net.w:
        flat = np.argsort(-state[k].ravel())[:4]
        for i in flat:
            w = {n: v.astype(np.float64).copy() for n, v in start.items()}
            step = 1e-4
            w[k].ravel()[i] += step
            up = loss(w)
            w[k].ravel()[i] -= 2 * step
            slope = (up - loss(w)) / (2 * step)
            assert abs(slope) == pytest.approx(math.sqrt(state[k].ravel()[i]), rel=2e-2), k


def test_lanes_and_windows_do_not_change_a_score():
    lex, rng = lexicon(), np.random.default_rng(4)
    head, net = gru.Head(lex), gru.Network(lex)
    net.w["Wc"] = rng.standard_normal(net.w["Wc"].shape).astype(np.float32)
    counts = np.array([3, 200, 1, 70, 5])
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 45, n - 1)) for n in counts]
    together = gru.score_block(net, gru.Block.of(tokens(texts), lex, head))
    at = 0
    for n, text in zip(counts, texts, strict=True):
        alone = gru.score_block(net, gru.Block.of(tokens([text]), lex, head))
        assert len(alone) == n and np.allclose(alone, together[at : at + n], atol=1e-4)
        at += n


def test_training_lanes_take_every_token_once():
    for counts in ([1], [5, 3], [1000, 1, 1, 700], [40] * 900):
        counts = np.array(counts)
        lanes = gru.Lanes.even(counts, gru.TRAIN_LANES)
        seen = np.concatenate([t for steps in lanes.windows(gru.WINDOW) for t in steps])
        assert sorted(seen.tolist()) == list(range(counts.sum())) and np.ptp(lanes.length) <= 1
        assert np.flatnonzero(lanes.first).tolist() == (np.cumsum(counts) - counts).tolist()


def test_head_lookup():
    lex = gru.Lexicon.of({f"word{i}".encode(): 3 for i in range(5000)}, 15000, 5000)
    found = gru.Head(lex).find(tokens([" ".join(f"word{i}" for i in range(0, 10000, 7))]))
    t = tokens([" ".join(f"word{i}" for i in range(0, 10000, 7))])
    spelled = [t.data[a:b].tobytes() for a, b in zip(t.start, t.end, strict=True)]
    assert [lex.data[lex.offsets[i] : lex.offsets[i + 1]].tobytes() if i >= 0 else None for i in found] == [w if w and int(w[4:]) < 5000 else None for w in spelled]
    assert gru.Head(gru.Lexicon.of({}, 0, 0)).find(t).tolist() == [-1] * len(spelled)


def test_inputs_are_short_numbers_and_score_blocks_larger():
    """Two-byte inputs are sorted by radix; a scored block takes as many steps as its longest text, so it holds more texts."""
    lexicon = gru.Lexicon.of({b"a": 5, b"b": 3, gru.END: 2}, 10, 3)
    assert lexicon.input.dtype.itemsize == 2 and gru.WORDS + gru.BANDS < 1 << 15 and gru.SCORE_BYTES > gru.BLOCK_BYTES
