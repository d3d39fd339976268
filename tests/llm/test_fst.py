import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ranksmith.llm import fst, kernel

from .helpers import empty, odd, thue_morse

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = ["", "a", " ", "  ", "\n", "\n\n x", "it's we'll I'd they're you've 'tis 'S ''s !'s 's's 'r 're 'rx 'l 'll 'lx 'v", "x'r", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>  <|endoftext|>", "  <|endoftext", "日本語テキスト 123abc", "  x \t y  \r\n z ", "😀😀 a😀b", "a" * 5000, " " * 3000, " '", "\x85a", "½ ² x²", "\x00\x01", " a　b"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ours(texts):
    return np.concatenate([fst.counter(PATH).counts(p) for p in kernel.slices(pa.array(texts, pa.large_string()))]).tolist()


def theirs(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts(library):
    assert ours(ODD_TEXTS) == theirs(library, ODD_TEXTS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=" \n\t'strevmldA1!é日 |<>", max_size=60), st.text(max_size=40).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t))), min_size=1, max_size=6))
def test_any_texts(library, texts):
    assert ours(texts) == theirs(library, texts)


def test_table(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in fst.op8_token_counts(docs).collect()}
    rows = docs.collect()
    want = theirs(library, [r["text"] or "" for r in rows])
    assert got == {r["doc_id"]: (len((r["text"] or "").encode()), n, n > 512) for r, n in zip(rows, want)}


def test_odd_rows(spark, library):
    rows = odd(spark, ["n_tokens"]).collect()
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in fst.op8_token_counts(odd(spark, ["n_tokens"])).collect())
    want = theirs(library, [r["text"] or "" for r in rows])
    assert got == sorted((r["doc_id"] or -1, n) for r, n in zip(rows, want))
    assert fst.op8_token_counts(empty(spark)).count() == 0


def test_scan_composes_maps():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 11, (50, 11)).astype(np.uint8)
    state, want = 4, []
    for m in maps:
        state = m[state]
        want.append(state)
    assert fst.scan(maps)[:, 4].tolist() == want


def test_chunked_marks_equal_one_run():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 12, 5000).astype(np.uint8)
    state, begins = 0, np.zeros(5000, bool)
    for i, c in enumerate(symbols):
        m = fst.MARK[state, c]
        if m & fst.HERE:
            begins[i] = True
        if m & fst.BEFORE:
            begins[i - 1] = True
        state = fst.NEXT[state, c]
    got = fst.pretoken_marks(np.append(symbols, fst.END))[:5000]
    edge = state in (7, 8, 9)
    assert np.array_equal(got[:-1], begins[:-1]) or edge


def test_states_are_bounded(library):
    small = fst.Counter.load(PATH)
    small.most_states = 50
    texts = ["some words here to compile states for", "other words, quite different ones 12345"] * 3
    assert [int(small.counts(p)[0]) for t in texts for p in kernel.slices(pa.array([t], pa.large_string()))] == theirs(library, texts)


def test_words_of_one_hash_are_counted_apart(library, monkeypatch):
    pair = [*thue_morse(10), *thue_morse(11), " ".join(thue_morse(10))]
    assert ours(pair) == theirs(library, pair) and len(set(theirs(library, pair)[:2])) == 2
    texts = ["some words of one length: cats dogs cows pigs", "cats pigs\ncows   dogs 1234 5678 é日"]
    monkeypatch.setattr(kernel, "content_hash", lambda data, start, end, parts=None: (end - start).astype(np.uint64))
    assert ours(texts * 2) == theirs(library, texts * 2)


def test_a_change_beyond_a_transition_is_an_error(monkeypatch):
    """A token of 35 pieces whose prefix of 34 letters has 34 tokens counts right; beyond the field it is refused."""
    letters = [bytes([b]) for b in range(65, 100)]
    merges = [(letters[33], letters[34])]
    for i in range(32, -1, -1):
        merges.append((letters[i], merges[-1][0] + merges[-1][1]))
    bpe, word = fst.Bpe(merges), b"".join(letters)
    assert bpe.count(word[:34]) == 34 and bpe.count(word) == 1
    monkeypatch.setattr(fst, "MOST_CHANGE", 32)
    with pytest.raises(ValueError, match="changes the count"):
        fst.Bpe(merges).count(word)
