"""Strings that collide under polynomial hashes modulo 2**64 stay apart."""

import numpy as np
import pytest

from knotwork.llm import quality, substring
from knotwork.llm.jaccard import classes
from knotwork.llm.shared import Segments, gram_hashes, run_hashes

MORSE = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
OTHER = MORSE.translate(str.maketrans("ab", "ba"))


def test_words_and_lines():
    raw = np.frombuffer(f"{MORSE} {OTHER} {MORSE}".encode(), np.uint8)
    for which in (0, 1):
        a, b, c = Segments(raw, np.array([0, len(raw)])).word_hashes(which)
        assert a == c != b
    text = f"{MORSE} x\n{OTHER} x\n"
    raw = np.frombuffer(text.encode(), np.uint8)
    assert quality.measure(raw, np.array([0, len(raw)]))["n_dup_lines"].tolist() == [0]


@pytest.mark.parametrize("width", [1, 2, 3, 5, 25, 50, 64])
def test_grams_are_equal_where_their_words_are(width):
    rng = np.random.default_rng(width)
    words = rng.integers(0, 2, 400, dtype=np.uint64) + np.uint64(7)
    first = np.arange(400 - width + 1)
    found, seen = gram_hashes(words, first, width), {}
    for k, h in zip(first, found, strict=True):
        assert seen.setdefault(tuple(words[k : k + width]), h) == h
    assert len(set(seen.values())) == len(seen)
    # words in the pattern of the string above, and its complement
    pattern = np.frombuffer((MORSE + OTHER).encode(), np.uint8).astype(np.uint64)
    assert len(set(gram_hashes(pattern, np.array([0, 2048]), 2048).tolist())) == 2
    assert len(run_hashes(np.zeros(0, np.uint8), first[:0], first[:0])) == 0


def test_operators_tell_them_apart(spark):
    fill = " ".join(f"w{k}" for k in range(30))
    data = [(1, MORSE), (2, OTHER), (3, f"{fill} {MORSE} {fill}"), (4, f"{fill} {OTHER} {fill}")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert {r[0]: r[2] for r in classes(docs, 3, 90).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    out = {r["doc_id"]: r["n_removed"] for r in substring.removed(docs).collect()}
    assert out == {1: 0, 2: 0, 3: 0, 4: 0}
