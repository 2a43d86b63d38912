import random

import numpy as np
import pyarrow as pa

from tagloom.llm.words import ALNUM_PARTED, BLANK_PARTED, pieces, shingle_hashes, word_hashes
from tests.llm import helpers


def all_shingles(texts, piece_limit=None):
    out = []
    for _, _, data, offsets in pieces(pa.array(texts, type=pa.string())):
        words, bounds = word_hashes(data, offsets, BLANK_PARTED)
        s, b = shingle_hashes(words, bounds, 5)
        out += [s[x:y] for x, y in zip(b[:-1], b[1:], strict=True)]
    return out


def test_equal_shingles_have_equal_hashes_and_others_differ():
    texts = [t for _, t in helpers.corpus(random.Random(3))]
    hashes = all_shingles(texts)
    by_shingle, by_hash = {}, {}
    for text, found in zip(texts, hashes, strict=True):
        w = helpers.words(text)
        runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)
        assert len(runs) == len(found)
        for run, h in zip(runs, map(int, found), strict=True):
            assert by_shingle.setdefault(run, h) == h
            assert by_hash.setdefault(h, run) == run


def test_a_row_does_not_run_into_the_next(monkeypatch):
    monkeypatch.setattr("tagloom.llm.words.PIECE", 64)
    whole = all_shingles(["a b c d", "e f", "", None, "g" * 200, "ab", "c"])
    apart = [all_shingles([t])[0] for t in ["a b c d", "e f", "", None, "g" * 200, "ab", "c"]]
    assert [list(x) for x in whole] == [list(x) for x in apart]


def test_slices_and_other_separators():
    array = pa.array(["x", "a-b, C", "y"]).slice(1, 1)
    (_, _, data, offsets), = pieces(array)
    words, bounds = word_hashes(data, offsets, ALNUM_PARTED)
    assert list(bounds) == [0, 3]
    (_, _, data, offsets), = pieces(pa.array(["c b a"]))
    other, _ = word_hashes(data, offsets, ALNUM_PARTED)
    assert list(words) == list(other[::-1])
    assert len(np.unique(words)) == 3
