import re

import numpy as np
import pyarrow as pa

from panelwright.llm import tokens as T

WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def _words(texts, monkeypatch=None):
    data, at = T.buffers(pa.array(texts, pa.string()))
    return data, at, T.words_of(data, at, T.Alphabet(T.WHITE, True))


def test_words_match_the_pattern_across_blocks(monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 7)
    texts = ["a bb  ccc", None, "", "abcdefghijklmnop qr", " lead", "tail ", "x", "y", "ü\x0b漢 字"]
    data, at, w = _words(texts)
    for k, t in enumerate(texts):
        got = [bytes(data[a:b]).decode() for a, b in zip(w.begin[w.first[k] : w.first[k + 1]], w.end[w.first[k] : w.first[k + 1]], strict=True)]
        assert got == WHITE.findall(t or "")


def test_hashes_follow_words_not_places(monkeypatch):
    _, _, a = _words(["One two one", "two ONE"])
    assert a.hash[0] == a.hash[2] == a.hash[4] and a.hash[1] == a.hash[3] and a.hash[0] != a.hash[1]
    monkeypatch.setattr(T, "BLOCK", 3)
    _, _, b = _words(["One two one", "two ONE"])
    assert (a.hash == b.hash).all()


def test_windows_and_sets():
    _, _, w = _words(["a b c a b c", "b c", "", "a b c d"])
    value, whole = T.windows(w, 3)
    assert whole.tolist() == [True] * 4 + [False] * 4 + [True] * 2
    assert value[0] == value[3] == value[8]
    values, first = T.sets_of(w, 3)
    assert np.diff(first).tolist() == [3, 1, 0, 2]
    assert all((np.diff(values[first[k] : first[k + 1]].astype(float)) > 0).all() for k in range(4))
