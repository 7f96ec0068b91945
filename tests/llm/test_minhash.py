import re

import numpy as np
import pytest

from panelwright.llm import minhash
from panelwright.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize("n,percent,block", [(3, 85, 512), (5, 80, 6)])
def test_groups_match_brute_force(docs, prose, monkeypatch, n, percent, block):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, n, percent).collect()}
    assert got == brute(prose, n, percent)
    assert sum(not x[2] for x in got.values()) > 5


def test_edges(frame, spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (4, "word " * 60_000), (5, "word " * 60_000)]
    extra = frame(rows).selectExpr("doc_id", "text", "1 as component_id", "'x' as keys", "2 as doc")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(extra, 3, 85).collect())
    assert got == [(0, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False)]
    assert minhash.near_duplicates(frame([]), 3, 85).count() == 0


def test_circulant_coordinates_use_two_permutations():
    values = np.array([3, 9, 27], np.uint64)
    sig = minhash.signatures(values, np.array([0, 2, 2, 3]), 4)
    place = (minhash.T.mix(values ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    for k in range(4):
        turned = minhash._pi(place + np.uint32(k))
        assert sig[k].tolist() == [min(turned[0], turned[1]), 0xFFFFFFFF, turned[2]]


def test_missing_a_link_is_improbable():
    for percent in (80, 85):
        rows, bands = minhash.plan(percent / 100)
        assert (1 - (percent / 100) ** rows) ** bands <= minhash.MISS


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200), (None, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}
    assert components(df.limit(0)).count() == 0
