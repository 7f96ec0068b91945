import re

import pytest

from panelwright.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            if (g := tuple(w[s : s + n])) in seen:
                gone[s : s + n] = [True] * n
            seen.add(g)
        out[i] = (len(w), sum(gone), [x for x, y in zip(w, gone, strict=True) if not y])
    return out


@pytest.mark.parametrize("n,batch", [(20, 32 << 20), (20, 900), (13, 5000)])
def test_removal_matches_brute_force(docs, prose, monkeypatch, n, batch):
    monkeypatch.setattr(substrings, "BATCH_BYTES", batch)
    monkeypatch.setattr(substrings, "RANGE_BYTES", 4 * batch)
    got = {r.doc_id: (r.n_words, r.n_removed, WORD.findall(r.kept_text)) for r in substrings.remove_repeats(docs, n).collect()}
    assert got == brute(prose, n)
    assert sum(x[1] > 0 for x in got.values()) > 10


def test_cover_is_a_difference_cover():
    for d in range(substrings.PERIOD):
        assert any((a + d) % substrings.PERIOD in substrings.COVER for a in substrings.COVER)


def test_edges(frame):
    line = " ".join(map(str, range(25)))
    rows = [(None, line), (1, f"{line}\nmore"), (2, "same text"), (2, "same text"), (3, line), (3, line), (4, None), (5, ""), (6, "word " * 50_000)]
    df = frame(rows).selectExpr("doc_id", "text", "7 as id", "8 as key", "9 as at", "'z' as row")
    out = substrings.remove_repeats(df, carry=("id", "row")).collect()
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text, r.row.id, r.row.row) for r in out)
    assert got == [(0, 25, 0, line, 7, "z"), (1, 26, 25, "more", 7, "z"), *[(2, 2, 0, "same text", 7, "z")] * 2, *[(3, 25, 25, "", 7, "z")] * 2, (4, 0, 0, "", 7, "z"), (5, 0, 0, "", 7, "z"), (6, 50_000, 49_999, "word ", 7, "z")]
    assert substrings.remove_repeats(frame([])).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(df, length=5)
