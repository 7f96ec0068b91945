import random
import re

import pytest

from panelwright.llm.decontaminate import Automaton, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, n):
    doc, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        if name is None:
            continue
        for g in [w[i : i + n] for i in range(len(w) - n + 1)] if len(w) >= n else [w] if w else []:
            for s in range(len(doc) - len(g) + 1):
                if doc[s : s + len(g)] == g:
                    hit |= set(range(s, s + len(g)))
                    names.add(str(name))
    return len(doc), len(hit), sorted(names)


@pytest.mark.parametrize("block_words", [200_000, 60])
def test_hits_match_brute_force(spark, docs, prose, block_words):
    rng = random.Random(2)
    items = []
    for k in range(30):
        source = words(rng.choice(prose)[1]) or ["nothing"]
        at = rng.randrange(len(source))
        items.append((k, " ".join(source[at : at + rng.randint(1, 25)]).upper()))
    items += [(90, None), (91, ""), (92, "..."), (None, "one"), (1, items[1][1]), (93, "never in any text at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.clean_text) for r in decontaminate(docs, bench, 10, block_words=block_words).collect()}
    for i, t in prose:
        n, hit, names = brute(t, items, 10)
        assert got[i][:3] == (n, hit, names)
        assert len(words(got[i][3])) == n - hit
        if not hit:
            assert got[i][3] == (t or "")


def test_edges(spark, frame):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    rows = [(None, "x A b c d e f g h i j, y"), (1, None), (1, ""), (2, "a b " * 60_000)]
    df = frame(rows).selectExpr("doc_id", "text", "1 as hits", "2 as items", "3 as n_words")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.longest, r.clean_text[:9], r.row.hits) for r in decontaminate(df, bench, carry=("hits",)).collect())
    assert got == [(0, 12, 10, 10, "x y", 1), (1, 0, 0, 0, "", 1), (1, 0, 0, 0, "", 1), (2, 120_000, 0, 0, "a b a b a", 1)]
    assert decontaminate(frame([]), bench).count() == 0
    assert [r.n_hit for r in decontaminate(frame([(1, "a b")]), bench.limit(0)).collect()] == [0]


def test_automaton_tracks_longest_matches():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.choice([2, 3, 4])
        items = [(str(k), [rng.randrange(3) for _ in range(rng.randrange(9))]) for k in range(rng.randrange(1, 6))]
        known = {x for _, w in items for x in w}
        doc = [x for x in (rng.randrange(3) for _ in range(30)) if x in known]
        a = Automaton(items, n)
        for at, length, _, _ in a.scan(doc):
            assert length == max(m for m in range(at + 2) if not m or any(w[i : i + m] == doc[at + 1 - m : at + 1] for _, w in items for i in range(len(w) - m + 1)))
