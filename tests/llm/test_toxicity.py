import random

import numpy as np

from panelwright.llm import toxicity


def test_folding():
    assert toxicity.folded("a55 cl0wn5 x2024 42") == " ass clowns x2024 42 "
    assert toxicity.folded("An 1D10T, а МОRОN; cl0wn! Çà ｔｒａｓｈ 5tup1d 2024 áb") == " an idiot a moron clown ca trash stupid 2024 ab "


def make(rng, n, bad):
    words = [rng.choice("river stone cloud meadow table winter garden letter copper basket window candle".split()) + rng.choice(["", "s", "ing"]) for _ in range(n)]
    for _ in range(bad):
        words[rng.randrange(n)] = rng.choice(["zorgal", "Z0RG4L", "grimpf" + rng.choice(["en", "lich", "ato"]), "vlumid"])
    return " ".join(words)


def rows(seed, n=600):
    rng = random.Random(seed)
    return [(k, make(rng, rng.randint(20, 200), rng.randint(2, 6) if k % 8 == 0 else 0) + (" my zorgal lamp" if k % 8 == 1 else ""), int(k % 8 == 0)) for k in range(n)]


def test_held_out_rows_are_told_apart(spark):
    train = spark.createDataFrame(rows(1), "doc_id long, text string, toxic int")
    model = toxicity.fit(train.drop("toxic"), train)
    assert " vlumid " in model.terms and any(" grimpf".startswith(t) for t in model.terms)
    test = rows(2, 400)
    df = spark.createDataFrame([(i, t) for i, t, _ in test], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    caught = sum(got[i].predicted for i, _, y in test if y)
    false = sum(got[i].predicted for i, _, y in test if not y)
    assert caught >= 0.9 * sum(y for *_, y in test) and false <= 4
    assert toxicity.fit(train.drop("toxic"), train).slope == model.slope


def test_exception_phrases_spare_hits():
    model = toxicity.Model({" trash ": 3.0, " grimpf": 2.0}, ("trash can",), (0.0,) * 3, (1.0,) * 3, (1.0, 0.0, 0.0), -1.0)
    m = model.matcher()
    hit = lambda t: model.features(m, toxicity.folded(t))[0]
    assert hit("a trash can here") == 0 and hit("trash") > 0 and hit("Grimpflich") > 0 and hit("my grimp") == 0 and hit("xgrimpf") == 0
    assert hit("trash trash can trash") > hit("trash can trash") > 0


def test_features_match_a_plain_search():
    """Aho-Corasick against trying every term and every phrase at every place."""
    rng = random.Random(9)
    terms = {" trash ": 3.0, " gri": 2.0, " grimm ": 1.5, " ab": 0.5, " a ": 0.25}
    model = toxicity.Model(terms, ("trash can", "a grimm", "grimmig"))
    matcher = model.matcher()
    for _ in range(300):
        text = toxicity.folded(" ".join(rng.choice(["trash", "can", "a", "grimm", "grimmig", "abc", "xab", "Gr1m", "tr4sh"]) for _ in range(rng.randrange(12))))
        total = 0.0
        for term, weight in terms.items():
            for at in range(len(text)):
                if text.startswith(term, at):
                    held = any(text.startswith(f" {p} ", b) and b <= at and at + len(term) <= b + len(p) + 2 for p in model.exceptions for b in range(len(text)))
                    total += 0 if held else weight
        n = len(text.split())
        assert model.features(matcher, text) == (float(np.log1p(total)), min(20.0, 100 * total / max(n, 10)), float(np.log1p(n)))


def test_all_terms_beyond_chance_are_kept(spark):
    """More different terms than any round number, none cut; of terms that begin alike the first stays."""
    bad = [f"{a}{b}rk" for a in ("zo", "qu", "wy", "xa", "vu", "ky", "ju", "hi", "pf", "gn") for b in ("bna", "cle", "dmi", "fto", "glu", "hra", "jne", "kli", "lpo", "mqu", "ndi", "pse", "rwa", "sto", "tvi", "vbe", "wna", "xly", "yro", "zdu", "bko", "cmi", "dru", "fwe", "gha", "hty", "jso", "knu", "lva", "mbe", "nco", "pdi")]
    rng = random.Random(1)
    rows = [(k, make(rng, 30, 0) + " " + " ".join(bad) if k % 2 else make(rng, 350, 0), k % 2) for k in range(400)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(train.drop("toxic"), train)
    assert len(bad) == 320 and all(any(f" {w} ".startswith(t) for t in model.terms) for w in bad)
    assert toxicity.furthest([(" abc", 1.0), (" ab", 2.0), (" abcd ", 3.0), (" b ", 4.0), (" bc", 5.0)]) == {" abc": 1.0, " b ": 4.0}


def test_repeated_ids_count_once(spark):
    train = spark.createDataFrame(rows(1), "doc_id long, text string, toxic int")
    docs = train.drop("toxic")
    assert toxicity.fit(docs.unionByName(docs), train) == toxicity.fit(docs, train)


def test_edges(spark, frame):
    train = spark.createDataFrame(rows(1), "doc_id long, text string, toxic int")
    model = toxicity.fit(train.drop("toxic"), train)
    out = toxicity.score(frame([(None, None), (1, ""), (1, ""), (2, "vlumid " * 50_000), (3, "...")]).selectExpr("doc_id", "text", "1 as score", "0 as predicted"), model).collect()
    assert sorted((r.doc_id or 0, r.predicted) for r in out) == [(0, 0), (1, 0), (1, 0), (2, 1), (3, 0)] and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(frame([]), model).count() == 0
    for few in ([], [(1, "a b", 1)], [(None, "x", 1), (2, None, 0), (3, "y", None)], [(k, "fine text", 0) for k in range(9)]):
        few = spark.createDataFrame(few, "doc_id long, text string, toxic int")
        flat = toxicity.fit(few.drop("toxic"), few)
        assert not flat.terms and [r.predicted for r in toxicity.score(frame([(1, "a")]), flat).collect()] in ([0], [1])


def test_sample_is_a_bound_and_stable(spark):
    df = spark.createDataFrame(rows(1), "doc_id long, text string, toxic int")
    docs = df.drop("toxic")
    assert toxicity.drawn(df, 300).count() == 300
    assert toxicity.fit(docs, df, sample=300) == toxicity.fit(docs.orderBy("text"), df.repartition(3), sample=300)
