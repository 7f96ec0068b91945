import random
import re

from panelwright.llm import licenses, plans

from ..conftest import SF

BODY = {}
for _name, _body, *_ in licenses.TEMPLATES:
    BODY.setdefault(_name, []).append(_body)


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def grams(w):
    return set(zip(w, w[1:], strict=False))


def brute(texts, percent=80):
    """Every template against the window of its length at every word."""
    found = []
    for text in texts:
        w = words(text)
        for name, body, must, never in licenses.TEMPLATES:
            t = words(body)
            b = grams(t)
            for k in range(len(w) - 1):
                own = w[k : k + len(t)]
                a = grams(own)
                if 200 * len(a & b) >= percent * (len(a) + len(b)) and {*must.split()} <= {*own} and not {*never.split()} & {*own}:
                    found.append((-2 * len(a & b) / (len(a) + len(b)), -len(b), name))
    return (min(found)[2], -min(found)[0], ",".join(sorted({f[2] for f in found}))) if found else None


def found(df):
    return {r.doc_id: (r.license, r.dice, r.licenses) for r in licenses.scan(df).collect()}


def test_windows_match_brute_force(frame):
    rng = random.Random(6)
    prose = "river stone the license of this software is not to be used in any form version 2 and 3 with conditions".split()
    some = lambda n: " ".join(rng.choice(prose) for _ in range(n))
    rows = []
    for k in range(90):
        body = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.choice((0, 0, 1, len(body) // 12))):
            at = rng.randrange(len(body))
            body[at : at + 1] = rng.choice(([], ["word"], [body[at], "more"]))
        cut = body if k % 5 else body[: max(3, len(body) * 9 // 10)]
        rows.append((k, f"{some(rng.randrange(30))}{rng.choice((' ', chr(10), chr(10) * 2, '. '))}{' '.join(cut)} {some(rng.randrange(20))}"))
    rows += [(900, None), (901, ""), (902, "MIT"), (903, "word " * 40_000), (904, some(400))]
    want = {i: b for i, t in rows if (b := brute([t]))}
    assert found(frame(rows).selectExpr("doc_id", "text", "1 as words", "2 as w", "3 as known", "4 as license", "5 as template")) == want
    assert len(want) > 60 and len({v[0] for v in want.values()}) > 12


TOLD_APART = [
    ("Copyright 2020 Jane Doe. Licensed under the MIT License. All rights reserved.", "MIT"),
    ("This package is free to use and it is licensed under the MIT License.", "MIT"),
    (BODY["LGPL-3.0-or-later"][0], "LGPL-3.0-or-later"),
    (BODY["LGPL-2.1-or-later"][0], "LGPL-2.1-or-later"),
    (BODY["AGPL-3.0-or-later"][0], "AGPL-3.0-or-later"),
    (BODY["GPL-2.0-or-later"][0], "GPL-2.0-or-later"),
    (BODY["GPL-3.0-or-later"][0], "GPL-3.0-or-later"),
    (BODY["BSD"][0], "BSD"),
    (BODY["BSD-2-Clause"][0], "BSD-2-Clause"),
    (BODY["BSD-3-Clause"][0], "BSD-3-Clause"),
    (BODY["BSD-4-Clause"][0], "BSD-4-Clause"),
    (BODY["0BSD"][0], "0BSD"),
    (BODY["ISC"][1], "ISC"),
    (BODY["MIT"][3].replace("\n", " "), "MIT"),
    ("licensed under cc by-nc 4.0", "CC-BY-NC-4.0"),
    ("Intro words here " * 500 + BODY["Apache-2.0"][1] + " and then a closing remark " * 500, "Apache-2.0"),
]


def test_statements_are_told_apart(frame):
    got = found(frame([(k, text) for k, (text, _) in enumerate(TOLD_APART)]))
    assert [got[k][0] for k in range(len(TOLD_APART))] == [name for _, name in TOLD_APART]


def test_lines_don_t_matter(frame):
    flat = BODY["BSD-3-Clause"][0]
    rows = [(1, flat), (2, flat.replace(" ", "\n")), (3, f"a\n\n{flat.replace('. ', '.' + chr(10) * 2)}\n\nb"), (4, "x " * 300 + flat + " y" * 300)]
    assert {v[0] for v in found(frame(rows)).values()} == {"BSD-3-Clause"} and len(found(frame(rows))) == 4


def test_repeated_ids_are_one_document(frame):
    got = found(frame([(1, "Released under the MIT License."), (1, "Licensed under CC BY 4.0."), (None, "Licensed under the Apache License, version 2.0!")]))
    assert got == {1: brute(["Released under the MIT License.", "Licensed under CC BY 4.0."]), None: ("Apache-2.0", 1.0, "Apache-2.0")}
    assert licenses.scan(frame([])).count() == 0


def test_every_window_beyond_the_threshold_holds_an_anchor():
    for percent in (60, 80, 95):
        table = licenses.anchors(percent)
        for k, (_, body, _, _) in enumerate(licenses.TEMPLATES):
            own = licenses.grams_of(licenses.words_of(body))
            free = [g for g in own if k not in table.get(g, ())]
            assert (200 - percent) * len(free) < percent * len(own)


def test_main_path_has_no_python(spark):
    plan = plans.op1_license_scans(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop|ExistingRDD", plan)
