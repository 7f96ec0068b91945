"""The whole pipeline over a small table of documents against a plain version of its five stages."""

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from panelwright.llm import plans
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_decontaminate import words
from tests.llm.test_minhash import brute as brute_groups
from tests.llm.test_substrings import WORD
from tests.llm.test_substrings import brute as brute_repeats
from tests.llm.test_vocabularies import brute_quality


def test_run_matches_the_stages_one_by_one(spark, prose, tmp_path):
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in prose]
    leak = " ".join(f"leak{k} word" for k in range(12))
    long = dict(prose)
    host = next(i for i, t in prose if t and len(WORD.findall(t)) > 100)
    rows.append((9000, long[host][:0] + " ".join(f"own{k} text{k * k}" for k in range(60)) + " " + leak, "en", "src0", 1))
    items = [(1, leak), (2, "something else entirely that no document has at all, really none")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r[0]: r[1] for r in rows}
    base = {i: t for i, t in texts.items() if not brute_quality(t)[5]}
    frame = spark.createDataFrame(list(base.items()), "doc_id long, text string")
    verdict = {r.doc_id: r.kept for r in corpus_pipeline.measure(frame, plans.vocabulary("piece_bpe_32k.model")).collect()}
    kept = {i: t for i, t in base.items() if verdict[i]}
    groups = brute_groups(list(kept.items()), 5, 80)
    kept = {i: t for i, t in kept.items() if groups[i][2]}
    repeats = brute_repeats(list(kept.items()), 20)
    left = {i: " ".join(repeats[i][2]) for i in kept}
    hits = {i: brute_hits(t, items, 10) for i, t in left.items()}
    expect = {i for i, (n, hit, _) in hits.items() if hit <= 0.5 * n}
    assert set(got) == expect and 9000 in expect and hits[9000][1] > 0 and len(expect) < len(base) < len(texts)
    for i in expect:
        assert got[i].ids == library.encode(library.decode(got[i].ids)) and got[i].round_trip and got[i].parity is True and got[i].n_tokens == len(got[i].ids)
        assert len(words(library.decode(got[i].ids))) == hits[i][0] - hits[i][1]


def test_stages_have_the_columns_of_documents():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "substring dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]


def test_every_operator_has_its_query():
    assert sorted(int(q[2:].split("_")[0]) for q in plans.QUERIES) == list(range(1, 14))
    assert set(plans.SQL) <= set(plans.QUERIES)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_bear_any_rows(spark, tmp_path, name, stage):
    """Nulls everywhere, repeated rows and ids, empty and long texts, missing, odd and clashing columns, no rows."""
    spark.createDataFrame([(1, None), (None, "ten words of an item that nobody has ever seen anywhere"), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"Sentence number {k} tells of river {k * 7 % 1009} and stone {k * k % 997} in plain words." for k in range(4_000))
    prose = "Ordinary sentences about everyday things are short and clear, so readers understand them at once without effort. Then the story ends where the river meets the sea, and everybody goes home through quiet fields of early autumn. Nobody asked why old Martin kept seven lamps burning all night; he only smiled, closed his heavy door, and waited for morning."
    rows = [(None, None, None, None, None), (None, prose, "en", None, 5), (1, "", "", "", 0), (2, None, "de", "s", None), (3, prose, "en", "s", 9), (3, prose, "en", "s", 9), (3, "another short text", "en", "s", 18), (4, long, "en", "s", 1), (5, " \t\n", None, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.selectExpr("*", *(f"'x' AS {c}" for c in ("row", "ids", "parity", "kept", "n_words", "id", "key", "at", "text_", "kept_text", "clean_text", "decoded", "component_id")))
    plain, more = stage(spark, docs, str(tmp_path)), stage(spark, clash, str(tmp_path))
    assert plain.columns == more.columns and sorted(map(repr, plain.collect())) == sorted(map(repr, more.collect()))
    few = stage(spark, docs.select("text", "doc_id"), str(tmp_path))
    assert few.columns == plain.columns and few.count() == plain.count()
    none = stage(spark, docs.limit(0), str(tmp_path))
    assert none.columns == plain.columns and none.count() == 0
    if name != "SentencePiece encoding and decoding":
        assert plain.columns == list(corpus_pipeline.COLUMNS)
    ids = sorted(r.doc_id or 0 for r in plain.collect() if r.doc_id != 4)
    assert ids == ([0, 3, 3] if name == "quality rules" else [0, 0, 1, 2, 3, 3, 3, 5])
