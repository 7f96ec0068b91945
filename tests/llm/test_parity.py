"""Registered callers of the codec hold every text against sentencepiece."""

import corpus_pipeline
from panelwright.llm import plans


def test_op7_and_the_pipeline_check_parity_of_every_text(spark, prose, tmp_path):
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in prose]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (plans.op7_sentencepiece_codec(spark, str(tmp_path)), corpus_pipeline.sentencepiece_codec(spark, docs, str(tmp_path))):
        got = [r.parity for r in out.select("parity").collect()]
        assert len(got) == len(rows) and all(x is True for x in got)
