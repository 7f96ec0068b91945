"""From raw documents to token ids: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.decontaminate import decontaminate
from panelwright.llm.minhash import near_duplicates
from panelwright.llm.plans import vocabulary
from panelwright.llm.quality import measure
from panelwright.llm.sentencepieces import encode
from panelwright.llm.shared import stored
from panelwright.llm.substrings import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The largest share of a document's words in benchmark passages with which what is left of it stays.
COVERAGE = 0.5


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, in their types; missing ones are null, n_chars is then the text's length; others go."""
    text = F.col("text").cast("string") if "text" in docs.columns else F.lit(None).cast("string")
    out = docs.withColumns({c: F.lit(None) for c in COLUMNS if c not in docs.columns})
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.length(text).cast("long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source")), n.alias("n_chars"))


def _with_text(rows: DataFrame, text: str) -> DataFrame:
    """The carried columns with a new text and its length; a text that was null and stays empty stays null."""
    new = F.when((F.col(text) == "") & F.col("row.text").isNull(), F.lit(None)).otherwise(F.col(text))
    out = {"text": new, "n_chars": F.length(new).cast("long")}
    return rows.select(*(out.get(c, F.col(f"row.{c}")).alias(c) for c in COLUMNS))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands keep, each judged alone by its text.

    Null, empty and wordless texts have under 50 words and go; long ones are judged whole. A row with a null or repeated
    id is judged like any other, equal rows alike. Columns beyond those of documents go, whatever their names; missing
    ones become null. No rows give no rows.
    """
    return measure(_documents(docs), vocabulary("piece_bpe_32k.model"), carry=COLUMNS).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five words, 0.8).

    Null and wordless texts are linked with nothing and stay, as do rows with a null id. Rows that repeat an id are one
    document: they stay or go together, with the links of all its texts. Long texts are compared whole. Other columns go,
    missing ones become null. No rows give no rows.
    """
    docs = _documents(docs)
    gone = near_duplicates(docs, words=5, percent=80).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words and more that start earlier in the corpus; every row stays.

    Null texts stay null, texts that lose all words become empty. A null id ranks before all others. Rows that repeat an
    id and a text start at the same place, so neither is earlier and both keep what one would. Long texts are treated
    whole. Other columns go, missing ones become null. No rows give no rows.
    """
    return _with_text(remove_repeats(_documents(docs), length=20, carry=COLUMNS), "kept_text")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages of ten words and more; documents that mostly consist of them go.

    Null and wordless texts have no hits and stay. Rows are treated each alone, null or repeated ids included, long texts
    whole. An empty benchmark, or one of null texts, leaves all as it is. Other columns go, missing ones become null. No
    rows give no rows.
    """
    found = decontaminate(_documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, carry=COLUMNS)
    return _with_text(found.filter(F.col("n_hit") <= COVERAGE * F.col("n_words")), "clean_text")


def sentencepiece_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, parity with sentencepiece, round_trip (the ids decode to the text), n_tokens.

    Null and empty texts have no ids, agree and come back. Rows are encoded each alone, null or repeated ids included,
    long texts whole. Other columns go, missing ones become null. No rows give no rows.
    """
    out = encode(_documents(docs), vocabulary("piece_bpe_32k.model"), ["doc_id", "lang", "source"])
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_codec),
]

#: Tokenisers and near-duplicate search aren't SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage's result written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
