"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding maps look-alike letters, accents and digits used as letters to plain ones. Terms are whole words and beginnings
of words; those and their weights are learnt from labelled documents, as are exception phrases, in which hits don't
count. A document's hits, weighted and set against its length, give its score by a logistic model.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import stored

#: Letters that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = "аa вb еe кk мm нh оo рp сc тt уy хx іi јj ѕs ԁd ԛq ԝw αa εe ιi κk οo ρp τt υu χx νv ıi ɡg"
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Harmless phrases around words that are often abuse.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown car", "pond scum", "soap scum", "sore loser rule", "stupid simple")
LENGTHS = range(4, 11)
SAMPLE = 8_000
THRESHOLD = 0.7


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        plain = unicodedata.normalize("NFKD", chr(code))
        table[code] = "".join(c for c in plain if not unicodedata.combining(c)).lower()
    table |= {code: None for code in [*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0x2060, 0xAD, 0xFEFF]}
    table |= {ord(odd): plain for odd, plain in LOOKALIKES.split(" ")}
    table |= {code: chr(code + 32) for code in range(65, 91)}
    return table


_FOLD = _fold_table()
_DIGITS = re.compile(r"[0134578@$]{1,3}(?=[a-z])|(?<=[a-z])[0134578@$]{1,3}(?![a-z0-9])")
_WORD = re.compile(r"[^\W_]+")
_STANDS = str.maketrans(STANDS_FOR)


def folded(text: str) -> str:
    """Folded words, each between single spaces."""
    plain = text.lower().translate(_FOLD)
    plain = _DIGITS.sub(lambda m: m[0].translate(_STANDS), plain)
    return " " + " ".join(_WORD.findall(plain)) + " "


def terms_of(text: str) -> Counter:
    """Occurrences of whole words (" word ") and word beginnings (" wor") of a folded text."""
    out: Counter = Counter()
    for word, n in Counter(text.split()).items():
        out[f" {word} "] += n
        for k in LENGTHS:
            if k < len(word):
                out[f" {word[:k]}"] += n
    return out


@dataclass(frozen=True)
class Model:
    """terms: pattern -> weight; exceptions: phrases; center, spread, slope, bias: of the logistic model."""

    terms: dict[str, float]
    exceptions: tuple[str, ...]
    center: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()
    slope: tuple[float, ...] = ()
    bias: float = 0.0

    def matcher(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            out.add_word(term, (term, weight))
        for phrase in self.exceptions:
            out.add_word(f" {phrase} ", (f" {phrase} ", None))
        if len(out):
            out.make_automaton()
        return out

    def features(self, matcher, text: str) -> tuple[float, float, float]:
        """Weighted hits (log), weighted hits per hundred words, words (log)."""
        words = text.count(" ") - 1 if len(text) > 2 else 0
        hits, spared = [], []
        if len(matcher):
            for end, (term, weight) in matcher.iter(text):
                (spared if weight is None else hits).append((end - len(term) + 1, end, weight))
        total = 0.0
        for begin, end, weight in hits:
            if not any(a <= begin and end <= b for a, b, _ in spared):
                total += weight
        return float(np.log1p(total)), min(20.0, 100 * total / max(words, 10)), float(np.log1p(words))

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = ((x - np.array(self.center)) / np.array(self.spread)) @ np.array(self.slope) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> term, documents and occurrences in toxic and in other ones; and the words of each under ''."""
    names = ["term", "toxic_docs", "other_docs", "toxic_n", "other_n"]
    for batch in batches:
        sums: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = folded(text)
            k = 0 if toxic else 1
            for term, n in (terms_of(own) | {"": own.count(" ") - 1}).items():
                row = sums.setdefault(term, [0, 0, 0, 0])
                row[k] += 1
                row[2 + k] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([r[k] for r in sums.values()], pa.int64()) for k in range(4))], names)


def _feature_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            rows = [model.features(matcher, folded(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.float64()) for k in range(3)), batch.column(1)], ["a", "b", "c", "toxic"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton steps with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def drawn(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The bounded sample: the (doc_id, toxic) with the smallest hash of doc_id, rows with a null left out."""
    known = labels.filter("doc_id is not null and toxic is not null").select("doc_id", "toxic").distinct()
    return known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the texts of the documents in a sample of the labels, `sample` of them at most (see `drawn`).

    Null texts are left out; of rows that repeat a doc_id one text counts, so `sample` bounds all that is gathered. Every
    term beyond chance is used, there is no limit to their number. Terms: those whose rate per word in toxic rows is at least
    six times that in others and beyond chance (z of 8 and more by words, 5 by rows), in 5 toxic rows at least; of terms that begin alike,
    the one furthest beyond chance. With no toxic or no other rows, or no terms, all scores are the share of toxic rows.
    """
    # the sample is bounded, so it can be broadcast; its texts stay distributed
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(drawn(labels, sample)), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = stored(rows.select("text", (F.col("toxic") == 1).alias("toxic")), "labelled")
    sums = rows.mapInArrow(_counts, "term string, toxic_docs long, other_docs long, toxic_n long, other_n long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("toxic_docs", "other_docs", "toxic_n", "other_n")))
    sums = stored(sums.filter("toxic_docs >= 5 or other_docs >= 3 or term = ''"), "terms")
    whole = sums.filter("term = ''").first()
    if whole is None:
        return Model({}, (), (0.0,) * 3, (1.0,) * 3, (0.0,) * 3, -3.0)
    n1, n0 = max(1, whole["toxic_n"]), max(1, whole["other_n"])
    share = (whole["toxic_docs"] + 0.5) / (whole["toxic_docs"] + whole["other_docs"] + 1.0)
    flat = Model({}, (), (0.0,) * 3, (1.0,) * 3, (0.0,) * 3, float(np.log(share / (1 - share))))
    r1, r0 = F.col("toxic_n") / n1, F.col("other_n") / n0
    z = (r1 - r0) / F.sqrt((F.col("toxic_n") + F.col("other_n") + 1) / (n1 + n0) * (1 / n1 + 1 / n0))
    d1, d0 = F.col("toxic_docs") / max(1, whole["toxic_docs"]), F.col("other_docs") / max(1, whole["other_docs"])
    z_docs = (d1 - d0) / F.sqrt((F.col("toxic_docs") + F.col("other_docs") + 1) / (whole["toxic_docs"] + whole["other_docs"]) * (1 / max(1, whole["toxic_docs"]) + 1 / max(1, whole["other_docs"])))
    found = sums.filter("term <> '' and toxic_docs >= 5").withColumn("z", z).filter((F.col("z") >= 8) & (z_docs >= 5) & (r1 >= 6 * (r0 + 0.5 / n0)))
    found = found.orderBy(F.desc("z"), F.length("term").desc(), "term").collect()  # words of the bounded sample
    terms = furthest([(r["term"], float(np.log((r["toxic_n"] + 0.5) / n1 / ((r["other_n"] + 0.5) / n0)))) for r in found])
    if not terms or not whole["toxic_docs"] or not whole["other_docs"]:
        return flat
    heads = F.array(*(F.lit(t) for t in terms if not t.endswith(" "))).cast("array<string>")
    begins = F.array(*(F.substring("term", 1, k + 1) for k in LENGTHS))
    harmless = sums.filter(F.col("term").endswith(" ") & (F.col("toxic_docs") == 0) & (F.col("other_docs") >= 3) & F.arrays_overlap(begins, heads))
    spared = [r["term"].strip() for r in harmless.select("term").collect()]
    model = Model(terms, tuple(sorted({*EXCEPTIONS, *spared})))
    x = np.array([tuple(r) for r in rows.mapInArrow(_feature_rows(model), "a double, b double, c double, toxic boolean").collect()], float)
    center, spread = x[:, :3].mean(0), x[:, :3].std(0) + 1e-9
    slope, bias = _logistic((x[:, :3] - center) / spread, x[:, 3])
    return Model(terms, model.exceptions, tuple(center), tuple(spread), tuple(slope), bias)


def furthest(found: list[tuple[str, float]]) -> dict[str, float]:
    """Of terms that begin alike the first, from terms in order; a whole word counts as its beginning here."""
    terms: dict[str, float] = {}
    taken: set[str] = set()
    begun: set[str] = set()
    for term, weight in found:
        bare = term.rstrip(" ")
        begins = [bare[:k] for k in range(1, len(bare) + 1)]
        if taken.isdisjoint(begins) and bare not in begun:
            terms[term] = weight
            taken.add(bare)
            begun.update(begins)
    return terms


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        matcher = model.matcher()
        for batch in batches:
            x = np.array([model.features(matcher, folded(t)) for t in batch.column(1).to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(x))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, score (0 to 1), predicted (1 from `threshold` on).

    Null text counts as empty; empty and wordless texts have no hits and the score of a text without any. Rows are
    scored each alone by their text only, null or repeated ids included. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(_score(shared), f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
