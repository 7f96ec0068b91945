"""Quality rules: base counts of a text, and tokeniser fertility judged by bands per script, and per language in Latin script."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import tokens as T
from panelwright.llm import vocabulary as V
from panelwright.llm.shared import carried, type_of

SYMBOLS = b"#*$%&|<>"
RUN_BYTES = 1 << 20
#: By script: fewest and most letters per token, most byte-fallback tokens per token, least bits per token. A text of
#: n tokens can't reach more than log2(n) bits, so the last one is a share of that, up to 8 bits.
BANDS = {
    "latin": (1.45, 9.0, 0.10, 0.35),
    "greek": (0.70, 6.0, 0.30, 0.35),
    "cyrillic": (0.90, 8.0, 0.30, 0.35),
    "hebrew": (0.60, 6.0, 0.40, 0.30),
    "arabic": (0.60, 6.0, 0.40, 0.30),
    "indic": (0.20, 6.0, 0.95, 0.20),
    "east_asian": (0.25, 6.0, 0.95, 0.20),
    "other": (0.15, 20.0, 1.00, 0.10),
}
SCRIPTS = tuple(BANDS)
#: Frequent function words by which a text in Latin script is taken for one of a language.
LANGUAGES = {
    "en": "the of and to in is for that it with was on by as this be are at from not or have his her they which but had were",
    "de": "der die und in den von zu das mit sich des auf für nicht ist im dem ein eine als auch es an er hat aus bei wird sie nach",
    "es": "de la que el en los se las del con un por no una su para es al lo como más pero sus le ha me si sin",
    "fr": "de la le et les des en un du que une est pour qui dans par sur au pas avec il ne ce plus se son sont ou mais nous",
}
#: By language, in place of the script's: fewest letters per token, least bits per token. Set from whole documents without
#: their labels: letters at the emptiest place between the two modes, bits 0.03 below the least that the base rules keep.
LANGUAGE_BANDS = {"en": (1.85, 0.64), "de": (1.88, 0.65), "es": (1.70, 0.66), "fr": (1.73, 0.65)}
#: The least share of a text's words that are function words of its language, and the fewest of them.
FUNCTION_SHARE, FUNCTION_WORDS = 0.01, 3
_LEAD = np.full(256, -1)
_LEAD[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = SCRIPTS.index("latin")
_LEAD[[0xCD, 0xCE, 0xCF]] = SCRIPTS.index("greek")
_LEAD[range(0xD0, 0xD4)] = SCRIPTS.index("cyrillic")
_LEAD[[0xD6, 0xD7]] = SCRIPTS.index("hebrew")
_LEAD[range(0xD8, 0xDC)] = SCRIPTS.index("arabic")
_LEAD[[0xE0, 0xE1]] = SCRIPTS.index("indic")
_LEAD[range(0xE3, 0xEE)] = SCRIPTS.index("east_asian")
_LEAD[[*range(0xCA, 0xCD), 0xD4, 0xD5, *range(0xDC, 0xE0), 0xE2, 0xEE, 0xEF, *range(0xF0, 0xF5)]] = SCRIPTS.index("other")
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = True
_POINT = np.ones(256, bool)
_POINT[0x80:0xC0] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_ALPHABET = T.Alphabet(T.WHITE, False)
_PLAIN = T.Alphabet(T.NOT_ALNUM, True)
_FUNCTION = [np.sort(T.words_of(*T.buffers(pa.array([x])), _PLAIN).hash) for x in LANGUAGES.values()]
_SPACES = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[at[1:] - at[0]] - sums[at[:-1] - at[0]]


def repeat_words(words: T.Words, n: int = 3) -> np.ndarray:
    """By text, the words in n-word windows found twice or more in it."""
    value, whole = T.windows(words, n)
    at = np.flatnonzero(whole)
    text = words.text
    order = np.lexsort((value[at], text[at]))
    v, t = value[at][order], text[at][order]
    same = (v[1:] == v[:-1]) & (t[1:] == t[:-1])
    again = np.zeros(len(v), bool)
    again[1:] |= same
    again[:-1] |= same
    hit = np.zeros(len(text) + 1, np.int32)
    start = at[order[again]]
    np.add.at(hit, start, 1)
    np.add.at(hit, start + n, -1)
    return np.bincount(text[np.cumsum(hit[:-1]) > 0], minlength=len(words.first) - 1)


def languages(data: np.ndarray, at: np.ndarray) -> list[str | None]:
    """By text, the language that most function words belong to; None for too few of them, or as many of another."""
    words = T.words_of(data, at, _PLAIN)
    n, text = np.diff(words.first), words.text
    hits = np.stack([np.bincount(text[own[np.minimum(np.searchsorted(own, words.hash), len(own) - 1)] == words.hash], minlength=len(n)) for own in _FUNCTION])
    ranked = np.sort(hits, 0)
    sure = (ranked[-1] > ranked[-2]) & (ranked[-1] >= FUNCTION_WORDS) & (ranked[-1] >= FUNCTION_SHARE * n)
    names = tuple(LANGUAGES)
    return [names[k] if s else None for k, s in zip(hits.argmax(0), sure, strict=True)]


def dup_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in text.split("\n") if has_word(x)]
    return len(lines) - len(set(lines))


def has_word(line: str) -> bool:
    """Whether a line has a character that isn't ASCII white space."""
    return bool(line.strip(" \t\n\x0b\x0c\r"))


def fertility(ids: np.ndarray, letters: int, is_byte: np.ndarray) -> tuple[float, float, float]:
    """Letters per token, share of byte-fallback tokens, bits per token over the most that its length allows."""
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0
    share = np.unique(ids, return_counts=True)[1] / n
    bits = float(-(share * np.log2(share)).sum())
    return letters / n, float(is_byte[ids].mean()), bits / min(8.0, max(1.0, np.log2(n)))


def _load(data: bytes):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    return library, np.array([library.is_byte(i) for i in range(library.vocab_size())])


def _measure(data):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, is_byte = V.loaded(("quality", hash(data.value)), lambda: _load(data.value))
        for batch in batches:
            column = batch.column(1)
            raw, at = T.buffers(column)
            for i, j in T.runs(at, RUN_BYTES):
                own = at[i : j + 1]
                part = raw[own[0] : own[-1]]
                words = T.words_of(raw, own, _ALPHABET)
                texts = column.slice(i, j - i).to_pylist()
                inside = np.zeros(len(part) + 1, np.int8)
                inside[words.begin - own[0]] += 1
                np.add.at(inside, words.end - own[0], -1)
                chars = _per_text(_POINT[part] & (np.cumsum(inside[:-1]) > 0), own)
                letters = _per_text(_ALNUM[part], own)
                counts = np.stack([_per_text(_LEAD[part] == k, own) for k in range(len(SCRIPTS))])
                script = np.where(counts.sum(0) > 0, counts.argmax(0), SCRIPTS.index("other"))
                ids = library.encode([t.translate(_SPACES) for t in texts], num_threads=1)
                rates = [fertility(np.array(x, np.int64), int(n), is_byte) for x, n in zip(ids, letters, strict=True)]
                out = {
                    "doc_id": batch.column(0).slice(i, j - i),
                    "n_words": np.diff(words.first),
                    "word_chars": chars,
                    "n_symbols": _per_text(_SYMBOL[part], own),
                    "n_dup_lines": np.array([dup_lines(t) for t in texts], np.int64),
                    "n_repeat_words": repeat_words(words).astype(np.int64),
                    "script": [SCRIPTS[k] for k in script],
                    "language": pa.array([x if SCRIPTS[k] == "latin" else None for k, x in zip(script, languages(raw, own), strict=True)], pa.string()),
                    "letters_per_token": [r[0] for r in rates],
                    "byte_share": [r[1] for r in rates],
                    "bits_share": [r[2] for r in rates],
                    "row": batch.column(2).slice(i, j - i),
                }
                yield pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in out.values()], list(out))

    return run


def measure(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: base counts, fertility by the sentencepiece model at `path`, base_failed, kept, and row,
    a struct of the columns in `carry`.

    Words are maximal runs without ASCII white space. n_words, word_chars (code points in words), n_symbols
    (characters of SYMBOLS), n_dup_lines (lines with a word, equal to an earlier one), n_repeat_words (words in 3-word
    windows found twice or more). base_failed: under 50 words, or 100 * n_repeat_words > 50 * n_words. fertility_failed:
    letters per token, the share of byte-fallback tokens or bits per token outside the band of the script that most
    letters have; a text in Latin script whose function words show its language (else null) has that language's lower
    edges of letters and bits per token. kept: neither. Letters are ASCII letters and digits and all other characters beyond ASCII.

    Null and wordless texts have zero counts and fail the base. Rows are judged each alone, null or repeated ids
    included. Other columns are not read. No rows give no rows.
    """
    data = docs.sparkSession.sparkContext.broadcast(V.contents(path))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), carried(carry))
    out = rows.mapInArrow(
        T.tidied(_measure(data)),
        f"doc_id {type_of(docs, id_col)}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, language string, letters_per_token double, byte_share double, bits_share double, row {type_of(rows, 'row')}",
    )
    band = lambda k: F.create_map(*(F.lit(x) for s, b in BANDS.items() for x in (s, b[k])))[F.col("script")]
    own = lambda k, of: F.coalesce(F.create_map(*(F.lit(x) for s, b in LANGUAGE_BANDS.items() for x in (s, b[k])))[F.col("language")], band(of))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd = (F.col("letters_per_token") < own(0, 0)) | (F.col("letters_per_token") > band(1)) | (F.col("byte_share") > band(2)) | (F.col("bits_share") < own(1, 3))
    out = out.withColumn("base_failed", base).withColumn("fertility_failed", odd).withColumn("kept", ~(base | odd))
    return out if carry else out.drop("row")
