import math
import re
from collections import Counter

import pyarrow as pa
import pytest

from panelwright.llm import quality
from panelwright.llm import tokens as T
from panelwright.llm.plans import vocabulary

from ..conftest import SF
from .test_vocabularies import brute_quality

sentencepiece = pytest.importorskip("sentencepiece")
VARIED = "Ordinary sentences about everyday things are short and clear, so readers understand them at once without effort. Then the story ends where the river meets the sea, and everybody goes home through quiet fields of early autumn. Nobody asked why old Martin kept seven lamps burning all night; he only smiled, closed his heavy door, and waited for morning."


def test_pages_of_table_cells_fall_below_the_band_of_their_language(frame):
    cells = " | | ".join(VARIED.split())
    got = {r.doc_id: r for r in quality.measure(frame([(1, cells), (2, VARIED), (3, None), (4, "漢字" * 40)]), vocabulary("piece_bpe_32k.model")).collect()}
    low = quality.BANDS["latin"][0]
    assert low < got[1].letters_per_token < quality.LANGUAGE_BANDS["en"][0] and not got[1].base_failed
    assert got[1].language == "en" and got[1].fertility_failed and not got[1].kept
    assert got[2].language == "en" and got[2].kept and got[3].language is None and got[4].language is None


def test_languages_by_function_words():
    texts = ["The end of the road", "la fin de la route et le pont", "der Hund und die Katze für das Kind", "el perro que no se va con los otros", "de la de la", "blue green", "", "the of"]
    data, at = T.buffers(pa.array(texts))
    assert quality.languages(data, at) == ["en", "fr", "de", "es", None, None, None, None]
    assert quality.languages(data, at[1:4]) == ["fr", "de"]
    assert quality.languages(*T.buffers(pa.array([], pa.string()))) == []


def brute_verdict(library, text):
    """letters per token, byte share, bits share, script, language and kept, one text at a time in plain Python."""
    ids = library.encode("".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text))
    letters = sum(c.isascii() and c.isalnum() or not c.isascii() for c in text)
    n, counts = len(ids), Counter(ids)
    rate = letters / n if n else 0.0
    byte = sum(library.is_byte(i) for i in ids) / n if n else 0.0
    bits = -sum(c / n * math.log2(c / n) for c in counts.values()) / min(8.0, max(1.0, math.log2(n))) if n else 0.0
    lead = Counter(s for c in text if (s := quality._LEAD[c.encode()[0]]) >= 0)
    script = min(lead, key=lambda s: (-lead[s], s)) if lead else len(quality.SCRIPTS) - 1
    script = quality.SCRIPTS[script]
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
    language = None
    if script == "latin":
        hits = sorted((sum(w in own.split() for w in words), k) for k, own in quality.LANGUAGES.items())
        if hits[-1][0] > hits[-2][0] and hits[-1][0] >= quality.FUNCTION_WORDS and hits[-1][0] >= quality.FUNCTION_SHARE * len(text.split()):
            language = hits[-1][1]
    low, high, most, least = quality.BANDS[script]
    low, least = quality.LANGUAGE_BANDS.get(language, (low, least))
    return rate, byte, bits, script, language, low <= rate <= high and byte <= most and bits >= least


def test_fertility_and_verdict_match_brute_force(spark, frame, prose):
    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    given = [(10_000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [*prose, *given, (1, "слово и другое слово " * 30), (2, "漢字" * 90), (3, "%%% &&& " * 60), (4, "a"), (5, "שלום עולם " * 40), (6, "the of und der " * 20)]
    out = quality.measure(frame(rows), path).collect()
    got = {r.doc_id: r for r in out}
    kept = 0
    for i, text in rows:
        r, (rate, byte, bits, script, language, fine) = got[i], brute_verdict(library, text or "")
        assert (r.letters_per_token, r.byte_share, r.bits_share) == pytest.approx((rate, byte, bits), abs=1e-9), i
        assert (r.script, r.language) == (script, language), i
        assert r.fertility_failed != fine and r.kept == (fine and not brute_quality(text)[5]), i
        kept += r.kept
    assert 50 < kept < len(rows) - 50 and {r.language for r in out} == {None, *quality.LANGUAGES}
