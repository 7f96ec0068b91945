import re
import struct
from collections import Counter

import pytest

from panelwright.llm import quality, sentencepieces, tokencounts
from panelwright.llm.piecemodel import PieceModel
from panelwright.llm.plans import vocabulary

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["a  b", "  a b ", "\na\n b", "", " ", "a　b \xa0c", "<s>x</s>", "hi<0x0A>", "héllo 漢字 🎉 \x00x", "a" * 50, "a <|endoftext|> b<|endoftext|>c", "it's  don't \x1c b", "▁a ▁", "x ý z"]
PIECES = "piece_bpe_32k.model"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", PIECES])
def test_counts_are_the_library_s(spark, frame, prose, monkeypatch, name):
    monkeypatch.setattr(tokencounts, "RUN_BYTES", 5000)
    path = vocabulary(name)
    rows = [*prose, *((1000 + k, t) for k, t in enumerate(ODD)), (None, "no id"), (5000, "word " * 60_000), (5000, "word " * 60_000)]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in tokencounts.count_tokens(frame(rows).selectExpr("*", "1 as n_bytes", "2 as n_tokens"), path).collect())
    if name.endswith(".json"):
        library = tokenizers.Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    assert got == sorted((i or -1, len((t or "").encode()), count(t or "")) for i, t in rows)
    assert tokencounts.count_tokens(frame([]), path).count() == 0


def test_encoding_and_decoding_agree_with_sentencepiece(frame, prose):
    path = vocabulary(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*prose, *((1000 + k, t) for k, t in enumerate(ODD)), (None, None), (5000, "word " * 20_000)]
    df = frame(rows).selectExpr("doc_id", "text", "1 as parity", "2 as decoded", "doc_id as id")
    out = sentencepieces.encode(df, path, ["id", "text"])
    out = sentencepieces.decode(out, path).collect()
    assert sorted((r.id or -1, r.text or "") for r in out) == sorted((i or -1, t or "") for i, t in rows)
    for r in out:
        text = r.text or ""
        assert r.ids == library.encode(text) and r.parity and r.decoded == library.decode(r.ids)
        assert r.round_trip == (r.decoded == text) and (r.round_trip or "▁" in text)
    some = sentencepieces.encode(frame(rows), path, ["text"], audit=4).collect()
    assert {r.parity for r in some} == {None, True} and all(r.ids == library.encode(r.text or "") for r in some)
    assert sentencepieces.encode(frame([]), path, ["doc_id"]).count() == 0


def _field(number, value):
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    if isinstance(value, int):
        out = bytearray()
        for n in (number << 3, value):
            while n > 127:
                out.append(n & 127 | 128)
                n >>= 7
            out.append(n)
        return bytes(out)
    head = bytearray()
    for n in (number << 3 | 2, len(value)):
        while n > 127:
            head.append(n & 127 | 128)
            n >>= 7
        head.append(n)
    return bytes(head) + value


def test_unigram_models_are_rebuilt():
    """A small model written by hand: scores, byte fallback, trimmed spaces."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{k:02X}>", 0.0, 6) for k in range(256))]
    pieces += [(p, s, 1) for p, s in (("▁", -3.0), ("a", -4.0), ("b", -4.5), ("c", -4.7), ("ab", -5.0), ("▁ab", -5.5), ("▁a", -6.0), ("bc", -6.5), ("▁abc", -12.0))]
    data = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, t)) for p, s, t in pieces)
    data += _field(2, _field(3, 1) + _field(35, 1) + _field(40, 0) + _field(41, 1) + _field(42, 2)) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 1) + _field(5, 1))
    model = PieceModel(data)
    assert (model.kind, model.byte_fallback, model.trim_spaces, model.splits_at_spaces) == (1, True, True, False)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    rebuilt = model.rebuild()
    for text in ("abc", "ab  abc", " a b ", "é x", "", "cab\nab", "abcabc abc"):
        assert rebuilt.encode(text, add_special_tokens=False).ids == library.encode(text), text


def brute_quality(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), failed


def test_quality_counts_match_brute_force(frame, prose, monkeypatch):
    monkeypatch.setattr(quality, "RUN_BYTES", 3000)
    varied = "Ordinary sentences about everyday things are short and clear, so readers understand them at once without effort. Then the story ends where the river meets the sea, and everybody goes home through quiet fields of early autumn. Nobody asked why old Martin kept seven lamps burning all night; he only smiled, closed his heavy door, and waited for morning."
    junk = " ".join(f"w{k}%%%" if k % 2 else f"q{k}&&&" for k in range(80))
    rows = [*prose, (1, varied), (2, junk), (3, "same line\n\nsame line\n \nsame line x"), (4, "a b c " * 60), (None, None), (5, "x" * 200_000), (6, "слово и другое слово " * 3), (7, "漢字" * 40)]
    out = quality.measure(frame(rows).selectExpr("doc_id", "text", "1 as script", "2 as n_words"), vocabulary(PIECES), carry=("script",)).collect()
    by_id = {r.doc_id: r for r in out}
    for i, t in rows:
        r = by_id[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), i
        assert r.kept == (not r.base_failed and not r.fertility_failed) and r.row.script == 1
    assert by_id[1].kept and by_id[2].fertility_failed and not by_id[2].kept
    assert by_id[1].script == "latin" and by_id[6].script == "cyrillic" and by_id[7].script == "east_asian"
    assert quality.measure(frame([]), vocabulary(PIECES)).count() == 0
