"""Encoding and decoding by a sentencepiece model on the tokenizers library, with parity against sentencepiece."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import tokens as T
from panelwright.llm import vocabulary as V
from panelwright.llm.piecemodel import BYTE, CONTROL, SPACE, UNKNOWN, PieceModel

RUN_BYTES = 3 << 20
THREADS = 2
RUN_IDS = 1 << 19
#: Distinct parts that a worker keeps, parts that are encoded as one text, and characters of a call of the library.
STORE = 1 << 18
JOINED = 64
CALL_CHARS = 1 << 20


class Codec:
    """The rebuilt pipeline, and the library that it must agree with.

    Where no piece has a space after another character, texts are cut before single spaces and every distinct part is
    encoded once, many parts in a call: a space always begins a piece, so the ids of a call fall apart by part. The last
    `STORE` distinct parts or fewer stay known in a worker.
    """

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        model = PieceModel(data)
        self.tokenizer = model.rebuild()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.splits = model.splits_at_spaces and not model.user_defined
        self.prefix = model.dummy_prefix
        told = [self._bytes(*p) for p in model.pieces]
        self.letters = np.frombuffer(b"".join(told), np.uint8)
        self.n_letters = np.array([len(x) for x in told], np.int64)
        self.first_letter = np.cumsum(self.n_letters) - self.n_letters
        self.begins = np.array([p.startswith(SPACE) for p, _, _ in model.pieces])
        self._forget()

    @staticmethod
    def _bytes(piece: str, score: float, kind: int) -> bytes:
        """What a piece stands for in a decoded text."""
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else " \u2047 ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.begin, self.end = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _call(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        """Encode parts not known yet: non-empty, without spaces, cut apart at the pieces that begin with one."""
        flat, ends = [self.ids], [self.end]
        size = len(self.ids)
        for run in V.balanced(parts, CALL_CHARS):
            joined = [run[k : k + JOINED] for k in range(0, len(run), JOINED)]
            for own, ids in zip(joined, self._call([" ".join(x) for x in joined]), strict=True):
                ids = np.array(ids, np.int32)
                at = np.flatnonzero(self.begins[ids])
                if len(at) != len(own):
                    raise ValueError("a part doesn't begin with one piece that starts with a space")
                flat.append(ids)
                ends.append(np.append(at[1:], len(ids)) + size)
                size += len(ids)
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))
        self.ids, self.end = np.concatenate(flat), np.concatenate(ends)
        self.begin = np.concatenate(([0], self.end[:-1])) if len(self.end) else self.end

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that split at every space, and where each text's end."""
        parts = pc.split_pattern(texts, " ")
        values = parts.flatten().dictionary_encode()
        distinct = values.dictionary.to_pylist()
        if len(self.known) + len(distinct) > STORE:
            self._forget()
        self._learn([p for p in distinct if p not in self.known])
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[values.indices.to_numpy()]
        sizes = self.end[at] - self.begin[at]
        total = np.cumsum(sizes)
        where = np.repeat(self.begin[at] - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)
        n_parts = pc.list_value_length(parts).to_numpy()
        return self.ids[where], np.concatenate(([0], total))[np.cumsum(n_parts)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each text end."""
        odd = pc.match_substring_regex(texts, f"^$|  |^ | $|{SPACE}").to_numpy(zero_copy_only=False) if self.splits else np.ones(len(texts), bool)
        if not odd.any():
            return self._plain(texts)
        rest = texts.filter(pa.array(odd)).to_pylist()
        parts = V.split(rest, [not self.splits or SPACE in t for t in rest])
        ids = iter(self._call([p for own in parts for p in own]))
        each = iter([np.array([i for _ in own for i in next(ids)], np.int32) for own in parts])
        plain, ends = self._plain(texts.filter(pa.array(~odd)))
        usual = iter(np.split(plain, ends[:-1]) if len(ends) else [])
        out = [next(each) if x else next(usual) for x in odd]
        return np.concatenate(out), np.cumsum([len(x) for x in out])

    def letters_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids decode to, one after the other, and where those of each id end."""
        sizes = self.n_letters[ids]
        total = np.cumsum(sizes)
        where = np.repeat(self.first_letter[ids] - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)
        return self.letters[where], total

    def comes_back(self, ids: np.ndarray, ends: np.ndarray, raw: np.ndarray, at: np.ndarray) -> list[bool]:
        """Whether each text's own ids decode to its bytes, `raw[at[k]:at[k + 1]]`."""
        told, upto = self.letters_of(ids)
        to = np.concatenate(([0], upto))[np.concatenate(([0], ends))]
        lead = int(self.prefix)
        return [np.array_equal(told[a + lead * (a < b) : b], raw[i:j]) for a, b, i, j in zip(to[:-1], to[1:], at[:-1], at[1:], strict=True)]

    def agrees(self, ids: np.ndarray, ends: np.ndarray, due: list[int], texts: pa.Array) -> list[bool | None]:
        """For the texts in `due`, whether sentencepiece gives the same ids for the whole text; null for the others."""
        same: list[bool | None] = [None] * len(ends)
        first = np.concatenate(([0], ends))
        theirs = self.library.encode(texts.take(pa.array(due, pa.int64())).to_pylist(), num_threads=1) if due else []
        for k, x in zip(due, theirs, strict=True):
            same[k] = np.array_equal(ids[first[k] : ends[k]], np.array(x, np.int32))
        return same

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def _codec(data) -> Codec:
    return V.loaded(("codec", hash(data.value)), lambda: Codec(data.value))


def _encode(data, audit: int, at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data)
        for batch in batches:
            raw, starts = T.buffers(batch.column(at))
            for i, j in T.runs(starts, RUN_BYTES):
                part = batch.slice(i, j - i)
                texts = part.column(at)
                ids, ends = codec.encode(texts)
                due = [k for k, a in enumerate(part.column(at + 1).to_pylist()) if audit and a % audit == 0]
                same = codec.agrees(ids, ends, due, texts)
                back = codec.comes_back(ids, ends, raw, starts[i : j + 1])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(at)), lists, pa.array(same, pa.bool_()), pa.array(back, pa.bool_())], names)

    return run


def _decode(data, at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data)
        for batch in batches:
            column = batch.column(at)
            ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
            for i, j in T.runs(ends, RUN_IDS):
                part = batch.slice(i, j - i)
                ids = [x or [] for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codec.decode(ids), pa.string())], names)

    return run


def _fields(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def encode(docs: DataFrame, path: str, keep: list[str], text_col: str = "text", audit: int = 1) -> DataFrame:
    """keep, ids, parity, round_trip: ids by the model at `path`, without begin, end or other added tokens.

    round_trip: the text's own ids, decoded by the model's pieces, give its bytes. parity: sentencepiece gives the same ids; it is checked for the rows whose
    text hashes to a multiple of `audit` (1: all, 0: none) and null for the others. Null text counts as empty and has no
    ids. Rows are encoded each alone, so null or repeated ids don't matter. Only the columns in `keep` are carried; those
    named as a result give way to it. No rows give no rows.
    """
    data = docs.sparkSession.sparkContext.broadcast(V.contents(path))
    keep = [c for c in keep if c not in ("ids", "parity", "round_trip")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("text_"), F.abs(F.hash(text).cast("long")).alias("audit_"))
    names = [*keep, "ids", "parity", "round_trip"]
    kept = f"{_fields(docs, keep)}, " if keep else ""
    return rows.mapInArrow(T.tidied(_encode(data, audit, len(keep), names)), f"{kept}ids array<int>, parity boolean, round_trip boolean")


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded, the text of the ids, in place of a column of that name; null or no ids give an empty text."""
    rows = rows.drop("decoded")
    data = rows.sparkSession.sparkContext.broadcast(V.contents(path))
    names = [*rows.columns, "decoded"]
    return rows.mapInArrow(T.tidied(_decode(data, rows.columns.index(ids_col), names)), f"{_fields(rows, rows.columns)}, decoded string")
