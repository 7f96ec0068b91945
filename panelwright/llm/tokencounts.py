"""Token counts of whole texts by a public vocabulary, lengths only.

Texts are split where no token can reach across: before a single space between two characters that aren't white space.
A task takes runs of texts balanced by size and encodes each distinct part of a run once, so long texts never reach the
library whole. A vocabulary for which that boundary isn't safe is given whole texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import tokens as T
from panelwright.llm import vocabulary as V
from panelwright.llm.piecemodel import PieceModel
from panelwright.llm.shared import type_of

RUN_BYTES = 8 << 20
CALL_CHARS = 1 << 20


class Counter:
    """Token counts as the library gives them, no special tokens added, special strings in texts as it handles them."""

    def __init__(self, name: str, data: bytes) -> None:
        if name.endswith(".model"):
            import sentencepiece

            model = PieceModel(data)
            library = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.safe = model.splits_at_spaces and not model.user_defined
            self.avoid, self.lead = "▁", ""
            encode = lambda texts: library.encode(texts, num_threads=1)
            self.lengths = lambda texts: [len(x) for x in encode(texts)]
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(data.decode())
            library.no_padding()
            library.no_truncation()
            spec = json.loads(data)
            first = spec.get("pre_tokenizer") or {}
            added = [t for t in spec.get("added_tokens", []) if t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])]
            self.safe = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not spec.get("normalizer") and not spec.get("post_processor") and not added
            self.avoid, self.lead = None, " "
            self.lengths = lambda texts: [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, parts: set[str], lead: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for call in V.balanced(list(parts), CALL_CHARS):
            out.update(zip(call, self.lengths([lead + p for p in call]), strict=True))
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        whole = [not self.safe or (self.avoid is not None and self.avoid in t) for t in texts]
        parts = V.split(texts, whole)
        first = self._known({own[0] for own in parts}, "")
        rest = self._known({p for own in parts for p in own[1:]}, self.lead)
        return [first[own[0]] + sum(map(rest.__getitem__, own[1:])) for own in parts]


def _count(name: str, data):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = V.loaded(("count", name, hash(data.value)), lambda: Counter(name, data.value))
        for batch in batches:
            counts: list[int] = []
            for i, j in T.runs(T.buffers(batch.column(1))[1], RUN_BYTES):
                counts += counter.count(batch.column(1).slice(i, j - i).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes (UTF-8), n_tokens by the vocabulary at `path`.

    .json files are counted as the tokenizers library does, .model files as sentencepiece does, without added special
    tokens, padding or truncation. Null text counts as empty: no bytes, no tokens. Rows are counted each alone, so
    null or repeated ids don't matter; other columns are not read; no rows give no rows.
    """
    data = docs.sparkSession.sparkContext.broadcast(V.contents(path))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(T.tidied(_count(path.rsplit("/", 1)[-1], data)), f"doc_id {type_of(docs, id_col)}, n_bytes long, n_tokens long")
