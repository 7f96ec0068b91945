"""Repeated-passage removal by difference-cover anchors.

A window is `length` consecutive words. Positions modulo `PERIOD` that lie in `COVER` carry an anchor, the hash of the
`length - PERIOD + 1` words from there on. COVER is a difference cover: for any two positions some common shift below
PERIOD moves both into it, so equal windows share an aligned anchor. Anchors seen once in the corpus therefore rule out
all windows that only contain such anchors; matches of the others extend to whole windows, compared by their hash, and
the earliest occurrence of each window stays.

Hot passages: every batch of texts meets others only through one entry per distinct hash (its earliest occurrence), so
a passage in a third of all texts costs an entry per batch, not per text. Entries travel packed by hash range, answers
packed by batch; the number of ranges follows the bytes of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import tokens as T
from panelwright.llm.shared import carried, type_of

PERIOD = 13
COVER = (0, 1, 3, 9)
BATCH_BYTES = 32 << 20
RANGE_BYTES = 24 << 20
_NO_ID = -(1 << 63)
_PACKED = "part int, batch long, sure boolean, h binary, doc binary, pos binary, ids binary, keys binary"
_ALPHABET = T.Alphabet(T.WHITE, False)


def _pack(part: int, batch: int, sure: bool, h: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> dict:
    used, local = np.unique(doc, return_inverse=True)
    return {"part": part, "batch": batch, "sure": sure, "h": h.tobytes(), "doc": local.astype(np.int32).tobytes(), "pos": pos.astype(np.int32).tobytes(), "ids": ids[used].tobytes(), "keys": keys[used].tobytes()}


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("sure", pa.bool_()), *((c, pa.binary()) for c in ("h", "doc", "pos", "ids", "keys"))]))


def _later(h: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (h, id, pos); which entries of it lie after their hash's first; which hashes' entries begin."""
    order = np.lexsort((pos, ids, h))
    h, ids, pos = h[order], ids[order], pos[order]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
    return order, (ids != ids[first]) | (pos != pos[first]), head


def _send(batch: int, found: list[tuple], ids: np.ndarray, keys: np.ndarray, parts: int, ordered: bool) -> Iterator[pa.RecordBatch]:
    """What a batch knows already, and one entry per hash for the others to meet.

    ordered: entries after the first of their hash are surely repeats. Otherwise all entries of a hash that occurs
    twice are, and the hash itself travels with position -1.
    """
    h, doc, pos = (np.concatenate(x) for x in zip(*found, strict=True))
    order, later, head = _later(h, ids[doc], pos)
    h, doc, pos = h[order], doc[order], pos[order]
    if ordered:
        sure, go = later, ~later
    else:
        last = np.append(head[1:], True)
        sure, go = ~(head & last), head
        pos = np.where(sure & go, np.int32(-1), pos)
    out, real = [], order[sure]
    if len(real):
        d, p = (np.concatenate([f[k] for f in found])[real] for k in (1, 2))
        by = np.lexsort((p, d))
        out.append(_pack(batch % parts, batch, True, np.zeros(0, np.uint64), d[by], p[by], ids, keys))
    h, doc, pos = h[go], doc[go], pos[go]
    to = (h >> np.uint64(32)) % np.uint64(parts)
    by = np.lexsort((pos, doc, to))
    h, doc, pos, to = h[by], doc[by], pos[by], to[by]
    edges = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, int)
    for a, b in zip(edges, np.append(edges[1:], len(to)), strict=True):
        out.append(_pack(int(to[a]), batch, False, h[a:b], doc[a:b], pos[a:b], ids, keys))
        if len(out) == 64:
            yield _rows(out)
            out = []
    if out:
        yield _rows(out)


def _meet(ordered: bool):
    """Entries of one range of hashes -> by batch, (id, key, pos) of those that some other batch shares (or has earlier)."""

    def run(table: pa.Table) -> pa.Table:
        get = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
        h, doc, pos, ids, keys = get("h", np.uint64), get("doc", np.int32), get("pos", np.int32), get("ids", np.int64), get("keys", np.int64)
        batch, sure = table.column("batch").to_pylist(), table.column("sure").to_pylist()
        out: list[tuple] = [(b, i[d], k[d], p) for b, s, d, p, i, k in zip(batch, sure, doc, pos, ids, keys, strict=True) if s]
        rest = [n for n, s in enumerate(sure) if not s]
        if rest:
            value = np.concatenate([h[n] for n in rest])
            own, key, at = (np.concatenate(x) for x in zip(*((ids[n][doc[n]], keys[n][doc[n]], pos[n]) for n in rest), strict=True))
            origin = np.repeat(np.arange(len(rest)), [len(pos[n]) for n in rest])
            order, later, head = _later(value, own, at)
            hit = later if ordered else ~(head & np.append(head[1:], True))
            order = order[hit]
            order = order[at[order] >= 0]
            order = order[np.argsort(origin[order], kind="stable")]
            edges = np.searchsorted(origin[order], np.arange(len(rest) + 1))
            for n, a, b in zip(rest, edges[:-1], edges[1:], strict=True):
                if b > a:
                    out.append((batch[n], *(x[order[a:b]] for x in (own, key, at))))
        return pa.table(
            {"batch": pa.array([x[0] for x in out], pa.int64())}
            | {c: pa.array([np.ascontiguousarray(x[k], t).tobytes() for x in out], pa.binary()) for k, (c, t) in enumerate((("ids", np.int64), ("keys", np.int64), ("pos", np.int32)), 1)}
        )

    return run


def _gather(table: pa.Table) -> pa.Table:
    """What all ranges answered to one batch -> id, key, positions."""
    own, key, at = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("ids", np.int64), ("keys", np.int64), ("pos", np.int32)))
    order = np.lexsort((at, key, own))
    own, key, at = own[order], key[order], at[order]
    edges = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (key[1:] != key[:-1]))) if len(own) else np.zeros(0, int)
    ends = np.append(edges[1:], len(own)).astype(int)
    return pa.table({"id": own[edges], "key": key[edges], "at": pa.array([at[a:b].tobytes() for a, b in zip(edges, ends, strict=True)], pa.binary())})


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(number, ids, keys, data, offsets, batch) of at most about BATCH_BYTES of text, a longer text alone."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, at = T.buffers(batch.column(2))
        for i, j in T.runs(at, BATCH_BYTES):
            part = batch.slice(i, j - i)
            number += 1
            yield number, part.column(0).to_numpy(), part.column(1).to_numpy(), data, at[i : j + 1], part


def _anchors(length: int, parts: int):
    size = length - PERIOD + 1
    at_cover = np.zeros(PERIOD, bool)
    at_cover[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, keys, data, at, _ in _batches(batches):
            found = []
            for i, j in T.runs(at, T.BLOCK):
                words = T.words_of(data, at[i : j + 1], _ALPHABET)
                value, whole = T.windows(words, size)
                if not len(value):
                    continue
                text = words.text
                pos = (np.arange(len(text)) - words.first[text])[: len(value)]
                n = np.diff(words.first)[text[: len(value)]]
                take = np.flatnonzero(whole & at_cover[pos % PERIOD] & (n >= length))
                found.append((value[take], (text[take] + i).astype(np.int32), pos[take].astype(np.int32)))
            if found and sum(len(f[0]) for f in found):
                yield from _send(number, found, ids, keys, parts, False)

    return run


def _windows(length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, keys, data, at, part in _batches(batches):
            found, hits = [], part.column(3)
            for i, j in T.runs(at, T.BLOCK):
                words = T.words_of(data, at[i : j + 1], _ALPHABET)
                value, whole = T.windows(words, length)
                if not len(value):
                    continue
                near = np.zeros(len(words.hash) + PERIOD + 1, np.int32)
                for k in range(i, j):
                    anchor = np.concatenate([np.frombuffer(x, np.int32) for x in hits[k].as_py()]) + int(words.first[k - i])
                    np.add.at(near, np.maximum(anchor - PERIOD + 1, words.first[k - i]), 1)
                    np.add.at(near, anchor + 1, -1)
                take = np.flatnonzero(whole & (np.cumsum(near)[: len(value)] > 0))
                text = words.text[take]
                found.append((value[take], (text + i).astype(np.int32), (take - words.first[text]).astype(np.int32)))
            if found and sum(len(f[0]) for f in found):
                yield from _send(number, found, ids, keys, parts, True)

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = T.buffers(batch.column(1))
            total, removed, kept = [], [], []
            for i, j in T.runs(at, T.BLOCK):
                words = T.words_of(data, at[i : j + 1], _ALPHABET)
                for k in range(i, j):
                    a, b = int(words.first[k - i]), int(words.first[k - i + 1])
                    starts = batch.column(2)[k].as_py() or []
                    gone = np.zeros(b - a + 1, np.int32)
                    for x in starts:
                        x = np.frombuffer(x, np.int32)
                        np.add.at(gone, x, 1)
                        np.add.at(gone, x + length, -1)
                    gone = np.cumsum(gone[:-1]) > 0
                    total.append(b - a)
                    removed.append(int(gone.sum()))
                    text = data[at[k] : at[k + 1]]
                    if removed[-1]:
                        stay = np.ones(len(text), bool)
                        begin = words.begin[a:b] - at[k]
                        until = np.append(begin[1:], len(text))
                        step = np.zeros(len(text) + 1, np.int32)
                        np.add.at(step, begin[gone], 1)
                        np.add.at(step, until[gone], -1)
                        stay = np.cumsum(step[:-1]) == 0
                        text = text[stay]
                    kept.append(text.tobytes())
            out = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(out, ["id", "n_words", "n_removed", "kept_text", "row"])

    return run


def remove_repeats(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_text, and row, a struct of the columns in `carry`.

    Words are maximal runs without ASCII white space. A word goes if a window of `length` words over it also starts
    earlier: in a smaller doc_id, or earlier in the same document. Windows are judged on the input. kept_text is the
    text without the removed words and the white space after each, else unchanged; null text gives an empty one.

    Texts below `length` words stay whole. Rows that repeat an id and a text have equal starts, so neither is earlier:
    both keep what one row would. Rows of one id with different texts are separate texts at equal rank. A null id
    ranks before all others. Other columns are not read. An empty table gives no rows. length must be PERIOD at least.
    """
    if length < PERIOD:
        raise ValueError(f"length must be at least {PERIOD}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"), carried(carry))
    parts = 1 + (base.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES

    def met(packed: DataFrame, ordered: bool) -> DataFrame:
        hits = packed.groupBy("part").applyInArrow(T.tidied_group(_meet(ordered)), "batch long, ids binary, keys binary, pos binary")
        hits = hits.groupBy("batch").applyInArrow(T.tidied_group(_gather), "id long, key long, at binary")
        return hits.groupBy("id", "key").agg(F.collect_list("at").alias("at"))

    anchors = met(base.mapInArrow(T.tidied(_anchors(length, parts)), _PACKED), False)
    repeats = met(base.join(anchors, ["id", "key"]).select("id", "key", "text", "at").mapInArrow(T.tidied(_windows(length, parts)), _PACKED), True)
    joined = base.join(repeats, ["id", "key"], "left").select("id", "text", "at", "row")
    out = joined.mapInArrow(T.tidied(_cut(length)), f"id long, n_words long, n_removed long, kept_text string, row {type_of(base, 'row')}")
    return out.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_text", *(["row"] if carry else []))
