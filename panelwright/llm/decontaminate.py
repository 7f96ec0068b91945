"""Benchmark decontamination with a generalised suffix automaton of the test items.

Documents stream through the automaton word by word; the state and the length of the longest match that ends at each
word say which windows of which items occur there. Only runs of words that the items contain are streamed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import tokens as T
from panelwright.llm.shared import carried, stored, type_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_WORDS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALPHABET = T.Alphabet(T.NOT_ALNUM, True)


class Automaton:
    """Suffix automaton of several word sequences; a state stands for substrings with the same occurrences."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._add(last, w)
        self.items: list[set[int]] = [set() for _ in self.next]
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for k, (_, words) in enumerate(items):
            state = 0
            for w in words:
                state = up = self.next[state][w]
                while up and k not in self.items[up]:
                    self.items[up].add(k)
                    up = self.link[up]
            if 0 < len(words) < window:
                while self.length[self.link[state]] >= len(words):
                    state = self.link[state]
                self.whole[state].append((len(words), k))
        self.names = [name for name, _ in items]
        self.shortest = min((min(window, len(w)) for _, w in items if w), default=window)
        self.short_up = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short_up[s] = s if self.whole[s] else self.short_up[self.link[s]]

    def _add(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = self._state({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, following: dict[int, int], link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        twin = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def scan(self, words: list[int]) -> Iterator[tuple[int, int, int, set[int]]]:
        """(position, longest match ending there, longest item window ending there or 0, items with windows there)."""
        state = length = 0
        step, link, size = self.next, self.link, self.length
        for at, w in enumerate(words):
            while state and w not in step[state]:
                state = link[state]
                length = size[state]
            if w in step[state]:
                state = step[state][w]
                length += 1
            if length < self.shortest:
                continue
            hit, found = 0, set()
            if length >= self.window:
                up = state
                while size[link[up]] >= self.window:
                    up = link[up]
                hit, found = self.window, set(self.items[up])
            up = self.short_up[state]
            while up:
                for n, k in self.whole[up]:
                    if n <= length:
                        hit = max(hit, n)
                        found.add(k)
                up = self.short_up[link[up]]
            yield at, length, hit, found


def _pass(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, vocabulary = block.value
        for batch in batches:
            data, at = T.buffers(batch.column(1))
            hits, items, longest = (batch.column(k).to_pylist() for k in (3, 4, 5))
            total = np.zeros(len(hits), np.int64)
            for i, j in T.runs(at, T.BLOCK):
                words = T.words_of(data, at[i : j + 1], _ALPHABET)
                total[i:j] = np.diff(words.first)
                if not len(vocabulary) or not len(words.hash):
                    continue
                text, ids = words.text, np.searchsorted(vocabulary, words.hash)
                ids[ids == len(vocabulary)] = 0
                known = vocabulary[ids] == words.hash
                edge = np.append(True, (known[1:] != known[:-1]) | (text[1:] != text[:-1]))
                cuts = np.append(np.flatnonzero(edge), len(ids))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if b - a < automaton.shortest or not known[a]:
                        continue
                    k = i + int(text[a])
                    base = int(a - words.first[text[a]])
                    spans, names = [], set()
                    for p, length, hit, found in automaton.scan(ids[a:b].tolist()):
                        longest[k] = max(longest[k], length)
                        if hit:
                            spans += [base + p - hit + 1, base + p + 1]
                            names |= found
                    if spans:
                        hits[k] = [*(hits[k] or []), *spans]
                        items[k] = sorted({*(items[k] or []), *(automaton.names[x] for x in names)})
            out = [batch.column(0), batch.column(1), pa.array(total), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64()), batch.column(6)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "text", "n_words", "hits", "items", "longest", "row"])

    return run


def _finish(scan):
    """The last block's scan and what follows from all hits, in one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan(batches):
            yield _judged(batch)

    return run


def _judged(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, at = T.buffers(batch.column(1))
    count, kept = [], []
    for k, hits in enumerate(batch.column(3).to_pylist()):
        text = data[at[k] : at[k + 1]]
        count.append(0)
        if hits:
            words = T.words_of(data, at[k : k + 2], _ALPHABET)
            step = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(step, np.array(hits[::2]), 1)
            np.add.at(step, np.array(hits[1::2]), -1)
            gone = np.cumsum(step[:-1]) > 0
            count[-1] = int(gone.sum())
            begin = words.begin - at[k]
            until = np.append(begin[1:], len(text))
            cut = np.zeros(len(text) + 1, np.int64)
            np.add.at(cut, begin[gone], 1)
            np.add.at(cut, until[gone], -1)
            text = text[np.cumsum(cut[:-1]) == 0]
        kept.append(text.tobytes())
    out = [batch.column(0), batch.column(2), pa.array(count, pa.int64()), batch.column(4), batch.column(5), pa.array(kept, pa.binary()).cast(pa.string()), batch.column(6)]
    return pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_hit", "items", "longest", "clean_text", "row"])


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, items, longest, clean_text, and row, a struct of `carry`.

    Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters. An item's windows are its
    `window`-word runs, or all of it if shorter; a document word inside an occurrence of one is hit. items: ids of the
    items with occurring windows, as strings, sorted; longest: the longest match of at least the shortest window;
    clean_text: the text without hit words and what follows each up to the next word.

    The items are the stated query set: blocks of about `block_words` words, by a hash of the id, are built into one
    automaton each and broadcast, one after the other, so the broadcast is bounded however many items there are.

    Null texts and null or wordless items have no words; an item without an id is left out; rows that repeat an item
    id count as one item. Rows of `docs` are judged each alone, null or repeated ids included. Other columns are not
    read. No documents: no rows; no items: nothing is hit.
    """
    spark = docs.sparkSession
    items = bench.select(F.col("item_id").cast("string").alias("name"), F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _LOWER), F.lit(WORD), F.lit(0)).alias("words")).filter("name is not null and size(words) > 0")
    n_words = items.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-n_words // block_words))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<bigint>").alias("hits"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).cast("long").alias("longest"), carried(carry))
    schema = out.schema
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k).orderBy("name", "words").collect()
        known = sorted({w for r in own for w in r["words"]})
        column = pa.array(known, pa.string())
        data, at = T.buffers(column)
        value = T.words_of(data, at, _ALPHABET).hash
        order = np.argsort(value)
        rank = {known[o]: n for n, o in enumerate(order)}
        automaton = Automaton([(r["name"], [rank[w] for w in r["words"]]) for r in own], window)
        scan = _pass(spark.sparkContext.broadcast((automaton, value[order])))
        if k + 1 < blocks:
            out = stored(out.mapInArrow(T.tidied(scan), schema), "scanned")
    out = out.mapInArrow(T.tidied(_finish(scan)), f"doc_id {type_of(docs, id_col)}, n_words long, n_hit long, items array<string>, longest long, clean_text string, row {type_of(out, 'row')}")
    out = out.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out if carry else out.drop("row")
