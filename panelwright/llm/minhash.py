"""Near-duplicate groups by circulant MinHash and exact Jaccard verification.

One permutation (`sigma`) scatters the shingles over a ring of 2**32 places, a second one (`pi`) is applied after
turning the ring by 0, 1, 2, ... places: two permutations give every signature coordinate. Bands of coordinates make
buckets; all buckets that share their best-connected document form one group, and Jaccard similarity is computed
exactly on the full shingle sets inside blocks of a group. No pair of documents is ever a row: a block returns a
spanning forest of its links.

Large groups: a group is cut into blocks by number of documents and bytes. Each block, with the group's hub, is
resolved alone; what remains are documents outside the group's largest component, and only these meet the other
blocks. Every candidate pair is either compared or already connected, so no bucket has a cap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import tokens as T
from panelwright.llm.components import components
from panelwright.llm.shared import stored

BLOCK_DOCS = 512
BLOCK_BYTES = 8 << 20
MISS = 2e-7
_SLICE = 1 << 14


def plan(threshold: float) -> tuple[int, int]:
    """Rows and bands: a pair at the threshold shares no band with probability MISS at most."""
    rows = max(1, round(math.log(0.3) / math.log(threshold)))
    return rows, math.ceil(math.log(MISS) / math.log(1 - threshold**rows))


def _pi(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 32-bit integers, in place."""
    t = x >> np.uint32(16)
    x ^= t
    x *= np.uint32(0x7FEB352D)
    np.right_shift(x, np.uint32(15), out=t)
    x ^= t
    x *= np.uint32(0x846CA68B)
    np.right_shift(x, np.uint32(16), out=t)
    x ^= t
    return x


def signatures(values: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """size x texts: coordinate k of a text is min over its shingles of pi(sigma(shingle) + k)."""
    out = np.full((size, len(first) - 1), np.uint32(0xFFFFFFFF), np.uint32)
    place = (T.mix(values ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    for i, j in T.runs(first, _SLICE):
        for lo in range(int(first[i]), int(first[j]), 1 << 18):
            part = place[lo : min(lo + (1 << 18), int(first[j]))]
            if not len(part):
                continue
            starts = np.clip(first[i:j] - lo, 0, len(part))
            has = np.flatnonzero(np.minimum(first[i + 1 : j + 1] - lo, len(part)) > starts)
            for k in range(size):
                low = np.minimum.reduceat(_pi(part + np.uint32(k)), starts[has])
                out[k, i + has] = np.minimum(out[k, i + has], low)
    return out


def _fingerprints(words: int, rows: int, bands: int):
    alphabet = T.Alphabet(T.WHITE, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = T.buffers(batch.column(1))
            for i, j in T.runs(at, 4 * T.BLOCK):
                values, first = T.sets_of(T.words_of(data, at[i : j + 1], alphabet), words)
                n = np.diff(first)
                sums = [np.concatenate(([np.uint64(0)], np.cumsum(T.mix(values + np.uint64(s))))) for s in (1, 2)]
                c1, c2 = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
                sig = signatures(values, first, rows * bands).astype(np.uint64)
                keys = np.empty((j - i, bands), np.uint64)
                for b in range(bands):
                    key = np.full(j - i, np.uint64(b + 1))
                    for k in range(b * rows, (b + 1) * rows):
                        key = T.mix(key + sig[k])
                    keys[:, b] = key
                flat = pa.array(keys.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * bands, bands, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(np.diff(at[i : j + 1])), pa.array(c1), pa.array(c2), lists],
                    ["doc_id", "n_shingles", "n_bytes", "c1", "c2", "keys"],
                )

    return run


class Forest:
    """Union-find over 0..n-1, the smallest member at the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], np.int64)


def links_of(values: np.ndarray, first: np.ndarray, percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """Components of the sets by 100 * intersection >= percent * union, beyond those that `known` labels give."""
    n = np.diff(first)
    forest = Forest(len(n))
    if known is not None:
        _, lead, label = np.unique(known, return_index=True, return_inverse=True)
        for i, g in enumerate(label):
            forest.join(i, int(lead[g]))
    _, ids, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[ids] > 1
    ids = ids[shared]
    sums = np.concatenate(([0], np.cumsum(shared)))
    begin = sums[first]
    order = np.argsort(n, kind="stable")
    sizes = n[order]
    mark = np.zeros(len(count), np.int32)
    roots, changed = forest.roots(), False
    for place, i in enumerate(order):
        if not n[i]:
            continue
        stop = int(np.searchsorted(sizes, n[i] * 100 // percent, "right"))
        if changed:
            roots, changed = forest.roots(), False
        others = order[place + 1 : stop]
        others = others[roots[others] != roots[i]]
        others = others[begin[others + 1] > begin[others]]
        if not len(others):
            continue
        own = ids[begin[i] : begin[i + 1]]
        mark[own] = 1
        length = begin[others + 1] - begin[others]
        to = np.cumsum(length)
        at = np.arange(int(to[-1])) + np.repeat(begin[others] - (to - length), length)
        common = np.add.reduceat(mark[ids[at]], to - length)
        mark[own] = 0
        for j in others[100 * common >= percent * (n[i] + n[others] - common)]:
            forest.join(int(i), int(j))
            changed = True
    return forest.roots()


def _resolve(words: int, percent: int):
    alphabet = T.Alphabet(T.WHITE, True)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc").combine_chunks()
        doc, known = table.column("doc").to_numpy(), table.column("known").to_numpy()
        data, at = T.buffers(table.column("text").combine_chunks())
        values, rows, seen = [], [], set()
        for k in range(len(doc)):
            v, _ = T.sets_of(T.words_of(data, at[k : k + 2], alphabet), words)
            if (what := (doc[k], hash(v.tobytes()))) not in seen:
                seen.add(what)
                values.append(v)
                rows.append(k)
        doc = doc[rows]
        roots = links_of(np.concatenate(values), np.cumsum([0, *map(len, values)]), percent, known[rows])
        new = doc[roots] != doc
        return pa.table({"a": doc[new], "b": doc[roots[new]]})

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are maximal runs without ASCII white space, A-Z lower-cased; a document's set holds its distinct
    `words`-word shingles, or the whole sequence if it has fewer words. Documents are linked if 100 * intersection >=
    percent * union. component_id is the smallest id reachable, kept says that it is the row's own id.

    Null or wordless text: 0 shingles, linked with nothing. Null id: component_id null, kept. Rows that repeat an id
    and a text get the same result each; rows of one id with different texts count as one document with the links
    of all its texts. Other columns are not read. An empty table gives no rows.
    """
    rows, bands = plan(percent / 100)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = stored(base.mapInArrow(T.tidied(_fingerprints(words, rows, bands)), "doc_id long, n_shingles long, n_bytes long, c1 long, c2 long, keys array<long>"), "fingerprints")
    full = seen.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("c1", "c2").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies")), "classes")
    lead = full.join(classes.select("c1", "c2", F.col("doc").alias("doc_id")), ["c1", "c2", "doc_id"], "left_semi").groupBy("doc_id", "c1", "c2", "n_bytes").agg(F.first("keys").alias("keys"))
    keys = stored(lead.select(F.col("doc_id").alias("doc"), "n_bytes", F.explode("keys").alias("key")), "keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    member = stored(keys.join(shared, "key"), "members")
    mass = member.groupBy("doc").agg(F.sum("n").alias("mass"))
    hubs = member.join(mass, "doc").groupBy("key").agg(F.min(F.struct(-F.col("mass"), F.col("doc"))).alias("h")).select("key", F.col("h.doc").alias("hub"))
    group = stored(member.join(hubs, "key").groupBy("hub", "doc").agg(F.max("n_bytes").alias("n_bytes")), "groups")
    size = group.groupBy("hub").agg(F.count("*").alias("docs"), F.sum("n_bytes").alias("bytes")).select("hub", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    size = stored(size, "sizes")
    placed = group.join(size, "hub").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    texts = base.filter("text is not null and doc_id is not null")

    def solve(cells: DataFrame, keys: list[str]) -> DataFrame:
        """cells: keys, doc, known -> links."""
        with_text = cells.join(texts, F.col("doc") == F.col("doc_id")).select(*keys, "doc", "known", "text")
        return with_text.groupBy(*keys).applyInArrow(T.tidied_group(_resolve(words, percent)), "a long, b long")

    hub_rows = size.filter("blocks > 1").select("hub", F.col("hub").alias("doc"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    cells = placed.select("hub", "doc", "block").unionAll(hub_rows.select("hub", "doc", "block")).distinct().withColumn("known", F.col("doc"))
    links = stored(solve(cells, ["hub", "block"]), "links")
    big = stored(placed.filter("blocks > 1").select("hub", "doc", "block", "blocks", "n_bytes"), "big")
    if big.limit(1).count():
        label = components(links)
        named = big.join(label, big["doc"] == label["node"], "left").withColumn("known", F.coalesce("component", "doc")).select("hub", "doc", "block", "blocks", "n_bytes", "known")
        named = stored(named, "named")
        main = named.groupBy("hub", "known").agg(F.count("*").alias("n")).groupBy("hub").agg(F.max(F.struct("n", "known")).alias("m")).select("hub", F.col("m.known").alias("main"))
        minor = named.join(main, "hub").filter("known <> main")
        parts = minor.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).cast("int").alias("parts"))
        minor = minor.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("parts")).cast("int"))
        every = named.join(parts, "hub").select("hub", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "doc", "known")
        more = minor.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", "doc", "known")
        links = links.unionAll(solve(every.unionAll(more).distinct(), ["hub", "block", "part"])).unionAll(label.select(F.col("node").alias("a"), F.col("component").alias("b")))
    label = components(links)
    found = classes.join(label, classes["doc"] == label["node"], "left").select("c1", "c2", F.coalesce("component", "doc").alias("component"))
    out = seen.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("c1")).alias("c1"), "c2").join(found, ["c1", "c2"], "left")
    group_of = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", group_of.alias("component_id"), F.coalesce(group_of == F.col("doc_id"), F.lit(True)).alias("kept"))
