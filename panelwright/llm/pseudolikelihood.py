"""Masked pseudo-likelihood of texts by a small bidirectional window network, trained in numpy over the whole corpus.

The OWN most frequent words of the corpus have an output and an embedding each; any other word falls into one of the
buckets of its hash that are left of VOCABULARY. The network sees the words or buckets of two words on either side, weighs
their embeddings by position, and predicts the word or bucket in two softmax steps: its class, then its place in the class.
Training is data-parallel: in each round every task starts from the same weights, takes one pass of mini-batches over its
documents of that round and sends its weights in blocks; their means, weighted by words and formed in two steps of
grouping, start the next round. Every document is trained on once.

Which word of a shared bucket it is comes from a table of the corpus's words and counts, which grows with the corpus and is
joined by word; only the words that are at least one in HOT of all, never more than HOT, are broadcast. A text's score is
the sum over its words of log P(word or bucket | both sides) + log P(word | bucket); a word of its own has no second part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import tokens as T
from panelwright.llm.shared import stored, type_of

CLASSES = 48
VOCABULARY = CLASSES * CLASSES
OWN = VOCABULARY * 2 // 3
WIDTH = 16
OFFSETS = (-2, -1, 1, 2)
BATCH = 16384
RATE = 0.15
LIMIT = 4.0
ROUNDS = 2
FLOATS = 1024
SALTS = 64
HOT = 1 << 16
ENTRIES = 1 << 20
#: Added to each count; a bucket counts as having as many unseen words as seen ones, and one more.
ADDED = 0.1
_ALPHABET = T.Alphabet(T.WHITE, True)
#: name -> shape; buckets have one more embedding, for what lies outside a text.
SHAPES = {
    "embed": (VOCABULARY + 1, WIDTH),
    "place": (len(OFFSETS), WIDTH),
    "shift": (WIDTH,),
    "to_class": (WIDTH, CLASSES),
    "class_bias": (CLASSES,),
    "to_word": (CLASSES, WIDTH, CLASSES),
    "word_bias": (CLASSES, CLASSES),
}


def start(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {k: rng.normal(0, 0.1, s).astype(np.float32) if k in ("embed", "to_class", "to_word") else np.zeros(s, np.float32) for k, s in SHAPES.items()}
    out["place"] += 1
    return out


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].reshape(-1) for k in SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def _predict(logits: np.ndarray, right: np.ndarray, share: float | None) -> tuple[np.ndarray, np.ndarray]:
    """log P of the right column per row; with a share per row, also the gradient of the loss, in place of the logits.

    Weights are kept within LIMIT, so exp() of a logit stays finite.
    """
    rows = np.arange(len(right))
    own = logits[rows, right]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], np.float32)
    if share is not None:
        logits *= (share / total)[:, None]
        logits[rows, right] -= share
    return own - np.log(total), logits


def forward(w: dict[str, np.ndarray], context: np.ndarray, word: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """log P(word | context) per row; context is rows x offsets. With `grads`, fills in those of the mean loss."""
    n = len(word)
    share = None if grads is None else 1 / n
    seen = [w["embed"].take(context[:, p], 0) for p in range(len(OFFSETS))]
    hidden = w["shift"] + seen[0] * w["place"][0]
    for p in range(1, len(OFFSETS)):
        hidden += seen[p] * w["place"][p]
    np.tanh(hidden, out=hidden)
    of, within = (word // CLASSES).astype(np.int16), word % CLASSES
    out, error = _predict(hidden @ w["to_class"] + w["class_bias"], of, share)
    back = None
    if grads is not None:
        grads["to_class"], grads["class_bias"] = hidden.T @ error, error.sum(0)
        back = error @ w["to_class"].T
        grads["to_word"], grads["word_bias"] = np.zeros(SHAPES["to_word"], np.float32), np.zeros(SHAPES["word_bias"], np.float32)
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        rows = order[cuts[c] : cuts[c + 1]]
        if not len(rows):
            continue
        h = hidden.take(rows, 0)
        more, error = _predict(h @ w["to_word"][c] + w["word_bias"][c], within[rows], share)
        out[rows] += more
        if back is not None:
            grads["to_word"][c], grads["word_bias"][c] = h.T @ error, error.sum(0)
            back[rows] += error @ w["to_word"][c].T
    if back is not None:
        back *= 1 - hidden * hidden
        grads["shift"] = back.sum(0)
        grads["place"] = np.stack([np.einsum("ij,ij->j", back, x) for x in seen])
        # a place's weight is the same for all rows, so it multiplies the sums
        columns = np.ascontiguousarray(back.T)
        embed = np.zeros((WIDTH, VOCABULARY + 1))
        for p in range(len(OFFSETS)):
            ids = np.ascontiguousarray(context[:, p])
            for k in range(WIDTH):
                embed[k] += w["place"][p, k] * np.bincount(ids, columns[k], VOCABULARY + 1)
        grads["embed"] = embed.T.astype(np.float32)
    return out


#: Without words of their own.
NONE = np.zeros(0, np.int64)


def buckets(hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The place of each word among its own, sorted, or else a bucket after them, by its hash."""
    out = (len(own) + ((hashes >> np.uint64(32)) % np.uint64(VOCABULARY - len(own)))).astype(np.int32)
    if len(own):
        word = hashes.view(np.int64)
        place = np.minimum(np.searchsorted(own, word), len(own) - 1)
        out = np.where(own[place] == word, place, out).astype(np.int32)
    return out


def examples(data: np.ndarray, at: np.ndarray, own: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, bucket, text) of every word of a run of texts."""
    return _examples(T.words_of(data, at, _ALPHABET), own)


def _examples(words: T.Words, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bucket, text = buckets(words.hash, own), words.text
    context = np.full((len(bucket), len(OFFSETS)), VOCABULARY, np.int32)
    for p, o in enumerate(OFFSETS):
        here = np.arange(max(0, -o), len(bucket) - max(0, o))
        here = here[text[here] == text[here + o]]
        context[here, p] = bucket[here + o]
    return context, bucket, text


class Trainer:
    """Adagrad over mini-batches, from given weights."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.weights = {k: v.copy() for k, v in weights.items()}
        self.sums = {k: np.full(s, 1e-6, np.float32) for k, s in SHAPES.items()}
        self.words = 0

    def take(self, context: np.ndarray, word: np.ndarray) -> None:
        for i in range(0, len(word), BATCH):
            grads: dict[str, np.ndarray] = {}
            forward(self.weights, context[i : i + BATCH], word[i : i + BATCH], grads)
            for k, g in grads.items():
                self.sums[k] += g * g
                self.weights[k] -= RATE * g / np.sqrt(self.sums[k])
                np.clip(self.weights[k], -LIMIT, LIMIT, out=self.weights[k])
        self.words += len(word)


def _train(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, own = shared.value
        trainer = Trainer(shaped(values))
        for batch in batches:
            data, at = T.buffers(batch.column(0))
            for i, j in T.runs(at, T.BLOCK):
                context, word, _ = examples(data, at[i : j + 1], own)
                trainer.take(context, word)
        if trainer.words:
            values = flat(trainer.weights)
            blocks = [values[a : a + FLOATS].tobytes() for a in range(0, len(values), FLOATS)]
            salt = TaskContext.get().partitionId() % SALTS
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array(range(len(blocks)), pa.int32()), "salt": pa.array([salt] * len(blocks), pa.int32()), "words": pa.array([float(trainer.words)] * len(blocks)), "weights": pa.array(blocks, pa.binary())}
            )

    return run


def _mean(table: pa.Table) -> pa.Table:
    words = table.column("words").to_numpy()
    total = sum(n * np.frombuffer(x, np.float32).astype(np.float64) for n, x in zip(words, table.column("weights").to_pylist(), strict=True))
    mean = (total / words.sum()).astype(np.float32).tobytes()
    return pa.table({"block": table.column("block")[:1], "salt": pa.array([0], pa.int32()), "words": pa.array([words.sum()]), "weights": pa.array([mean], pa.binary())})


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, own: np.ndarray = NONE) -> np.ndarray:
    """Weights after one pass over all texts; null texts have no words. Without any words, the starting weights.

    `own` are the words with an output each, as `frequent` gives them. Tasks train on their own partitions and their weights
    are averaged, so the weights depend on how the rows are dealt out.
    """
    spark = docs.sparkSession
    values = flat(start())
    kind = "block int, salt int, words double, weights binary"
    rows = docs.select(F.col(text_col).cast("string").alias("text")).filter("text is not null")
    for k in range(rounds):
        part = rows.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k)
        sent = part.mapInArrow(_train(spark.sparkContext.broadcast((values, own))), kind)
        mean = sent.groupBy("block", "salt").applyInArrow(_mean, kind).groupBy("block").applyInArrow(_mean, kind)
        got = {r["block"]: np.frombuffer(r["weights"], np.float32) for r in mean.collect()}
        if got:
            values = np.concatenate([got[b] for b in sorted(got)])
    return values


def _summed(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, sorted, and the sums of their counts."""
    word, of = np.unique(np.concatenate(words), return_inverse=True)
    return word, np.bincount(of, np.concatenate(counts), len(word)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    send = lambda word, n: pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], ["word", "n"])
    words, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        data, at = T.buffers(batch.column(0))
        for i, j in T.runs(at, T.BLOCK):
            word, n = np.unique(T.words_of(data, at[i : j + 1], _ALPHABET).hash.view(np.int64), return_counts=True)
            words.append(word)
            counts.append(n)
            if sum(map(len, words)) > ENTRIES:
                word, n = _summed(words, counts)
                words, counts = [word], [n]
                if len(word) > ENTRIES // 2:
                    yield send(word, n)
                    words, counts = [word[:0]], [n[:0]]
    yield send(*_summed(words, counts))


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n: how often each word occurs in all texts, written to the shared folder. A word is its 64-bit hash."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).filter("text is not null")
    counts = rows.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counts, "words")


def frequent(words: DataFrame, most: int = OWN) -> np.ndarray:
    """The `most` words with the highest counts, ties to the smaller hash; sorted."""
    top = words.orderBy(F.desc("n"), "word").limit(most).select("word").toArrow().column("word").to_numpy()
    return np.sort(top.astype(np.int64))


def _inside(words: DataFrame, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By bucket, log of what the counts of its words are divided by; the hot words, sorted, and log of their counts.

    The bucket of a word of its own holds that word only, so the two cancel.
    """
    total, seen = np.zeros(VOCABULARY), np.zeros(VOCABULARY)
    single = F.col("word").isin(own.tolist()) if len(own) else F.lit(False)
    for r in words.filter(single).collect():  # OWN rows at most
        total[np.searchsorted(own, r["word"])] = r["n"]
    bucket = (len(own) + F.pmod(F.shiftrightunsigned("word", 32), F.lit(VOCABULARY - len(own)))).alias("bucket")
    for r in words.filter(~single).groupBy(bucket).agg(F.sum("n").alias("n"), F.count("*").alias("seen")).collect():
        total[r["bucket"]], seen[r["bucket"]] = r["n"], r["seen"]
    hot = words.filter(F.col("n") * HOT >= int(total.sum())).toArrow()
    word, n = hot.column("word").to_numpy(), hot.column("n").to_numpy()
    order = np.argsort(word)
    return np.log(total + ADDED * (2 * seen + 1)), word[order], np.log(n[order] + ADDED)


def _score(shared, inside):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, own_words = shaped(shared.value[0]), shared.value[1]
        below, hot, above = inside.value
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, at = T.buffers(batch.column(1))
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            rare, ends = [np.zeros(0, np.int64)], np.zeros(batch.num_rows, np.int64)
            for i, j in T.runs(at, T.BLOCK):
                words = T.words_of(data, at[i : j + 1], _ALPHABET)
                context, bucket, text = _examples(words, own_words)
                for k in range(0, len(bucket), BATCH):
                    own = slice(k, k + BATCH)
                    total[i:j] += np.bincount(text[own], forward(weights, context[own], bucket[own]) - below[bucket[own]], j - i)
                n[i:j] += np.bincount(text, minlength=j - i)
                word = words.hash.view(np.int64)
                place = np.searchsorted(hot, word)
                known = place < len(hot)
                known[known] = hot[place[known]] == word[known]
                total[i:j] += np.bincount(text[known], above[place[known]], j - i)
                rare.append(word[~known])
                ends[i:j] = np.bincount(text[~known], minlength=j - i)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(ends))).astype(np.int32)), pa.array(np.concatenate(rare)))
            keys = pa.array(np.arange(key, key + batch.num_rows))
            key += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total), keys, lists], ["doc_id", "n_words", "inner", "key", "rare"])

    return run


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", words: DataFrame | None = None, own: np.ndarray = NONE) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, log_likelihood (sum over words, natural log), perplexity.

    Words are maximal runs without ASCII white space, A-Z lower-cased. `words` is the vocabulary of the training corpus;
    by default that of `docs`; `own` are the words with an output each that the weights were trained with. With n occurrences of a word, N of all words of its bucket and S distinct ones,
    P(word | bucket) = (n + ADDED) / (N + ADDED * (2 S + 1)); n is 0 for an unseen word. Null, empty and wordless texts: 0
    words, sum 0, perplexity null. Rows are scored each alone, null or repeated ids included. Other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    words = vocabulary(docs, text_col) if words is None else words
    run = _score(context.broadcast((weights, own)), context.broadcast(_inside(words, own)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = f"doc_id {type_of(docs, id_col)}, n_words long, inner double, key long, rare array<long>"
    # keys differ between runs of a task, so both sides of the last join read one stored copy
    rows = stored(rows.mapInArrow(run, kind), "scored")
    # in the corpus no word outside the hot ones is more than one in HOT, so none makes a large group
    rare = rows.select("key", F.explode("rare").alias("word")).join(words, "word", "left")
    rare = rare.groupBy("key").agg(F.sum(F.log(F.coalesce("n", F.lit(0)) + ADDED)).alias("more"))
    out = rows.drop("rare").join(rare, "key", "left")
    out = out.select("doc_id", "n_words", (F.col("inner") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood"))
    return out.withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(-F.col("log_likelihood") / F.col("n_words"))))
