import random

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import pseudolikelihood as M
from panelwright.llm import tokens as T


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    w = {k: v.astype(float) + rng.normal(0, 0.05, v.shape) for k, v in M.start().items()}
    context, word = rng.integers(0, 50, (40, 4)), rng.integers(0, M.VOCABULARY, 40)
    grads: dict = {}
    M.forward(w, context, word, grads)
    c, k = divmod(int(word[0]), M.CLASSES)
    for name, at in (("embed", (int(context[0, 0]), 3)), ("place", (1, 2)), ("shift", (4,)), ("to_class", (3, c)), ("class_bias", (c,)), ("to_word", (c, 2, k)), ("word_bias", (c, k))):
        ends = []
        for step in (1e-5, -2e-5):
            w[name][at] += step
            ends.append(-M.forward(w, context, word).mean())
        w[name][at] += 1e-5
        assert abs((ends[0] - ends[1]) / 2e-5 - grads[name][at]) < 1e-6, name


def test_probabilities_of_all_words_sum_to_one():
    w = M.start()
    context = np.tile(np.array([[1, 2, 3, M.VOCABULARY]], np.int32), (M.VOCABULARY, 1))
    assert abs(np.exp(M.forward(w, context, np.arange(M.VOCABULARY, dtype=np.int32))).sum() - 1) < 1e-3


def test_contexts_stay_within_a_text():
    data, at = T.buffers(pa.array(["a b c", "d", None, "e f"]))
    context, word, text = M.examples(data, at)
    out, n = M.VOCABULARY, word.tolist()
    assert text.tolist() == [0, 0, 0, 1, 3, 3]
    assert context.tolist() == [[out, out, n[1], n[2]], [out, n[0], n[2], out], [n[0], n[1], out, out], [out] * 4, [out, out, n[5], out], [out, n[4], out, out]]


def test_training_tells_likely_texts_from_shuffled_ones(spark, frame, monkeypatch):
    rng = random.Random(6)
    nouns, verbs = ["river", "stone", "cloud", "meadow"], ["sees", "meets", "leaves"]
    line = lambda: f"the {rng.choice(nouns)} {rng.choice(verbs)} a {rng.choice(nouns)} ."
    texts = [" ".join(line() for _ in range(60)) for _ in range(120)]
    uniform = M.flat(M.start())
    assert not (M.train(frame(list(enumerate(texts))).repartition(3)) == uniform).all()
    monkeypatch.setattr(M, "BATCH", 128)
    trainer = M.Trainer(M.start())
    data, at = T.buffers(pa.array(texts))
    trainer.take(*M.examples(data, at)[:2])
    weights = M.flat(trainer.weights)
    good = texts[0].split()
    bad = rng.sample(good, len(good))
    rows = [(1, " ".join(good)), (2, " ".join(bad)), (None, None), (3, ""), (3, ""), (4, "the " * 60_000)]
    got = {r.doc_id: r for r in M.score(frame(rows).selectExpr("doc_id", "text", "1 as perplexity", "2 as n_words"), weights).collect()}
    assert got[1].n_words == got[2].n_words == 360 and got[1].perplexity < 0.7 * got[2].perplexity < M.VOCABULARY
    assert (got[None].n_words, got[None].log_likelihood, got[None].perplexity) == (0, 0.0, None) and got[3].perplexity is None and got[4].n_words == 60_000
    assert (M.train(frame([])) == uniform).all() and M.score(frame([]), weights).count() == 0


def test_trained_weights_tell_words_of_the_corpus_from_shuffled_and_unseen_ones(spark, frame):
    rng = random.Random(7)
    nouns, verbs = ["river", "stone", "cloud", "meadow"], ["sees", "meets", "leaves"]
    line = lambda: f"the {rng.choice(nouns)} {rng.choice(verbs)} a {rng.choice(nouns)} ."
    texts = [" ".join(line() for _ in range(60)) for _ in range(4000)]
    corpus = frame(list(enumerate(texts))).repartition(2)
    weights, words = M.train(corpus), M.vocabulary(corpus)
    assert words.count() == 10 and {r.n for r in words.collect()} >= {240_000}
    good = texts[0].split()
    # a word never seen for each word of the corpus, in the same bucket
    bucket = lambda w: int(M.examples(*T.buffers(pa.array([w])))[1][0])
    other, k = {}, 0
    wanted = {bucket(w): w for w in set(good)}
    while len(other) < len(wanted):
        k += 1
        if (w := wanted.get(bucket(f"q{k}"))) is not None:
            other.setdefault(w, f"q{k}")
    half = [w if i % 2 else other[w] for i, w in enumerate(good)]
    rows = [(1, " ".join(good)), (2, " ".join(rng.sample(good, len(good)))), (3, " ".join(other[w] for w in good)), (4, " ".join(half)), (5, None)]
    got = {r.doc_id: r for r in M.score(frame(rows), weights, words=words).collect()}
    assert got[1].perplexity < 0.7 * got[2].perplexity and got[1].perplexity < 0.1 * got[4].perplexity < 0.01 * got[3].perplexity
    assert got[3].n_words == 360 and got[5].log_likelihood == 0


def test_word_probabilities_are_those_of_the_counts(frame, monkeypatch):
    texts = ["a b a c", "a d", "B e f a"]
    weights = M.flat(M.start())
    words = M.vocabulary(frame(list(enumerate(texts))))
    of = lambda t: T.words_of(*T.buffers(pa.array(t)), M._ALPHABET).hash.view(np.int64).tolist()
    every = of([" ".join(texts)])
    counts = {w: every.count(w) for w in every}
    assert {r.word: r.n for r in words.collect()} == counts
    probe = [(1, "a c zz"), (1, "zz"), (None, "b b")]
    for hot in (1 << 16, 5, 0):
        monkeypatch.setattr(M, "HOT", hot)
        got = sorted((r.n_words, r.log_likelihood) for r in M.score(frame(probe), weights, words=words).collect())
        expect = []
        for _, t in probe:
            context, bucket, _ = M.examples(*T.buffers(pa.array([t])))
            total = M.forward(M.shaped(weights), context, bucket).sum()
            for w, b in zip(of([t]), bucket, strict=True):
                own = [counts[x] for x in counts if (x >> 32) % (1 << 32) % M.VOCABULARY == b]
                total += np.log((counts.get(w, 0) + M.ADDED) / (sum(own) + M.ADDED * (2 * len(own) + 1)))
            expect.append((len(t.split()), total))
        assert np.allclose(got, sorted(expect), rtol=1e-5), hot


def test_scores_match_a_plain_version(frame, monkeypatch):
    """Each word alone, in plain Python: both softmax steps from the weights, then its share of a shared bucket."""
    rng = np.random.default_rng(2)
    w = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in M.start().items()}
    texts = ["a b a c d d", "b A a e f", "g h a b b"]
    words = M.vocabulary(frame(list(enumerate(texts))))
    hashed = lambda t: T.words_of(*T.buffers(pa.array([t])), M._ALPHABET).hash.view(np.int64).tolist()
    counts: dict = {}
    for t in texts:
        for x in hashed(t):
            counts[x] = counts.get(x, 0) + 1
    own = M.frequent(words, 3)
    assert own.tolist() == sorted(sorted(counts, key=lambda x: (-counts[x], x))[:3])
    place = lambda x: own.tolist().index(x) if x in own else len(own) + (x >> 32) % (1 << 32) % (M.VOCABULARY - len(own))
    soft = lambda z, k: z[k] - np.log(np.exp(z).sum())
    probe = ["a b c zz a", "zz", "", "h g f e d c b a a a b"]
    expect = []
    for t in probe:
        xs, total = hashed(t), 0.0
        for k, x in enumerate(xs):
            hidden = w["shift"].astype(float)
            for p, o in enumerate(M.OFFSETS):
                hidden = hidden + w["embed"][place(xs[k + o]) if 0 <= k + o < len(xs) else M.VOCABULARY] * w["place"][p]
            hidden = np.tanh(hidden)
            c, inner = divmod(place(x), M.CLASSES)
            total += soft(hidden @ w["to_class"] + w["class_bias"], c) + soft(hidden @ w["to_word"][c] + w["word_bias"][c], inner)
            if x not in own:
                mates = [n for y, n in counts.items() if y not in own and place(y) == place(x)]
                total += np.log((counts.get(x, 0) + M.ADDED) / (sum(mates) + M.ADDED * (2 * len(mates) + 1)))
        expect.append(total)
    for hot in (1 << 16, 0):
        monkeypatch.setattr(M, "HOT", hot)
        got = {r.doc_id: r.log_likelihood for r in M.score(frame(list(enumerate(probe))), M.flat(w), words=words, own=own).collect()}
        assert [got[k] for k in range(len(probe))] == pytest.approx(expect, rel=1e-4), hot


def test_frequent_words_are_told_apart_by_their_context(spark, frame):
    """Two frequent words in each other's places cost likelihood: what is predicted is the word, not only its bucket."""
    rng = random.Random(8)
    line = lambda: rng.choice(("old river runs north today .", "young meadow blooms late again ."))
    texts = [" ".join(line() for _ in range(60)) for _ in range(3000)]
    corpus = frame(list(enumerate(texts))).repartition(2)
    words = M.vocabulary(corpus)
    own = M.frequent(words)
    weights = M.train(corpus, own=own)
    good = texts[0]
    swapped = good.replace("river", "?").replace("meadow", "river").replace("?", "meadow")
    got = {r.doc_id: r.perplexity for r in M.score(frame([(1, good), (2, swapped)]), weights, words=words, own=own).collect()}
    assert len(own) == 11 and got[1] < 0.5 * got[2]
