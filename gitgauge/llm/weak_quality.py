"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (0) or nothing (-1) on every document. Expectation-maximisation estimates the
share of good documents and each labeller's rates of votes on good and on bad ones, from the counts of all vote patterns over all
documents. The posterior of a document's pattern labels it, and these labels train a logistic scorer over hashed words and vote-free
text features, on a bounded sample (parameter ``max_docs``); the scorer then scores every whole text.

Null texts count as empty. Labellers vote bad on an empty text. Null ids are kept. Repeated rows repeat and count as often. An empty
table gives an empty result. Other columns are ignored.
"""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import plain_docs, slices, tokens_of, written

DIM = 1 << 18
MAX_DOCS = 8_000
MEMO_WORDS = 700_000  # words whose places a worker keeps; changes no result
_PLACES = {}
ROUNDS = 100
_SYMBOL = re.compile(r"[^\w\s.,;:'\"!?()\-]")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT, _LETTER = re.compile(r"\d"), re.compile(r"[^\W\d_]")
LABELLERS = ("length", "letters", "symbols", "word_length", "repeated_words", "repeated_lines", "sentence_ends", "shouting")


def measures(text: str, words):
    """Figures of a whole text that the labellers judge."""
    n = max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if counts else 0
    return {
        "words": len(words), "letters": sum(map(len, _LETTERS.findall(text))) / n, "symbols": len(_SYMBOL.findall(text)) / max(1, len(words)),
        "word_length": sum(map(len, words)) / max(1, len(words)), "distinct": len(counts) / max(1, len(words)), "top": top / max(1, len(words)),
        "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)), "ends": sum(text.count(c) for c in ".!?") / max(1, len(words)),
        "upper": _upper(text) / n,
    }


def _upper(text):
    if text.isascii():
        b = np.frombuffer(text.encode(), np.uint8)
        return int(((b >= 65) & (b <= 90)).sum())
    return sum(map(str.isupper, text))


def votes(m) -> list[int]:
    """One vote a labeller; -1 where a figure says little."""
    def between(x, low, high, bad_low, bad_high):
        return 1 if low <= x <= high else 0 if x < bad_low or x > bad_high else -1

    few = m["words"] < 30  # shares of a short text say little
    return [
        between(m["words"], 40, 50_000, 8, 200_000), between(m["letters"], 0.7, 0.95, 0.6, 0.99),
        1 if m["symbols"] < 0.02 else 0 if m["symbols"] > 0.1 else -1, between(m["word_length"], 3, 9, 2.2, 13),
        -1 if few else 0 if m["top"] > 0.2 or m["distinct"] < 0.1 else 1, -1 if few else 0 if m["repeated_lines"] > 0.3 else 1,
        0 if m["ends"] == 0 or m["ends"] > 0.5 else -1 if m["ends"] > 0.25 else 1, 0 if m["upper"] > 0.3 else 1 if m["upper"] < 0.1 else -1,
    ]


def em(patterns: dict, rounds=ROUNDS):
    """(share of good, rates (2, labellers, 3)) from {votes: count}. Rates start from labellers that are right four times in five."""
    v = np.array(list(patterns), np.int64).reshape(-1, len(LABELLERS)) + 1
    n = np.array(list(patterns.values()), np.float64)
    share = 0.8
    rates = np.empty((2, len(LABELLERS), 3))
    rates[0] = (0.3, 0.55, 0.15)
    rates[1] = (0.3, 0.05, 0.65)
    place = np.arange(len(LABELLERS))
    for _ in range(rounds):
        good = posterior(v, share, rates)
        if len(n):
            share = (float((good * n).sum()) + 8) / (float(n.sum()) + 10)
        for kind, w in ((0, (1 - good) * n), (1, good * n)):
            sums = np.stack([np.bincount(v[:, j], w, 3) for j in place]) if len(n) else np.zeros((len(LABELLERS), 3))
            prior = 5 * np.array([(0.3, 0.55, 0.15), (0.3, 0.05, 0.65)][kind])
            rates[kind] = (sums + prior) / (sums.sum(axis=1, keepdims=True) + 5)
    return share, rates


def posterior(v, share, rates):
    """Probability of good of votes + 1, (rows, labellers)."""
    place = np.arange(v.shape[1])
    logs = [np.log(rates[k][place, v]).sum(axis=1) for k in (0, 1)]
    d = logs[1] - logs[0] + np.log(share / (1 - share))
    return 1 / (1 + np.exp(-np.clip(d, -40, 40)))


def _place(word: str):
    """Hashed places of a word and of its shape."""
    import xxhash
    shape = "aaa" if word.isalpha() and len(word) > 2 else _LETTER.sub("a", _DIGIT.sub("0", word))[-3:]
    return tuple(xxhash.xxh32_intdigest(k.encode("utf-8", "surrogatepass")) % DIM for k in ("w" + word, "s" + shape))


def places(words):
    """Hashed places and values of the features of the scorer: words and shapes of the whole text, of unit length."""
    import xxhash
    if len(_PLACES) > MEMO_WORDS:
        _PLACES.clear()
    counts = Counter(words)
    at, shapes = [], {}
    for w, c in counts.items():
        if w not in _PLACES:
            _PLACES[w] = _place(w)
        word, shape = _PLACES[w]
        at.append(word)
        shapes[shape] = shapes.get(shape, 0) + c
    at += shapes
    at.append(xxhash.xxh32_intdigest(f"n{len(words).bit_length()}") % DIM)
    x = np.log1p(np.array([*counts.values(), *shapes.values(), 0], np.float64))
    x /= np.sqrt((x * x).sum()) or 1.0
    x[-1] = 0.5
    return np.array(at, np.int64), x


def fit_scorer(rows, rounds=8, rate=0.5, l2=1e-5):
    """Logistic regression with soft labels by stochastic gradient steps; rows of (places, values, label) in a fixed order."""
    w, seen, bias = np.zeros(DIM), np.full(DIM, 1e-6), 0.0
    for k in range(rounds):
        for at, x, y in rows:
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x + bias, -30, 30)))
            g = (p - y) * x + l2 * w[at]
            seen[at] += g * g
            w[at] -= rate * g / np.sqrt(seen[at] + 1e-3)
            bias -= 0.05 * (p - y) / (k + 1)
    return w.astype(np.float32), bias


def quality(docs, id_col="doc_id", text_col="text", max_docs=MAX_DOCS):
    """doc_id, votes, posterior (of the vote pattern), score (of the scorer), keep (score of one half or more)."""
    spark = docs.sparkSession
    docs = plain_docs(docs, id_col, text_col)
    schema = pa.schema([("votes", pa.list_(pa.int32()))])

    def vote(batches):
        for batch in batches:
            found = [votes(measures(t, tokens_of(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], schema=schema)

    # one row a pattern of votes: at most 3 ** labellers, whatever the number of documents
    counts = docs.select("text").mapInArrow(vote, "votes array<int>").groupBy("votes").count().collect()
    share, rates = em({tuple(r["votes"]): r["count"] for r in counts})

    # the sample: each text once, by hash, half by posterior below one half if there are as many
    def label(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            v = np.array([votes(measures(t, tokens_of(t))) for t in texts], np.int64).reshape(-1, len(LABELLERS)) + 1
            yield pa.RecordBatch.from_arrays([batch.column("text"), pa.array(posterior(v, share, rates))], names=["text", "y"])

    order = F.xxhash64("text")
    total = sum(r["count"] for r in counts)
    share_of = max(1, int(1_000_003 * min(1.0, 4 * max_docs / max(1, total))))
    least = docs.select("text").filter(F.length("text") > 0).filter(F.pmod(order, F.lit(1_000_003)) < share_of).distinct()
    pool = written(least.mapInArrow(label, "text string, y double").withColumn("o", order), "labels")
    bad = pool.filter("y < 0.5").orderBy("o").limit(max_docs // 2)
    good = pool.filter("y >= 0.5").orderBy("o").limit(max_docs // 2)
    feature = pa.schema([("at", pa.list_(pa.int64())), ("x", pa.list_(pa.float64())), ("y", pa.float64())])

    def features(batches):
        for batch in batches:
            found = [places(tokens_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.list_(pa.float64())), batch.column("y")], schema=feature)

    sample = bad.unionByName(good).orderBy("o").mapInArrow(features, "at array<bigint>, x array<double>, y double")
    w, bias = fit_scorer([(np.array(r["at"]), np.array(r["x"]), r["y"]) for r in sample.collect()])
    shared = spark.sparkContext.broadcast((w, bias, share, rates))
    result = pa.schema([("doc_id", pa.int64()), ("votes", pa.list_(pa.int32())), ("posterior", pa.float64()), ("score", pa.float64()), ("keep", pa.int32())])

    def score(batches):
        w, bias, share, rates = shared.value
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text").to_pylist()
                cut = [tokens_of(t) for t in texts]
                v = [votes(measures(t, c)) for t, c in zip(texts, cut)]
                post = posterior(np.array(v, np.int64).reshape(-1, len(LABELLERS)) + 1, share, rates)
                z = np.array([w[at] @ x + bias for at, x in map(places, cut)])
                s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(v, pa.list_(pa.int32())), pa.array(post), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema=result)

    return docs.mapInArrow(score, "doc_id bigint, votes array<int>, posterior double, score double, keep int")
