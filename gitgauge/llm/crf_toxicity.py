"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Token labels come from document labels by grouped counts over all labelled training documents: a word speaks for toxicity if the
lower bound of its share of toxic documents has ``LIFT`` times the odds of all documents, and is the strongest such word of a share of its toxic
documents or does not stand beside one stronger word most of the time, so the plain words of a much copied toxic text are not credited.
No number of words is set: word tables are joined, and only sampled chains reach the driver. Tokens with a credited word are labelled toxic. The field has two tags,
features of the word and its first letters hashed to ``DIM`` weights, and a transition matrix; it is fitted by gradient descent on a
bounded sample of chains of ``CHAIN`` tokens (parameter ``max_chains``). A text is read whole, as chains of that many tokens.
Forward-backward gives each token's marginal; their largest logit and the logarithm of their sum are calibrated to a document score by
logistic regression on a bounded sample of labelled training documents (``max_docs``). Tokens above one half are the offending spans.

Null texts count as empty and get the score of a text without tokens. A null doc_id is not held out and trains nothing, as it has no
label. Repeated labels: a document is toxic if any of its labels says so; null labels teach nothing. With no labels of either kind
all scores are 0. Repeated rows repeat; an empty table gives an empty result. Other columns are ignored.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import ascii_lower, plain_docs, slices, training_fold, written

DIM = 1 << 18
CHAIN = 128
MAX_CHAINS = 4_000
MAX_DOCS = 6_000
LIFT = 8.0  # odds of toxicity of a word over those of all documents
CONFIDENCE = 1.96  # standard deviations from the share to its lower bound
WINS = 0.1  # of a word's toxic documents, at least, it is the strongest word of
ONE_BESIDE = 0.5  # of a word's toxic documents, at most, have one and the same other word as the strongest
FOLDS = 5
MEMO_WORDS = 700_000
_TOKEN = re.compile(r"[^\W_]+")
SCORES = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
SCORES_DDL = "doc_id bigint, held_out boolean, score double, predicted int, spans array<struct<start: int, stop: int>>"


def tokens(text: str) -> list[str]:
    """Runs of letters and digits, with A-Z in lower case."""
    return _TOKEN.findall(ascii_lower(text))


def features(word: str):
    """Places of a word's features among DIM weights."""
    import xxhash
    return [xxhash.xxh32_intdigest(f.encode("utf-8", "surrogatepass")) % DIM for f in (word, "4" + word[:4], "5" + word[:5], "6" + word[:6])]


def _logaddexp(a, b):
    return np.logaddexp(a, b)


def forward_backward(e, trans, start):
    """Marginal logits of tag 1. e: (tokens, chains) emission of tag 1 over tag 0; trans[i, j]; start: log odds at the first token.

    r and b are log ratios of the forward and backward messages of the two tags, so two tags take one number.
    """
    t = e.shape[0]
    r, b = np.empty_like(e), np.zeros_like(e)
    (t00, t01), (t10, t11) = trans
    r[0] = start + e[0]
    for i in range(1, t):
        p = r[i - 1]
        r[i] = e[i] + _logaddexp(t01, t11 + p) - _logaddexp(t00, t10 + p)
    for i in range(t - 2, -1, -1):
        p = b[i + 1] + e[i + 1]
        b[i] = _logaddexp(t10, t11 + p) - _logaddexp(t00, t01 + p)
    return r + b, r, b


def padded(lengths):
    """Places of chain tokens in a (CHAIN, chains) matrix: for texts of so many tokens, each cut into chains of CHAIN."""
    lengths = np.asarray(lengths, np.int64)
    chains = -(-lengths // CHAIN)
    base = np.concatenate([[0], np.cumsum(chains)])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return at % CHAIN, base[owner] + at // CHAIN, owner, int(base[-1])


class Field:
    """Weights of a fitted field. Tokens after the end of a chain are told to be tag 0, which leaves the others as they are."""

    def __init__(self, weights, bias, trans, start, scale=(0.0, 0.0, 0.0)):
        self.weights, self.bias, self.trans, self.start, self.scale = weights, bias, trans, start, scale
        self.memo = {}

    def emissions(self, words):
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = float(self.weights[features(w)].sum()) + self.bias
        return np.fromiter(map(memo.__getitem__, words), np.float64, len(words))

    def logits(self, texts: list[list[str]]):
        """Marginal logits of all tokens, one after another, and the text each belongs to."""
        row, column, owner, n = padded([len(t) for t in texts])
        e = self.emissions([w for t in texts for w in t])
        grid = np.zeros((CHAIN, n))
        # chains of one length in one matrix need no padding; here a short chain is followed by free tokens whose messages
        # must not reach back, so they are fixed to tag 0 by a very low emission and paid for in the last real token
        grid[:] = -60.0
        grid[row, column] = e
        last = np.zeros((CHAIN, n), bool)
        ends = np.zeros(n, np.int64)
        np.maximum.at(ends, column, row)
        last[ends, np.arange(n)] = True
        short = ends < CHAIN - 1
        fix = self.trans[0][0] - self.trans[1][0]
        grid[ends[short], np.flatnonzero(short)] += fix
        m, _, _ = forward_backward(grid, self.trans, self.start)
        return m[row, column], owner

    def summary(self, texts):
        """Largest marginal logit and log of the sum of marginals of each text, and the logits."""
        m, owner = self.logits(texts)
        n = len(texts)
        most, total = np.full(n, -30.0), np.zeros(n)
        np.maximum.at(most, owner, m)
        np.add.at(total, owner, 1 / (1 + np.exp(-np.clip(m, -40, 40))))
        return np.clip(most, -30, 30), np.log(total + 1e-6), m, owner

    def score(self, most, total):
        a, b, c = self.scale
        return 1 / (1 + np.exp(-np.clip(a + b * most + c * total, -40, 40)))


def fit_field(chains, labels, rounds=30, rate=0.5, l2=1e-4):
    """Gradient descent (AdaGrad) on the likelihood of whole chains; chains are lists of words, labels lists of 0 and 1."""
    row, column, _, n = padded([len(c) for c in chains])
    vocabulary = {}
    index = np.array([vocabulary.setdefault(w, len(vocabulary)) for c in chains for w in c], np.int64)
    parts = np.array([features(w) for w in vocabulary], np.int64).reshape(-1, 4)
    y = np.array([t for c in labels for t in c], np.float64)
    grid_y = np.zeros((CHAIN, n))
    grid_y[row, column] = y
    real = np.zeros((CHAIN, n), bool)
    real[row, column] = True
    pairs = real[1:] & real[:-1]
    observed = np.array([[(pairs & (grid_y[:-1] == i) & (grid_y[1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    weights, bias, start = np.zeros(DIM), -4.0, 0.0
    trans = np.zeros((2, 2))
    seen, seen_t, seen_b, seen_s = np.full(DIM, 1e-8), np.full((2, 2), 1e-8), 1e-8, 1e-8
    field = Field(weights, bias, trans, start)
    for _ in range(rounds):
        e = (weights[parts].sum(axis=1) + bias)[index]
        grid = np.full((CHAIN, n), -60.0)
        grid[row, column] = e
        ends = np.zeros(n, np.int64)
        np.maximum.at(ends, column, row)
        short = ends < CHAIN - 1
        grid[ends[short], np.flatnonzero(short)] += trans[0, 0] - trans[1, 0]
        m, r, b = forward_backward(grid, trans, start)
        p = 1 / (1 + np.exp(-np.clip(m[row, column], -40, 40)))
        # pair marginals from the messages on both sides
        left, right = r[:-1], (b + grid)[1:]
        joint = np.stack([np.stack([trans[i, j] + i * left + j * right for j in (0, 1)]) for i in (0, 1)])
        joint -= joint.max(axis=(0, 1))
        joint = np.exp(joint)
        joint /= joint.sum(axis=(0, 1))
        expected = (joint * pairs).sum(axis=(2, 3))
        g = np.bincount(index, p - y, len(vocabulary))
        gw = np.bincount(parts.ravel(), np.repeat(g, 4), DIM) / n + l2 * weights
        gb, gt = (p - y).sum() / n, (expected - observed) / n + l2 * trans
        gs = float((1 / (1 + np.exp(-np.clip(m[0], -40, 40))) - grid_y[0]).sum()) / n
        seen += gw * gw
        seen_t += gt * gt
        seen_b += gb * gb
        seen_s += gs * gs
        weights -= rate * gw / np.sqrt(seen)
        trans -= rate * gt / np.sqrt(seen_t)
        bias -= rate * gb / np.sqrt(seen_b)
        start -= rate * gs / np.sqrt(seen_s)
        field = Field(weights, bias, trans, start)
    return field


def fit_scale(most, total, y, rounds=300):
    """Logistic regression of the document label on the two summaries, by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(y)), most, total])
    w = np.zeros(3)
    for _ in range(min(rounds, 30)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(3)
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return tuple(float(v) for v in w)


def labelled(docs, labels, label_col="toxic"):
    """doc_id, text, y of the training rows; each doc_id and text once. Held-out rows leave before the join."""
    y = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(
        "doc_id is not null and y is not null").groupBy("doc_id").agg(F.max((F.col("y") > 0).cast("int")).alias("y"))
    y = y.filter(training_fold("doc_id", FOLDS) != 0)
    rows = docs.filter(training_fold("doc_id", FOLDS) != 0).join(y, "doc_id")
    # each text once: copies of one text are one witness
    least = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return rows.join(least, "doc_id").select("doc_id", "text", "y")


def word_counts(rows):
    """word, n1, n0: toxic and other training documents that hold a word."""
    def words(batches):
        for batch in batches:
            found, y = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                own = set(tokens(text))
                found += own
                y += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(y, pa.int32())], names=["word", "y"])

    return rows.select("text", "y").mapInArrow(words, "word string, y int").groupBy("word").agg(
        F.sum("y").cast("bigint").alias("n1"), F.sum(1 - F.col("y")).cast("bigint").alias("n0"))


def strong_words(rows):
    """word, low: words whose share of toxic documents has a (Wilson) lower bound ``low`` of LIFT times the odds of all documents."""
    n1, n = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    odds = LIFT * n1 / (n - n1) if n1 < n else float("inf")
    m, p, z2 = F.col("n1") + F.col("n0"), F.col("n1") / (F.col("n1") + F.col("n0")), CONFIDENCE ** 2
    low = (p + z2 / 2 / m - CONFIDENCE * F.sqrt(p * (1 - p) / m + z2 / 4 / m / m)) / (1 + z2 / m)
    least = odds / (1 + odds) if odds < float("inf") else 2.0
    return word_counts(rows).select("word", low.alias("low")).filter((F.col("low") >= least) & (F.lit(n1) > 0))


def document_words(rows):
    """doc_id, h, word: distinct words of the toxic rows; h is a hash of the text."""
    def words(batches):
        for batch in batches:
            columns = [[], [], []]
            for doc_id, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text"))):
                for word in set(tokens(text)):
                    for column, value in zip(columns, (doc_id, h, word)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["doc_id", "h", "word"])

    return rows.filter("y = 1").select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(words, "doc_id bigint, h bigint, word string")


def lexicon(rows):
    """doc_id, h, word: the credited words of each toxic training document, however many there are."""
    held = written(document_words(rows).join(strong_words(rows), "word"), "strong")
    best = held.groupBy("doc_id", "h").agg(F.max(F.struct("low", "word"))["word"].alias("best"))
    beside = held.join(best, ["doc_id", "h"]).groupBy("word", "best").count()
    # one row a word and best word
    credited = beside.groupBy("word").agg(
        F.sum("count").alias("n"), F.sum(F.when(F.col("word") == F.col("best"), F.col("count")).otherwise(0)).alias("wins"),
        F.max(F.when(F.col("word") != F.col("best"), F.col("count")).otherwise(0)).alias("one"),
    ).filter((F.col("wins") >= WINS * F.col("n")) | (F.col("one") <= ONE_BESIDE * F.col("n"))).select("word")
    return held.select("doc_id", "h", "word").join(credited, "word")


def fit(docs, labels, label_col="toxic", max_chains=MAX_CHAINS, max_docs=MAX_DOCS):
    """The fitted field. Word counts cover all labelled training rows; the field and its scale are fitted on bounded samples."""
    spark = docs.sparkSession
    rows = written(labelled(docs, labels, label_col), "labelled")
    own = written(lexicon(rows).groupBy("doc_id", "h").agg(F.collect_set("word").alias("known")), "credited")  # at most the words of one document
    if own.isEmpty():
        n1, n = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
        flat = Field(np.zeros(DIM), -30.0, np.zeros((2, 2)), 0.0)
        flat.scale = (float(np.log((n1 + 0.5) / (n - n1 + 0.5))) if n else -40.0, 0.0, 0.0)
        return flat

    def chains(batches):
        import xxhash
        for batch in batches:
            kind, order, chain, marks = [], [], [], []
            for doc_id, text, y, known in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "y", "known"))):
                t, known = tokens(text), frozenset(known or ())
                for i in range(0, len(t), CHAIN):
                    c = t[i:i + CHAIN]
                    toxic = bool(y) and not known.isdisjoint(c)
                    if y and not toxic:
                        continue  # a toxic document's other chains may hold what the lexicon lacks
                    kind.append(int(toxic))
                    order.append(xxhash.xxh64_intdigest(f"{doc_id} {i}") - (1 << 63))
                    chain.append(c)
                    marks.append([int(w in known) for w in c])
            yield pa.RecordBatch.from_arrays([
                pa.array(kind, pa.int32()), pa.array(order, pa.int64()), pa.array(chain, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int32()))], names=["kind", "o", "chain", "marks"])

    marked = rows.withColumn("h", F.xxhash64("text")).join(own, ["doc_id", "h"], "left").select("doc_id", "text", "y", "known")
    cut = marked.mapInArrow(chains, "kind int, o bigint, chain array<string>, marks array<int>")
    sample = [r for kind in (1, 0) for r in cut.filter(F.col("kind") == kind).orderBy("o").limit(max_chains // 2).collect()]
    field = fit_field([r["chain"] for r in sample], [r["marks"] for r in sample])
    given = spark.sparkContext.broadcast((field.weights.astype(np.float32), field.bias, field.trans, field.start))

    def summaries(batches):
        own = Field(*given.value)
        for whole in batches:
            for batch in slices(whole):
                most, total, _, _ = own.summary([tokens(t) for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(most), pa.array(total), batch.column("y")], names=["most", "total", "y"])

    share_of = max(1, int(1_000_003 * min(1.0, max_docs / rows.count())))
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share_of)
    s = chosen.mapInArrow(summaries, "most double, total double, y int").collect()
    field.scale = fit_scale(np.array([r["most"] for r in s]), np.array([r["total"] for r in s]), np.array([r["y"] for r in s], float))
    return field


def spans_of(text: str, logits):
    """(start, stop) character offsets of runs of tokens whose marginal is above one half."""
    out = []
    for i, m in enumerate(_TOKEN.finditer(text)):
        if logits[i] > 0:
            if out and out[-1][2] == i - 1:
                out[-1] = (out[-1][0], m.end(), i)
            else:
                out.append((m.start(), m.end(), i))
    return [{"start": a, "stop": z} for a, z, _ in out]


def score(docs, field, spans=True):
    """doc_id, held_out, score, predicted, spans of every row of plain docs."""
    given = docs.sparkSession.sparkContext.broadcast((field.weights.astype(np.float32), field.bias, field.trans, field.start, field.scale))

    def run(batches):
        own = Field(*given.value)
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text").to_pylist()
                cut = [tokens(t) for t in texts]
                most, total, logits, owner = own.summary(cut)
                found = own.score(most, total)
                at = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
                marks = [spans_of(t, logits[at[i]:at[i + 1]]) if spans and most[i] > 0 else [] for i, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= 0.5).astype(np.int32)),
                    pa.array(marks, SCORES.field("spans").type)], schema=SCORES)

    held = F.coalesce(training_fold("doc_id", FOLDS) == 0, F.lit(False))
    return docs.withColumn("held_out", held).mapInArrow(run, SCORES_DDL)


def toxicity(docs, labels, id_col="doc_id", text_col="text", label_col="toxic", **bounds):
    """Fits on the labelled training rows and scores every row."""
    docs = plain_docs(docs, id_col, text_col)
    return score(docs, fit(docs, labels, label_col, **bounds))


def keep_clean(docs, labels, **bounds):
    """The input without the documents predicted toxic. Scores meet documents by doc_id; rows that share one go if any is toxic."""
    bad = toxicity(docs, labels, **bounds).filter("predicted = 1").select(F.col("doc_id").alias("_toxic")).distinct()
    return docs.join(bad, docs["doc_id"].cast("bigint") == F.col("_toxic"), "left_anti")
