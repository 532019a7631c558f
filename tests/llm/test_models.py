"""Scores, searches and classifiers against brute force or held-out rows."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gitgauge.llm import context_mixing, crf_toxicity, language_id, tput_topk, weak_quality
from gitgauge.llm.common import tokens_of


def held(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_lm_base_counts_and_scores(docs):
    given = [(i, t) for i, t in enumerate([None, "", "the cat the", "The  dog\n", "zebra", "café THE É"] * 5 + ["the cat sat on the mat " * 200])] + [(None, "the null id")]
    got = context_mixing.lm_score(docs(*given)).collect()
    assert len(got) == len(given)
    counts = Counter(w for i, t in given if i is not None and held(i, 7) != 2 for w in [*tokens_of(t or ""), ("end",)])
    n, v = sum(counts.values()), len(counts)
    by_id = {r.doc_id: r for r in got}
    for i, t in given:
        w = [*tokens_of(t or ""), ("end",)]
        r = by_id[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r.held_out == (i is not None and held(i, 7) == 2)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), abs_tol=1e-9, rel_tol=1e-9)
        assert r.score < 0
    empty = context_mixing.lm_score(docs())
    assert empty.count() == 0


def test_lm_learns(docs):
    text = "a rose is a rose and the rose is red "
    got = {r.doc_id: r for r in context_mixing.lm_score(docs(*[(i, text * 5) for i in range(60)], (1000, "qzx vjw kqp " * 15))).collect()}
    seen = [r.bits_per_byte for i, r in got.items() if i < 60 and r.held_out]
    assert seen and max(seen) < 1 < got[1000].bits_per_byte


def test_lm_weights_come_from_all_training_rows(docs, monkeypatch):
    """Every training row moves the weights, each row once, against lines that have not counted it."""
    given = [(i, f"text number {i} of a few " * 3) for i in range(40)]
    seen, fit = {}, context_mixing.fit_weights

    def watched(rows, lines, *more):
        seen["ids"] = {r.doc_id for r in rows.collect()}
        return fit(rows, lines, *more)

    monkeypatch.setattr(context_mixing, "fit_weights", watched)
    context_mixing.lm_score(docs(*given)).collect()
    assert seen["ids"] == {i for i, _ in given if held(i, 7) != 2}
    parts = context_mixing._steps(["a" * 10] * 9 + ["b" * 100, ""], 8)
    assert sorted(t for p in parts for t in p) == sorted(["a" * 10] * 9 + ["b" * 100, ""]) and len(parts) > 4
    mixed = docs((0, "aaaa"), (1, "bbbb")).withColumn("fit", F.col("doc_id") == 0)
    lines = {r.key: r for r in context_mixing.context_lines(mixed).collect()}
    own = context_mixing.contexts(context_mixing.joined(["aaaa"])[0])[0, :, context_mixing.PAD + 2:].ravel().view(np.int64).tolist()
    assert own and not any(any(lines[k].fit_line) for k in own) and all(lines[k].rest_line == lines[k].line for k in own)


def test_mixer_is_a_probability():
    """The probabilities of all next bytes sum to one, and blocks do not depend on their neighbours."""
    rng = np.random.default_rng(1)
    table = rng.integers(-40, 40, context_mixing.LINES * 16).astype(np.int8)
    table[::16] = table[::16] > 0
    mixer = context_mixing.Mixer(table)
    start = np.frombuffer(bytes(context_mixing.PAD) + b"some text", np.uint8)
    total, place = [], np.array([context_mixing.PAD])
    before = mixer.run(start, place, np.array([9]))[0]
    for b in range(256):
        total.append(mixer.run(np.append(start, np.uint8(b)), place, np.array([10]))[0] - before)
    assert math.isclose(sum(10 ** t for t in total), 1, rel_tol=1e-4)
    texts = ["one", "", "two words" * 400, "é"]
    assert np.allclose(mixer.run(*context_mixing.joined(texts)), [mixer.run(*context_mixing.joined([t]))[0] for t in texts], rtol=1e-4)


def brute_top(rows, k, step):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(e is not None and math.isfinite(e) for e in x):
            v[i] = [math.floor(64 * e) for e in x]
    out = []
    for q in v:
        if q % step == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:k]
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=7) * scale]) for i in range(150)]
    rows += [(i, [1.0, 1.0]) for i in range(150, 170)] + [(170, []), (171, None), (172, [1.0, None]), (173, [float("nan")]), (174, [float("inf")]), (None, [1.0])]
    table = spark.createDataFrame(rows + rows[:3], "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash"))
    got = tput_topk.top_k(table, F.col("vec_id") % 10 == 0, k=5, n_queries=4, n_candidates=40)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 5, 10)


def test_top_k_small_tables(spark):
    def run(*rows):
        table = spark.createDataFrame(list(rows), "vec_id bigint, embedding array<float>")
        return sorted(tuple(r) for r in tput_topk.top_k(table, F.col("vec_id") % 20 == 0).collect())

    assert run() == [] and run((20, [1.0])) == []
    rows = [(20, [1.0, -2.0]), (40, [0.5, 0.5]), (3, [-1.0, -1.0])]
    assert run(*rows) == brute_top(rows, 20, 20)


def test_top_k_cells_give_few_rows(spark):
    """What is above a share of the cutoff stays in its cell: no cell gives more than k rows a query, also among equal vectors."""
    rng = np.random.default_rng(5)
    rows = [(i, [1.0] * 4 if i % 2 else [float(x) for x in rng.normal(size=4)]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    v = tput_topk.vectors(table)
    query = v.filter("vec_id % 10 = 0").withColumn("cutoff", F.lit(1).cast("bigint"))
    given = tput_topk.above_cutoff(tput_topk._cells(v, query, 2, 3), 5, 2, 2)
    assert given.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 5 * 3
    got = tput_topk.top_k(table, F.col("vec_id") % 10 == 0, k=5, n_queries=20, n_candidates=150)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 5, 10)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    field = crf_toxicity.Field(np.zeros(crf_toxicity.DIM), 0.0, rng.normal(size=(2, 2)), 0.3)
    for n in (1, 2, 6):
        e = rng.normal(size=n) * 2
        words = [f"w{i}" for i in range(n)]
        field.memo = dict(zip(words, e))
        tags = list(itertools.product((0, 1), repeat=n))
        z = np.array([np.exp(field.start * y[0] + (e * y).sum() + sum(field.trans[y[i - 1]][y[i]] for i in range(1, n))) for y in tags])
        want = [sum(z[k] for k, y in enumerate(tags) if y[i]) / z.sum() for i in range(n)]
        m, _ = field.logits([words])
        assert np.allclose(1 / (1 + np.exp(-m)), want)


def test_toxicity_held_out(docs, spark):
    rng = np.random.default_rng(2)
    plain = [f"word{i}" for i in range(60)]
    rows, y = [], []
    for i in range(400):
        text = list(rng.choice(plain, 20))
        y.append(int(rng.random() < 0.3))
        if y[-1]:
            text.insert(int(rng.integers(20)), str(rng.choice(["Awful", "nasty", "vile"])))
        rows.append((i, " ".join(text)))
    labels = spark.createDataFrame([(i, t, "x") for i, t in enumerate(y)] + [(None, 1, "x"), (5, None, "x")], "doc_id bigint, toxic int, text string")
    got = {r.doc_id: r for r in crf_toxicity.toxicity(docs(*rows, (None, "vile"), (900, None), (901, "vile " * 3000)), labels).collect()}
    out = [i for i in range(400) if held(i, 5) == 0]
    assert len(out) > 40 and all(got[i].held_out == (held(i, 5) == 0) for i in range(400))
    assert np.mean([got[i].predicted == y[i] for i in out]) > 0.95
    hit = next(i for i in out if y[i])
    assert [rows[hit][1][s.start:s.stop].lower() for s in got[hit].spans][0] in ("awful", "nasty", "vile")
    assert got[None].predicted == 1 and not got[None].held_out and got[900].predicted == 0 and got[901].predicted == 1
    kept = crf_toxicity.keep_clean(docs(*rows), labels)
    assert kept.columns == docs().columns and {r.doc_id for r in kept.collect()} == {i for i in range(400) if not got[i].predicted}


def test_toxicity_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.predicted for r in crf_toxicity.toxicity(docs((1, "a")), none).collect()] == [0]
    assert crf_toxicity.toxicity(docs(), none).count() == 0


def test_language(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog are here", "en"), (2, "der hund und die katze sind hier", "de"), (3, None, "en"), (4, "x", None)], "doc_id bigint, text string, lang string")
    page = lambda lang, text: f'<html lang="{lang}"><script>der die das</script><body>{text}</body></html>'
    rows = [(i, f"https://www.seite{i % 3}.example.de/x", page("de", "der hund und die katze " * 20)) for i in range(20)]
    rows += [(i, f"http://site{i % 3}.example.com/x", page("en", "the cat and the dog " * 20)) for i in range(20, 40)]
    rows += [(50, "https://www.seite1.example.de/y", "<html></html>"), (51, "http://site1.example.com", page("en", "")), (52, None, None), (53, "no address", "der hund"),
             (54, "http://site1.example.com/z", page("de", "the cat and the dog are here " * 50)), (None, "http://a.b", "the dog and the cat " * 9)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, language string")
    got = {r.page_id: r for r in language_id.identify(pages, docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].language == ("de" if i < 20 else "en") for i in range(40))
    assert (got[50].language, got[51].language, got[53].language, got[54].language, got[None].language) == ("de", "en", "de", "en", "en")
    assert got[52].language in ("de", "en") and got[54].declared == "de" and got[50].host == "www.seite1.example.de"
    assert language_id.identify(pages.limit(0), docs).count() == 0
    assert {r.language for r in language_id.identify(pages, docs.limit(0)).collect()} == {None}


def test_quality(docs, spark, sf_dir):
    assert weak_quality.quality(docs()).count() == 0
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    extra = documents.limit(1).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = weak_quality.quality(documents.select("doc_id", "text").unionByName(extra)).collect()
    assert len(got) == documents.count() + 1
    assert [r.keep for r in got if r.doc_id is None] == [0]
    good, bad = ([r.score for r in got if labels.get(r.doc_id) == k] for k in (1, 0))
    assert np.mean([(np.array(bad) < s).mean() for s in good]) > 0.95
    assert np.mean([s >= 0.5 for s in good]) > 0.95


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.7
    acc = np.linspace(0.65, 0.95, len(weak_quality.LABELLERS))
    right = rng.random((len(y), len(acc))) < acc
    v = np.where(right, y[:, None], ~y[:, None]).astype(int)
    share, rates = weak_quality.em(Counter(map(tuple, v.tolist())))
    assert abs(share - 0.7) < 0.03 and np.allclose(rates[1][:, 2], acc, atol=0.03)


def test_lm_lines_are_exact_counts(docs, monkeypatch):
    """Every context of every model has a line of its own, however many there are, and lines hold the counts of their own context."""
    monkeypatch.setattr(context_mixing, "HELD_KEYS", 500)
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("abcdefgh é"), 300)) for _ in range(40)] + ["x" * 70 + "a", "x" * 71 + "b"]
    frame = docs(*enumerate(texts)).select("text", (F.col("doc_id") % 4 == 0).alias("fit"))
    got = context_mixing.context_lines(frame).collect()
    want = {True: Counter(), False: Counter()}
    spaces = {0, 9, 10, 11, 12, 13, 32}
    for d, t in enumerate(texts):
        data = bytes(context_mixing.PAD) + t.encode() + b"\xff"
        for i in range(context_mixing.PAD, len(data)):
            begin = max((k + 1 for k in range(i) if data[k] in spaces), default=0)
            for context in [(o, data[i - o:i]) for o in context_mixing.ORDERS] + [("word", data[begin:i])]:
                for half in ((*context, None, data[i] >> 4), (*context, data[i] >> 4, data[i] & 15)):
                    want[d % 4 == 0][half] += 1
    seen = {k[:3] for c in want.values() for k in c}
    assert len({r.key for r in got}) == len(got) == len(seen)

    def lines(kinds):
        counts = {k: np.zeros(16) for k in seen}
        for kind in kinds:
            for k, n in want[kind].items():
                counts[k[:3]][k[3]] += n
        return Counter(context_mixing._stretched(c).tobytes() for c in counts.values())

    assert Counter(bytes(r.line) for r in got) == lines([True, False])
    assert Counter(bytes(r.fit_line) for r in got) == lines([False])


def test_lm_counts_travel_packed(docs, monkeypatch):
    """Counts and words of a block are a row for each part, however many codes and words there are, and what a block is told of a code is what the line of its context says."""
    monkeypatch.setattr(context_mixing, "HELD_KEYS", 3_000)
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(list("abcdefgh é"), 200)) for _ in range(30)] + ["", "word word"]
    frame = docs(*enumerate(texts)).select("text", (F.col("doc_id") % 3).alias("block"), (F.col("doc_id") % 3 == context_mixing.FIT).alias("fit"))
    counts = context_mixing.code_counts(frame.coalesce(1), 3).localCheckpoint()
    assert counts.count() < 50 < 10_000 < counts.agg(F.sum("size")).first()[0]
    lines = {r.key: np.frombuffer(r.line, np.int8) for r in context_mixing.context_lines(frame.filter(F.col("block") != context_mixing.OTHER)).collect()}
    unseen, told = np.zeros(16, np.int8), 0
    for r in context_mixing.block_codes(counts, lambda n, kind: n.sum(axis=0)).collect():
        given = context_mixing._unpacked(r.lines, r["size"], "V9").view(np.int8).reshape(-1, 9)
        for code, own in zip(context_mixing._ordered(r).tolist(), given):
            key, byte = code >> 8 << 8, code & 255
            pair = [lines.get(int(np.uint64(k).astype(np.int64)), unseen) for k in (key, key + (byte >> 4) + 1)]
            want = []
            for line, half in zip(pair, (byte >> 4, byte & 15)):
                node = 1
                for bit in f"{half:04b}":
                    want.append(int(line[node]) if bit == "1" else -int(line[node]))
                    node = 2 * node + int(bit)
            assert own.tolist() == [*want, (pair[0][0] > 0) + 2 * (pair[1][0] > 0)]
            told += 1
    assert told > 10_000
    words = context_mixing.word_counts(frame.withColumn("trains", F.col("block") != context_mixing.OTHER), 3).collect()
    want = Counter(w for i, t in enumerate(texts) if i % 3 != context_mixing.OTHER for w in tokens_of(t))
    got = {(r.block, w): n for r in words for w, n in zip(context_mixing._unzipped(r.words), context_mixing._unpacked(r.counts, r["size"], "<u8").tolist())}
    assert got == {(i % 3, w): want[w] for i, t in enumerate(texts) for w in tokens_of(t)}
    assert (sum(r.total for r in words), sum(r.distinct for r in words)) == (sum(want.values()), len(want))


def test_toxic_words_do_not_depend_on_size(spark):
    """Ten times the rows credit the same words; slightly biased words and the words of a copied text are not credited; no number of words is set."""
    def credited(times, insults):
        rng = np.random.default_rng(4)
        rows = []
        for i in range(600 * times):
            y = int(i % 5 == 0)
            text = [f"plain{x}" for x in rng.integers(0, 30, 8)] + ["biased"] * int(rng.random() < (0.4 if y else 0.25))
            if y:
                text.append(insults[i // 5 % len(insults)])
                text += ["copied", "template"] if i // 5 % len(insults) == 0 and i % 2 else []
            rows.append((i, " ".join(text) + f" own{i}", y))
        frame = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
        return {r.word for r in crf_toxicity.lexicon(frame).select("word").distinct().collect()}

    assert credited(1, ["awful", "nasty", "vile"]) == credited(10, ["awful", "nasty", "vile"]) == {"awful", "nasty", "vile"}


def test_toxic_words_have_no_set_number(spark):
    frame = spark.createDataFrame([(0, "", 0)], "doc_id bigint, text string, y int").unionByName(
        spark.range(21_000 * 20).select(F.col("id").alias("doc_id"), F.concat(F.lit("insult"), (F.col("id") / 20).cast("int")).alias("text"), F.lit(1).alias("y"))).unionByName(
        spark.range(4_000_000, 4_000_000 + 8 * 21_000 * 20).select(F.col("id").alias("doc_id"), F.lit("fine").alias("text"), F.lit(0).alias("y")))
    assert crf_toxicity.lexicon(frame).select("word").distinct().count() == 21_000
