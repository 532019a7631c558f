import random
import re
from collections import Counter

import pytest
from gitgauge.llm import phrase_tries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, k=2000, least=10):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]", piece) if x]
            total[lang] += len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i:i + size])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(1000000 * a * a // (f[lang, p[:c]] * f[lang, p[c:]]), c) for c in range(1, len(p))]
            score, c = min(cuts)
            found[lang, p] = (score, a, f[lang, p[:c]], f[lang, p[c:]])
    gone = {(lang, q) for (lang, p), v in found.items() if len(p) == 3 for q in (p[:2], p[1:])
            if (lang, q) in found and 100 * v[1] >= 50 * found[lang, q][1]}
    out = []
    for lang in {g for g, _ in found}:
        best = sorted((-s, -a, " ".join(p).encode(), left, right) for (g, p), (s, a, left, right) in found.items() if g == lang and (g, p) not in gone)
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(best[:k], 1)]
    return sorted(out)


def made(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "B", "c", "Été", "中", "x\x1cy", "dd", " ", "e-e", "\U0001f600"]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "\t ", ", ", "\n", ".", " . ", "\r"]) for _ in range(rng.randrange(60))))
            for _ in range(n)]
    return rows + [("en", None), (None, ""), ("fr", " .,; \n"), ("en", "a B " * 3000), ("en", " c"), ("en", "a")] + rows[:3]


@pytest.fixture
def corpus(spark):
    return lambda rows: spark.createDataFrame([(g, t, 1, "k") for g, t in rows], "lang string, text string, n int, phrase string")


@pytest.mark.parametrize("seed,bound,per_trie", [(1, 10**6, 10**6), (2, 10**6, 7), (3, 20, 5), (4, 0, 5)])
def test_whole_result_equals_brute_force(corpus, seed, bound, per_trie):
    """The bound on the tries, and how they are cut up, change nothing."""
    rows = made(seed)
    got = phrase_tries.collocations(corpus(rows).repartition(3), max_trie_phrases=bound, per_trie=per_trie)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_top_k_and_ties(corpus):
    rows = [("en", f"{a} {b}") for a, b in ("ab", "cd", "ef", "gh") for _ in range(12)] + [("en", "z z z")] * 10
    got = phrase_tries.collocations(corpus(rows), k=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, k=2)
    assert [r["phrase"] for r in got.orderBy("rank").collect()] == ["a b", "c d"]


def test_empty_table(corpus):
    assert phrase_tries.collocations(corpus([])).collect() == []


def test_counts_beyond_64_bits(spark):
    """a * a * 1000000 needs more than 64 bits; decimals hold it."""
    million = phrase_tries._exact
    row = spark.createDataFrame([(3_000_000_000_000, 4_000_000_000_000, 5_000_000_000_000)], "a bigint, l bigint, r bigint").select(
        (million("a") * million("a") * 1_000_000).alias("x"), (million("l") * million("r")).alias("y")).selectExpr("x div y AS s").first()
    assert row["s"] == 450000


def test_trie_finds_exactly_its_phrases():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    phrases = sorted({(rng.choice("xy"), rng.choice(words[:20]), rng.choice(words), rng.choice([None, *words[:9]])) for _ in range(5000)}, key=str)
    trie, states = phrase_tries.Trie.build(*map(list, zip(*phrases)))
    assert len(set(states.tolist())) == len(phrases)
    trie = phrase_tries.Trie.loads(trie.dumps())

    def reach(lang, *path):
        import numpy as np
        import pyarrow as pa
        state = trie.starts(pa.array([lang]))
        for w in path:
            if w not in trie.words or state[0] < 0:
                return None
            ok, to = trie.step(state, np.array([trie.words.index(w)]))
            if not ok[0]:
                return None
            state = to
        return int(state[0]) if trie.accept[state[0]] else None

    for p, s in zip(phrases, states.tolist()):
        assert reach(*[x for x in p if x is not None]) == s
    known = set(phrases)
    for _ in range(2000):
        p = (rng.choice("xyz"), rng.choice(words[:25]), rng.choice(words), rng.choice(words[:9]))
        assert (reach(*p) is not None) == (p in known)
