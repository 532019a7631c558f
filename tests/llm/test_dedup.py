"""SimHash groups, line chunks and contained benchmark items against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from gitgauge.llm import line_chunks, minhash_windows, simhash_bk
from gitgauge.llm.common import ASCII_LOWER, tokens_of
from gitgauge.llm.components import components


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))


@pytest.mark.parametrize("text", [None, "", " ", "a", "A b", "Éa b\x1cc d \x85 e", "a b c a b c a b c x x x"])
def test_tokens_and_fingerprint(text):
    assert tokens_of(text or "") == words(text)
    w = words(text)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    assert simhash_bk.simhash(text or "") == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, linked):
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {v: top(v) for v in values}


def test_bk_tree_finds_all_within_the_radius():
    rnd = random.Random(5)
    values = [rnd.getrandbits(12) for _ in range(300)]
    tree = simhash_bk.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        for radius in (0, 1, 2):
            assert sorted(tree.near(v, radius)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= radius]


@pytest.mark.parametrize("split", [3, 20_000])
def test_links_join_all_near_fingerprints(spark, split):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(20)] + list(range(40))
    values = sorted({b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base for _ in range(10)})
    frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp bigint")
    mask = (1 << 64) - 1
    links = [(r.a & mask, r.b & mask) for r in simhash_bk.fingerprint_links(frame, split=split).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    assert groups(values, links) == groups(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == groups({x for e in edges for x in e}, edges)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_odd_rows(docs):
    given = [(5, None), (3, ""), (9, " \t"), (4, "one two three four"), (2, "ONE two three four"), (2, "ONE two three four"), (None, "one two three four"), (8, "other")]
    got = simhash_bk.near_duplicates(docs(*given)).collect()
    assert len(got) == len(given)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(2, 2), (2, 2), (3, 3), (4, 2), (5, 3), (8, 8), (9, 3)]
    assert [r.component_id for r in got if r.doc_id is None] == [2]
    assert {r.fingerprint for r in got if r.doc_id in (3, 5, 9)} == {"0" * 16}
    assert simhash_bk.near_duplicates(docs()).count() == 0


LONG = " ".join(f"w{i}" for i in range(30))


def test_line_dedup(docs):
    passage = "first line of the passage here\nsecond line of the passage here\nthird one of it\n"
    given = [(3, f"own start\n{LONG}\nown end"), (1, f"{LONG}\nother"), (2, "short\nAll rights reserved."), (4, "All rights reserved."), (6, None), (None, LONG),
             (7, "x\n" * 5000 + LONG), (8, passage * 2)]
    got = {r.doc_id: r for r in line_chunks.line_dedup(docs(*given)).collect()}
    assert got[None].text == LONG  # a null doc_id comes first
    assert got[3].text == "own start\nown end" and got[1].text == "other" and got[7].text == "x\n" * 4999 + "x"
    assert got[2].text == "short\nAll rights reserved." and got[4].text == "All rights reserved." and got[6].text is None
    assert got[3].hash == "x" and got[3].n_removed == 1
    assert line_chunks.line_dedup(docs()).count() == 0
    same = line_chunks.line_dedup(docs((1, LONG), (1, LONG))).collect()
    assert [r.text for r in same] == [LONG, LONG]


def test_line_dedup_brute_force(spark, docs):
    rnd = random.Random(4)
    lines = [" ".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.choice([2, 8, 30]))) for _ in range(60)]
    given = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 25)))) for i in range(80)]
    where, gone = defaultdict(list), defaultdict(set)
    for i, text in given:
        cut, found = line_chunks.line_chunks(text)
        for a, z, eligible in found:
            if eligible:
                where["\n".join(cut[a:z])].append((i, a))
    for places in where.values():
        for i, a in sorted(places)[1:]:
            gone[i].add(a)
    assert {r.doc_id: r.text for r in line_chunks.line_dedup(docs(*given)).collect()} == {i: line_chunks.without(t, gone[i]) for i, t in given}


def test_line_chunks_resist_shifts():
    rnd = random.Random(9)
    body = [" ".join(rnd.choice("abcdef") for _ in range(6)) for _ in range(200)]

    def pieces(lines):
        cut, found = line_chunks.line_chunks("\n".join(lines))
        return {"\n".join(cut[a:z]) for a, z, _ in found}

    assert len(pieces(body) & pieces(["new"] + body[:100] + ["inserted"] + body[100:])) >= 0.9 * len(pieces(body))


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("bound", [16_000_000, 3_000])
def test_contained_items(spark, docs, bound):
    rnd = random.Random(6)
    say = lambda n: " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(rnd.randrange(99)) for _ in range(n))
    items = [(i, say(rnd.choice([1, 4, 5, 9, 40, 200]))) for i in range(40)] + [(98, None), (99, ""), (3, "repeated row of six words"), (3, "repeated row of six words")]
    given = []
    for d in range(60):
        own = [say(rnd.randrange(300))]
        for _ in range(2):
            w = (rnd.choice(items)[1] or "").split(" ")
            if rnd.random() < 0.5 and len(w) > 20:
                w[rnd.randrange(len(w))] = "changed"
            own += [" ".join(w).upper(), say(rnd.randrange(50))]
        given.append((d, " ".join(own)))
    given += [(100, None), (101, ""), (102, items[0][1]), (None, items[4][1] + " tail")]
    bench = spark.createDataFrame([(i, t, 0.5) for i, t in items], "item_id bigint, text string, containment double")
    got = sorted(((r.doc_id, r.item_id, r.n_contained, r.n_shingles) for r in minhash_windows.contained_items(docs(*given), bench, max_sent_bytes=bound).collect()), key=repr)
    want = [(d, i, len(s & x), len(s)) for d, t in given for i, it in items if (s := shingles(it)) and len(s & (x := shingles(t))) >= 0.8 * len(s)]
    assert got == sorted(want, key=repr)
    kept = {r.doc_id for r in minhash_windows.decontaminate(docs(*given), bench).collect()}
    assert kept == {d for d, _ in given} - {w[0] for w in want} | {None}
    assert minhash_windows.contained_items(docs(), bench).count() == 0
    assert minhash_windows.contained_items(docs(*given), bench.limit(0)).count() == 0


def test_line_dedup_finds_planted_passages(docs):
    """Every line of a passage of 50 words or more goes from all documents but the first, whatever its neighbours, and nothing else does."""
    rnd = random.Random(12)
    count = iter(range(10 ** 6))
    line = lambda n: " ".join(f"w{next(count)}" for _ in range(n))
    given, want = [], {}
    for lines, n in [(2, 25), (3, 20), (4, 15), (5, 12), (6, 10), (8, 8), (20, 12), (20, 3), (13, 4)] * 4:
        passage = [line(n) for _ in range(lines)]
        if rnd.random() < 0.5:
            passage[1:1] = [""]
        for copy in range(3):
            before, after = ([line(rnd.choice([1, 7, 20])) for _ in range(rnd.randint(0, 4))] for _ in range(2))
            given.append((len(given), "\n".join(before + passage + after)))
            want[given[-1][0]] = given[-1][1] if copy == 0 else "\n".join(before + after)
    assert {r.doc_id: r.text for r in line_chunks.line_dedup(docs(*given)).collect()} == want


def test_passages_against_brute_force():
    rnd = random.Random(3)
    for _ in range(200):
        lines = [" ".join("ab"[rnd.randrange(2)] for _ in range(rnd.choice([0, 1, 3, 9]))) for _ in range(rnd.randint(0, 30))]
        n = [len(x.split()) for x in lines]
        want = set()
        for a in range(len(lines)):
            for z in range(a + 2, len(lines) + 1):
                total = sum(n[a:z])
                if n[a] and n[z - 1] and total >= 12 and min(total - n[a], total - n[z - 1]) < 12 and len(set(lines[a:z]) - {""}) > 1:
                    want.add((a, z))
        got = line_chunks.passages(lines, 12)
        assert got == {(a, z) for a, z in want if sum(n[a:z]) - n[z - 1] < 12 or sum(n[a:z]) - n[a] < 12}


def test_what_repeats_is_never_broadcast(docs):
    """It grows with the corpus, so the plan of small tables is that of large ones."""
    text = "\n".join(f"line {i} " + "word " * 30 for i in range(4))
    out = line_chunks.line_dedup(docs(*[(i, text) for i in range(5)]))
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
