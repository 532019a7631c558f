import hashlib
import random
import re
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from gitgauge.llm import chat_tree
from gitgauge.llm import turns as turn_paths
from gitgauge.llm import zfast_trie
from gitgauge.llm.queries import table

SCHEMA = "conv_id bigint, turn bigint, role string, text string, d int, words string, conv string"


@pytest.fixture
def talks(spark):
    """A table of (conv_id, turn, role, text) with columns whose names clash with those that operators make."""
    return lambda rows, n=3: spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(n)


def in_order(rows):
    convs = defaultdict(list)  # ties: the tests keep to texts that differ in their first 100 characters
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [r[2:] for r in sorted(v)] for c, v in convs.items()}


def brute_trie(rows, every=20):
    convs = in_order(rows)
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        opener = c - (abs(c) % every) * (1 if c >= 0 else -1)
        made[c] = convs.get(opener, [])[:h] + own[h:] if opener != c else own
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, cs in members.items():
        words = len([w for w in re.split("[\x20\x09-\x0d]", p[-1][1]) if w]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * words
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in cs if len(made[c]) == len(p)))).encode()).hexdigest())
                  for p, cs in members.items())


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(df):
    assert df.columns == NODE
    return sorted(tuple(r) for r in df.collect())


def babble(seed, n=60):
    """Conversations over few texts, so that paths meet and part at all depths; copies, gaps, ties, nulls, negative ids."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-45, 90), n):
        length = rng.choice([1, 1, 2, 3, 5, 8, 21])
        for t in range(length):
            rows.append((c, rng.choice([t, t, None]) if rng.random() < .1 else t, rng.choice(["user", "user", None]), rng.choice(["a b", "c", "a  b\x1c d\x0b"][:rng.choice([1, 1, 1, 3])])))
    rows += [(200, 0, "user", None), (201, None, None, None), (None, 1, "user", "lost"), (220, 5, "user", "a b"), (220, 5, "user", "a b"), (220, 5, "user", "a")]
    return rows


@pytest.mark.parametrize("seed,shares", [(1, (0.125,)), (2, (0.3, 0.6)), (3, ())])
def test_trie_equals_brute_force(talks, seed, shares):
    """Whatever the batches, all nodes of all rebuilt conversations come out."""
    rows = babble(seed)
    assert nodes(zfast_trie.prefix_trie(talks(rows), shares=shares)) == brute_trie(rows)


def test_trie_of_the_given_tables(spark, sf_dir):
    rows = [tuple(r.values()) for r in pq.read_table(f"{sf_dir}/conversations.parquet").to_pylist()]
    assert nodes(zfast_trie.prefix_trie(table(spark, sf_dir, "conversations"))) == brute_trie(rows)


def test_trie_of_nothing_one_turn_and_one_long_conversation(talks):
    assert nodes(zfast_trie.prefix_trie(talks([]))) == []
    long = [(0, t, "user", f"w{t // 50}") for t in range(600)] + [(c, 0, "user", "w0") for c in (19, 20, 21)]
    assert nodes(zfast_trie.prefix_trie(talks(long, 5))) == brute_trie(long)


def test_hot_members_are_hashed_in_pieces(talks, monkeypatch):
    rows = [(c * 20, 0, "user", "same") for c in range(700)] + [(c * 20, 1, "user", "x") for c in range(5)]
    assert nodes(zfast_trie.prefix_trie(talks(rows))) == brute_trie(rows)


def test_places_and_path_hashes_do_not_depend_on_partitions(spark, talks):
    """One conversation over all tasks, and many in one."""
    rows = [(1, t, "user", f"t{t % 7}") for t in range(900)] + [(c, t, "u", f"t{t}") for c in range(2, 40) for t in range(3)]
    found = []
    for partitions in (1, 4, 60):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = turn_paths.ordered_turns(turn_paths.plain_turns(talks(rows))).select("conv", "turn", "pos", "h1", "h2", "p1", "p2").collect()
        found.append(sorted(map(tuple, got)))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1] == found[2]
    at = {(r[0], r[2]): r for r in found[0]}
    assert all(r[1] == r[2] - 1 for r in found[0])
    assert all(r[5:] == (at[r[0], r[2] - 1][3:5] if r[2] > 1 else (0, 0)) for r in found[0])
    assert len({r[3:5] for r in found[0]}) == 900 + 3  # the short ones share their paths


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_chat(rows):
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256); a conversation without an id is one, too."""
    some = in_order([(c, *r) for c, *r in rows if c is not None])
    none = in_order([(0, *r) for c, *r in rows if c is None])
    out = []
    for c, seq in [*some.items(), *[(None, s) for s in none.values()]]:
        learned = "".join(t for r, t in seq if r == "assistant")
        out.append((c, len(seq), sha("".join(f"{r}\n{t}\n" for r, t in seq)), len(learned), sha(learned)))
    return sorted(out, key=str)


MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "<\\s>", "[\\\\/INST]", "\\", "<", "[", "é\U0001f600", " ", "\n", "x"]


def chats(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "system", None, "to[/ROLE]ol", ""]),
                         "".join(rng.choice(MARKS) for _ in range(rng.choice([0, 1, 1, 6]))) if t > 1 else rng.choice(["hi", "</s>", None])))
    return rows + [(None, 1, "assistant", "b"), (None, None, "user", "a"), (7, 2, "user", "tie"), (7, 2, "user", "tie"), (99, 0, "assistant", "y" * 300_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_chat_comes_back_as_it_was(talks, seed):
    rows = chats(seed)
    got = chat_tree.chat_digests(talks(rows)).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute_chat(rows)


def test_marks_survive_and_are_broken_in_texts(talks, spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(MARKS) for _ in range(rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for text, out in df.select("t", chat_tree.escaped(df["t"])).collect():
        assert chat_tree.unescaped(out) == text
        assert not any(m in out for m in MARKS[:8])


def test_tree_emits_shared_turns_once_and_depth_first(talks):
    rows = [r for r in chats(4) if r[0] is not None] + [(c, t, "user", f"deep {t if t < 150 else c * 1000 + t}") for c in (500, 501) for t in range(200)]
    stream, links = chat_tree.prefix_tree(talks(rows))
    nodes = {r["start"]: r for r in stream.collect()}
    assert len({tuple(s[:d]) for s in in_order(rows).values() for d in range(1, len(s) + 1)}) == len(nodes)
    order = sorted(nodes)
    assert order[0] == 0 and all(nodes[a]["size"] + a == b for a, b in zip(order, order[1:]))
    path = defaultdict(dict)
    for r in links.collect():
        path[r["conv"]][r["pos"]] = r["start"]
    for conv, seq in in_order(rows).items():
        starts = [path[conv][i + 1] for i in range(len(seq))]
        assert [chat_tree.parsed(nodes[s]["piece"]) for s in starts] == seq
        for i, s in enumerate(starts):
            node = nodes[s]
            assert node["depth"] == i + 1 and node["position"] == sum(nodes[a]["size"] for a in starts[:i])
            opened = i // chat_tree.BLOCK * chat_tree.BLOCK
            assert node["context"] == (starts[opened - 1] if opened else None)
            assert {x for f, t in node["attends"] for x in (f, t)} <= set(order) | {a + nodes[a]["size"] for a in order}
            assert sorted(x for f, t in node["attends"] for x in order if f <= x < t) == sorted(starts[opened:i])
            assert all(a[1] < b[0] for a, b in zip(node["attends"], node["attends"][1:]))
            assert (node["loss_from"] is not None) == (seq[i][0] == "assistant")
    first_block = [nodes[s]["depth"] for s in order if nodes[s]["depth"] <= chat_tree.BLOCK]
    assert all(b <= a + 1 for a, b in zip(first_block, first_block[1:]))  # depth first: one step down at a time


def test_chat_of_nothing(talks):
    assert chat_tree.chat_digests(talks([])).collect() == []
