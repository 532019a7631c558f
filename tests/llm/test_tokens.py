"""Token ids against the library, files against ids, odd texts, nulls, repeats and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gitgauge.llm import bpe_chunks, rans, words
from gitgauge.llm.queries import tokenizer_path

ODD = [
    None, "", "   ", "ä ̈b é", "İstanbul ΑΣ ß", "<|endoftext|>x <|start of|>", "it's we'll 'S don't''s", "½ 12 a1b2",
    "　x y", "\x1ca\x1db", "日本語", "a\x00b", "\U0001f600\U0001f600 e", "tab\there\r\nnew", "long" * 3000, "w " * 5000 + "end",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def library(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)


def test_pieces_agree_with_the_library(tokenizer):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aA' sé́\n\t.1½İΣ <|endoftext|>") for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    found = words.Encoder(tokenizer_path()).encode(texts)
    assert found == [library(tokenizer, t)[0] for t in texts]


def test_pre_tokens_are_encoded_once(tokenizer):
    """Words that differ in case or punctuation only ask the library for the same pre-token; a full memo changes no ids."""
    encoder = words.Encoder(tokenizer_path())
    texts = ["and And, and. (AND) and2and", "and's éand <|endoftext|>and and\x0band"]
    found = encoder.encode(texts)
    assert found == [library(tokenizer, t)[0] for t in texts]
    assert "and" in encoder.memo and not {"And,", "and.", "(AND)", "and2and"} & set(encoder.memo)


def test_encode_and_decode(docs, tokenizer):
    given = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "same id"), (3, "same id")]
    got = bpe_chunks.encode_and_decode(docs(*given), tokenizer_path(), mean=8).collect()
    want = sorted(((i, *library(tokenizer, t)) for i, t in given), key=repr)
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in got), key=repr) == want
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_chunks.encode_digests(docs(*given), tokenizer_path()).collect()}
    assert digests == {(i, len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for i, x, d in want}


def test_chunks_resist_shifts():
    rnd = random.Random(1)
    passage = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(2000))
    one, two = set(bpe_chunks.chunks("short start " + passage)), set(bpe_chunks.chunks("quite another, longer start " + passage + " tail"))
    assert len(one & two) >= 0.8 * len(one)
    assert "".join(bpe_chunks.chunks(passage)) == passage


def test_shared_chunks_are_found(docs):
    rnd = random.Random(2)
    passage = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(500))
    shared = bpe_chunks.shared_chunks(docs(*[(i, f"{i} {passage} {i}") for i in range(5)]), tokenizer_path(), 128)
    assert len(shared) > 5 and all(t.strip() in passage for t, _ in shared)


def test_empty_tables(docs):
    assert bpe_chunks.encode_digests(docs(), tokenizer_path()).count() == 0
    assert rans.token_files(docs(), tokenizer_path()).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 300_000])
def test_rans_round_trip(n):
    table = rans.Table(*rans.scaled({1: 5, 7: 1000, 9: 1}))
    ids = np.random.default_rng(0).choice([1, 7, 9], n, p=[0.1, 0.89, 0.01]).astype(np.uint32)
    coded = table.encode(ids)
    assert (table.decode(*coded, n) == ids).all()
    if n > rans.CHECKPOINT:  # one checkpoint alone
        assert (table.decode(*coded, n, only=1) == ids[rans.CHECKPOINT:2 * rans.CHECKPOINT]).all()


def test_frequencies_fill_the_scale():
    for counts in ({5: 1}, {i: 1 for i in range(5000)}, {0: 10**12} | {i: 1 for i in range(1, 40_000)}):
        _, freq, starts = rans.scaled(counts)
        assert freq.sum() == 1 << rans.SCALE_BITS and freq.min() >= 1 and starts[-1] + freq[-1] == 1 << rans.SCALE_BITS


def test_files(docs, tokenizer, tmp_path):
    given = [(i * 7 - 20, t) for i, t in enumerate(ODD)]
    rans.write_files(docs(*given), str(tmp_path / "f"), tokenizer_path(), part_bytes=4000, block_tokens=50)
    spark = docs().sparkSession
    start, want = 0, []
    for i, t in sorted(given):
        ids = library(tokenizer, t)[0] + (1).to_bytes(4, "little")
        want.append((i, start, len(ids) // 4, zlib.crc32(ids), ids))
        start += len(ids) // 4
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in rans.read_files(spark, str(tmp_path / "f")).collect()) == want


def test_repeated_and_null_ids_have_places(docs):
    got = rans.token_files(docs((None, "a"), (2, "b c"), (2, "b c"), (1, None)), tokenizer_path()).collect()
    assert sorted((r.start, r.n_tokens) for r in got) == [(0, 2), (2, 1), (3, 3), (6, 3)]


def test_damage_is_noticed(docs, tmp_path, spark):
    folder = str(tmp_path / "f")
    rans.write_files(docs((1, "some text")), folder, tokenizer_path())
    blocks = spark.read.parquet(f"{folder}/blocks")
    from pyspark.sql import functions as F
    blocks.withColumn("states", F.expr("concat(substring(states, 1, length(states) - 1), X'FF')")).write.parquet(f"{folder}/bad/blocks")
    spark.read.parquet(f"{folder}/table").write.parquet(f"{folder}/bad/table")
    with pytest.raises(Exception, match="damaged"):
        rans.read_files(spark, f"{folder}/bad").collect()
