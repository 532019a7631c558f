"""Registered queries against their SQL; the pipeline on planted cases."""

import hashlib

import pytest
from compare import differences, duck

import corpus_pipeline
from gitgauge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sf_dir, name):
    assert not differences(queries.queries()[name](spark, sf_dir), duck(sf_dir), queries.oracle_sql()[name])


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_stages(spark, tmp_path):
    long = " ".join(f"passage{i}" for i in range(60))
    item = " ".join(f"item{i}" for i in range(20))
    texts = {i: f"clean text number {i} " + " ".join(f"w{i}x{j}" for j in range(40)) for i in range(200)}
    toxic = {i for i in range(200) if i % 5 == 1}
    for i in toxic:
        texts[i] += " vile" if i % 2 else " nasty"
    texts |= {1000: texts[2], 1001: f"own words of one\n{long}", 1002: f"own words of two\n{long}", 1003: f"before {item} after", 1004: texts[1]}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    left, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        left[name] = {r.doc_id: r for r in at.collect()}
        if name != "bpe_tokens":
            assert at.columns == columns
    assert set(left["toxicity"]) == set(texts) - toxic - {1004}
    assert left["line_dedup"][1001].text == texts[1001] and left["line_dedup"][1002].text == "own words of two" and left["line_dedup"][1000].text == ""
    assert set(left["near_duplicates"]) == set(left["line_dedup"])  # one text is empty by now, the others differ
    assert set(left["decontamination"]) == set(left["near_duplicates"]) - {1003}
    assert set(left["bpe_tokens"]) == set(left["decontamination"])
    assert left["bpe_tokens"][1000].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(left["bpe_tokens"])
