"""The stages on the given tables, each against a plain version on its own input."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="tables not present")


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = F.lit("mine")
    docs = docs.withColumns({"score": extra, "n_words": extra, "copies_of": extra})
    odd = [(10_000, None, "src0"), (10_001, "", None), (10_002, "x" * 90_000, "src1"), (None, "no id here", "src1")]
    more = docs.sparkSession.createDataFrame(odd, "doc_id long, text string, source string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    found, folder = [("documents", docs)], tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, found[-1][1], SF).write.parquet(f"{folder}/{name}")
        found.append((name, spark.read.parquet(f"{folder}/{name}")))
    return found


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def step(outputs, name):
    k = [n for n, _ in outputs].index(name)
    return outputs[k - 1][1], outputs[k][1]


def test_columns_stay(outputs):
    columns = outputs[0][1].columns
    for name, df in outputs[:-1]:
        assert df.columns == columns, name
    assert outputs[-1][1].columns == [*columns, "copies", "taken", "finish"]


def test_toxicity_keeps_clean_documents(spark, outputs):
    before, after = step(outputs, "toxicity")
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").select("doc_id")
    clean = before.join(labels, "doc_id").count()
    assert after.join(labels, "doc_id").count() >= 0.97 * clean and after.count() < before.count()


def test_lines(outputs):
    before, after = step(outputs, "line_dedup")
    rows = [x for x in texts(before) if x[0] is not None]
    expected = brute.line_dedup(rows)
    got = {i: t for i, t in texts(after) if i is not None}
    for i, text in rows:
        _, dropped, sha = expected[i]
        if i in got:
            assert brute.sha(got[i] or "") == sha and (dropped or got[i] == text)
        else:
            assert dropped


def test_one_document_of_each_group_stays(outputs):
    before, after = step(outputs, "ngram_jaccard")
    expected = brute.components([x for x in texts(before) if x[0] is not None])
    kept = {i for i, (_, c) in expected.items() if c == i}
    assert {i for i, _ in texts(after) if i is not None} == kept


def test_no_window_of_an_item_is_left_whole(spark, outputs):
    before, after = step(outputs, "decontaminate")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = brute.contamination(texts(before), items)
    got = dict(texts(after))
    for i, text in texts(before):
        n, n_hit, *_ = hit[i]
        if n_hit == 0:
            assert got[i] == text
        elif i in got:
            assert brute.contamination([(i, got[i])], [])[i][0] == n - n_hit
        else:
            assert n_hit == n


def test_the_mix_meets_the_targets(outputs):
    before, after = step(outputs, "mix_sources")
    sizes = [(r.source, len(brute.words(r.text))) for r in before.select("source", "text").collect()]
    expected = brute.targets(sizes)
    rows = after.groupBy("source").agg(F.sum("taken").alias("taken")).collect()
    total = sum(n for _, n in sizes)
    assert sum(r.taken for r in rows) <= total
    longest = max(n for _, n in sizes if n < 10_000)
    for r in rows:
        size, target = expected[r.source]
        assert r.taken <= 3 * size
        # near the target: within its longest documents
        assert abs(r.taken - target) <= max(0.1 * target, 2 * longest), r.source
    assert after.filter("copies < 1 or copies > 3").count() == 0


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns[-3:] == ["copies", "taken", "finish"]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_empty_tables_and_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name in ("copies", "taken", "finish", "text_key", "draw", "_rest2", "root", "n"):
        docs = docs.withColumn(name, F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF)
        assert set(docs.columns) <= set(found.columns) and found.collect() == [], name


def test_rows_that_share_an_id_are_told_apart_by_text(spark):
    base = " ".join(f"word{i}" for i in range(80))
    near = base.replace("word7 ", "other ")
    alone = " ".join(f"alone{i}" for i in range(80))
    rows = [(1, base, "a"), (2, near, "a"), (2, alone, "b"), (None, near, "c"), (None, "no copy at all of anything", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("mine"))
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert {(r.doc_id, r.text, r.taken) for r in kept.collect()} == {(i, t, "mine") for i, t, _ in (rows[0], rows[2], rows[4])}
    twice = spark.createDataFrame([(1, base, "a"), (1, base, "b"), (1, base, None)], docs.select("doc_id", "text", "source").schema)
    mixed = corpus_pipeline.mixing_stage(spark, twice.withColumn("copies", F.lit("mine")), SF).collect()
    assert {r.source for r in mixed} <= {"a", "b", None} and len(mixed) == len({r.source for r in mixed}) > 1
    assert all(1 <= r.copies <= 3 for r in mixed)
