import random

import pytest
from pyspark.sql import functions as F

from fieldlens.llm import merkle, prefix_trie, shared
from tests.llm import brute

TURNS = "conv_id long, turn int, role string, text string"
DOCS = "doc_id long, source string, lang string, n_chars int, text string"


def some_turns(seed, conversations=260, hot=60):
    """Shared beginnings, copies of one conversation, ties, nulls, gaps in the ids and a long conversation."""
    rng = random.Random(seed)
    texts = ["hello", "hello there", "größe", "", None, "a b c", "x" * 500, "yes", "no"]
    rows = []
    for c in range(conversations):
        c = c * 3 if c % 2 else c * 100
        for t in range(rng.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(texts[: rng.randrange(2, 9)])))
    rows += [(100_000 + 7 * k, t, "user", f"the same {t}") for k in range(hot) for t in range(9)]
    rows += [(777_777, t, "user", str(t % 7)) for t in range(700)] + [(777_778, t, "user", str(t % 7)) for t in range(650)]
    rows += [(5, None, "system", "first"), (5, 1, "user", "tie"), (5, 1, "user", "a tie"), (None, 1, "user", "lost")]
    rows += [(-250, 0, "user", "below zero"), (901, 0, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_trie_is_the_plain_one(spark, shards):
    rows = some_turns(shards)
    df = spark.createDataFrame(rows, TURNS).withColumns({"key": F.lit("mine"), "path": F.lit(1), "turns": F.lit("x")})
    found = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations_of(df)), shards)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, brute.trie(brute.rebuilt(rows))))


def test_trie_of_few(spark):
    def of(*rows):
        df = spark.createDataFrame(list(rows), TURNS)
        return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations_of(df)))

    assert of().collect() == []
    # 9 takes three turns from 0, which does not exist, and has too few of its own
    assert brute.rebuilt([(9, 0, "user", "x")])[9] == []
    assert [tuple(r)[:7] for r in of((9, 0, "user", "x")).collect()] == [(9, 0, None, 1, 0, 1, 0)]


def test_pieces_of_a_crowded_end(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    rows = some_turns(9, conversations=20, hot=50)
    found = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations_of(spark.createDataFrame(rows, TURNS))), 7)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, brute.trie(brute.rebuilt(rows))))


def some_docs(seed, sizes=((None, 1), ("", 8), ("de", 9), ("en", 700), ("Ünd", 65))):
    rng = random.Random(seed)
    rows, i = [], 0
    for lang, n in sizes:
        for _ in range(n):
            text = rng.choice(["Some TEXT", "small text", "", None, "Ünder\nGröße", "LONG " * 3000])
            rows.append((i, rng.choice(["s", None, "a:b"]), lang, rng.choice([None, 3, -1]), text))
            i += rng.randrange(1, 4)
    rows += [(None, None, None, None, None), (3, "s", "en", 1, "a"), (3, "s", "en", 1, "a"), (3, "r", "en", 1, "A")]
    rng.shuffle(rows)
    return rows


def manifest(df):
    own = {c: F.col(c) for c in merkle.FIELDS}
    low = own | {"text": F.translate("text", merkle.UPPER, merkle.LOWER)}
    claimed = F.when(shared.fold(F.col("doc_id"), 3) == 0, merkle.leaf(**low)).otherwise(merkle.leaf(**own))
    found = merkle.manifest(df.select("doc_id", "lang", merkle.leaf(**own).alias("leaf"), claimed.alias("claimed")))
    back = merkle.folded(F.col("claimed"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.proof()), back, back == F.col("root"))


@pytest.mark.parametrize("sizes", [(("en", 1),), (("en", 8), ("de", 1)), (("en", 600),), None])
def test_manifest_is_the_plain_one(spark, sizes):
    rows = some_docs(4, sizes) if sizes else some_docs(4)
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("mine") for c in ("key", "pos", "digest", "path", "n")})
    assert sorted(map(str, map(tuple, manifest(df).collect()))) == sorted(map(str, brute.manifest(rows)))


def test_many_languages(spark):
    rows = some_docs(2, [(f"l{k:03}", k % 3 + 1) for k in range(90)])
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(map(str, map(tuple, manifest(df).collect()))) == sorted(map(str, brute.manifest(rows)))


def test_manifest_of_nothing(spark):
    assert manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_levels_take_windows(spark):
    nodes = spark.range(100).selectExpr("'a' key", "id pos", "100L n", "sha2(string(id), 256) digest")
    plan = merkle.parents(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "lead(" in plan and "Python" not in plan and "Arrow" not in plan
