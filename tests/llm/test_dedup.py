"""Line dedup, n-gram join, substring dedup and decontamination against plain versions."""

import contextlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.llm import decontaminate, graph, line_dedup, ngram_join, substring_dedup
from fieldlens.llm.graph import components
from fieldlens.llm.shared import shared_folder
from tests.llm import brute


def pairs(corpus):
    return [(i, text) for i, text, _ in corpus]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def hashed(df):
    return df.withColumn("sha", F.sha2(F.encode("kept_text", "UTF-8"), 256))


# --- lines -----------------------------------------------------------------------------


def test_lines_stay_in_the_smallest_document_only(docs, corpus, clash):
    found = hashed(line_dedup.dedup_lines(docs))
    assert by_id(found, "n_lines", "n_dropped", "sha") == brute.line_dedup(pairs(corpus))
    other = hashed(line_dedup.dedup_lines(clash(docs)))
    assert by_id(other, "n_lines", "n_dropped", "sha") == brute.line_dedup(pairs(corpus))
    assert {"label", "key"} <= set(other.columns)


def test_lines_of_odd_tables(spark, docs):
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []
    line = "a line of some length"
    rows = [(1, line), (1, line), (2, line), (None, line), (None, "x\n" + line), (3, None)]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_dropped, r.kept_text) for r in found.collect())
    # rows of one id are one document; rows without an id keep their lines
    assert got == [
        (False, 1, 0, line), (False, 1, 0, line), (False, 2, 1, ""), (False, 3, 0, ""),
        (True, 0, 0, line), (True, 0, 0, "x\n" + line),
    ]


def marks(index):
    return sum(int(np.count_nonzero(np.frombuffer(r.data, np.uint16))) for r in index.table("filters").collect())


def state(index):
    return sorted((bytes(r.key), r.n_docs, r.first_doc) for r in index.table("refs").collect())


def test_deleting_documents_undoes_their_insertion(spark, docs):
    lines = line_dedup.line_keys(docs).cache()
    index = line_dedup.build_index(lines, shared_folder(spark), batches=3)
    whole = state(index)
    assert marks(index) == len(whole)
    gone = docs.filter("doc_id % 2 = 0").select("doc_id")
    index.delete(gone.union(gone).union(spark.createDataFrame([(10_001,)], "doc_id long")))
    rest = line_dedup.build_index(lines.join(gone, "doc_id", "left_anti"), shared_folder(spark), batches=1)
    assert state(index) == state(rest) and marks(index) == len(state(rest))
    index.insert(lines.join(gone, "doc_id", "left_semi"))
    assert state(index) == whole and marks(index) == len(whole)


def test_the_filter_forgets_nothing_and_deletes_what_it_holds():
    rng = random.Random(2)
    keys = [rng.randbytes(16) for _ in range(5000)]
    held = line_dedup.CuckooFilter.for_keys(len(keys))
    assert held.insert(keys[:3000]) and held.insert(keys[3000:])
    assert held.contains(keys).all()
    others = [rng.randbytes(16) for _ in range(20_000)]
    assert held.contains(others).mean() < 0.002
    held.delete(keys[:2500])
    assert held.contains(keys[2500:]).all() and held.contains(keys[:2500]).mean() < 0.01
    held.delete(keys[2500:])
    assert not held.table.any()
    with pytest.raises(ValueError):
        held.delete(keys[:1])
    # the same key may be inserted as often as its buckets have slots; beyond, nothing changes
    small = line_dedup.CuckooFilter.for_keys(10)
    assert small.insert([keys[0]] * 3)
    before = small.table.copy()
    assert not small.insert([keys[0]] * 9, rounds=20) and (small.table == before).all()


# --- shingles --------------------------------------------------------------------------


def test_components_are_those_of_all_pairs(docs, corpus, clash):
    expected = brute.components(pairs(corpus))
    assert len({c for _, c in expected.values()}) < len(expected) - 8
    assert by_id(ngram_join.similar_components(clash(docs)), "n_shingles", "component_id") == expected


def test_pairs_of_different_components_are_found_beyond_the_first_candidates(spark):
    # a chain: each text is near the next one only, and the first candidate of many is not a neighbour
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 60])) for k in range(70)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(ngram_join.similar_components(df), "n_shingles", "component_id") == brute.components(rows)


def test_shingles_of_odd_tables(spark, docs):
    assert ngram_join.similar_components(docs.limit(0)).collect() == []
    a, b = "one two three four five six", "none of these words is there at all"
    rows = [(4, a), (4, a), (2, a.upper()), (None, a), (None, b), (7, ""), (8, ""), (9, None)]
    found = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in found.collect())
    assert got == [(0, 2, 2), (0, 4, 0), (2, 2, 2), (4, 2, 2), (4, 2, 2), (7, 0, 7), (8, 0, 8), (9, 0, 9)]


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (200, 201), (201, 202), (202, 200)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    expected = {k: 0 for k in range(61)} | {100: 100, 101: 100, 200: 200, 201: 200, 202: 200}
    assert {r.node: r.root for r in found.collect()} == expected


@pytest.mark.parametrize("rows", [0, 500_000])
def test_components_do_not_depend_on_tasks_or_broadcasts(spark, monkeypatch, rows):
    monkeypatch.setattr(graph, "EDGES", 7)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", rows)
    rng = random.Random(4)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(300, k) for k in range(301, 330)]
    expected = brute_roots(edges)
    assert len(set(expected.values())) > 10
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == expected
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).collect() == []


def brute_roots(edges):
    root = {x: x for a, b in edges if a != b for x in (a, b)}
    while True:
        better = [(x, min(root[a], root[b])) for a, b in edges if a != b for x in (a, b) if root[x] > min(root[a], root[b])]
        if not better:
            return root
        for x, least in better:
            root[x] = min(root[x], least)


def test_rounds_on_few_edges_take_few_tasks(spark):
    # tasks per shuffle partition in every round, each with files, filled the disk where partitions were many
    settings = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    context = spark.sparkContext
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        context.setJobGroup("few edges", "")
        found = {r.node: r.root for r in components(edges).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == dict.fromkeys(range(201), 0)
    told = context.statusTracker()
    stages = {s for job in told.getJobIdsForGroup("few edges") for s in told.getJobInfo(job).stageIds}
    # the given edges are put together once in all partitions
    assert sum(told.getStageInfo(s).numCompletedTasks for s in stages if told.getStageInfo(s)) < 6 * 61


# --- passages --------------------------------------------------------------------------


def test_repeated_windows_go(docs, corpus, clash):
    found = hashed(substring_dedup.without_repeats(docs))
    expected = brute.substring_dedup(pairs(corpus))
    assert sum(n for _, n, _ in expected.values()) > 1000
    assert by_id(found, "n_words", "n_removed", "sha") == expected
    other = hashed(substring_dedup.without_repeats(clash(docs)))
    assert by_id(other, "n_words", "n_removed", "sha") == expected and "label" in other.columns


def test_shorter_windows_and_many_shards(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for k in range(40)]
    monkeypatch.setattr(substring_dedup, "SHARD_PHRASES", 3)
    monkeypatch.setattr(substring_dedup, "SPLIT_TEXTS", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = hashed(substring_dedup.without_repeats(df, window=9, seed=4))
    assert by_id(found, "n_words", "n_removed", "sha") == brute.substring_dedup(rows, 9)


def test_a_window_repeated_within_a_text_is_one_row(spark):
    rows = [(k, " ".join(["is", "on"] * 100 + [f"w{k}"] + ["is", "on"] * 60)) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = hashed(substring_dedup.without_repeats(df))
    assert by_id(found, "n_words", "n_removed", "sha") == brute.substring_dedup(rows)
    named = df.withColumn("text_id", F.xxhash64("text"))
    routed = substring_dedup.routes(substring_dedup.seed_rows(named, 50, 16))
    windows = substring_dedup.locate(substring_dedup.shard_rows(named, routed, 50, 16), 50, 16)
    assert windows.groupBy("doc_id", "h", "x").count().filter("count > 1").count() == 0


def test_passages_of_odd_tables(spark, docs):
    assert substring_dedup.without_repeats(docs.limit(0)).collect() == []
    text = " ".join(f"w{k}" for k in range(55))
    rows = [(3, text), (3, text), (5, "x " + text), (None, text), (2, None)]
    found = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in found.collect())
    assert got == [(0, 55, 0, text), (2, 0, 0, ""), (3, 55, 0, text), (3, 55, 0, text), (5, 56, 55, "x")]


# --- test items ------------------------------------------------------------------------


@pytest.fixture
def items(corpus):
    text = dict(pairs(corpus))
    long = text[sorted(text)[2]]
    return [
        (1, " ".join(long.split()[5:40])), (2, "ONE two three"), (10, "words"), (11, None), (12, "  "), (None, "one"),
        (13, "nothing like this is in any of the texts at all, so it stays out"), (1, "the same the same"),
    ]


def test_windows_of_items_are_found(spark, docs, corpus, items, clash):
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute.contamination(pairs(corpus), [("" if i is None else i, t) for i, t in items])
    assert sum(c for *_, c in expected.values()) >= 4
    # one block, and one block per item or so
    for size in (decontaminate.BLOCK_BYTES, 40):
        found = decontaminate.find_contamination(clash(docs), bench, size).select(
            "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("sha"), (F.size("spans") > 0).alias("bad"),
        )
        assert by_id(found, "n_words", "n_hit", "n_items", "sha", "bad") == expected


def test_spans_are_cut_out(spark):
    df = spark.createDataFrame(
        [(1, "Keep this. ONE, two!\nthree and rest"), (2, "one two three"), (3, "none"), (4, None)],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([("q", "one two three")], "item_id string, text string")
    found = decontaminate.find_contamination(df, bench)
    found = found.withColumn("clean", decontaminate.without_spans("text", "spans"))
    assert by_id(found, "clean") == {1: ("Keep this.  and rest",), 2: ("",), 3: ("none",), 4: (None,)}


def test_items_of_odd_tables(spark, docs):
    bench = spark.createDataFrame([(1, "some item of words")], "item_id long, text string")
    assert decontaminate.find_contamination(docs.limit(0), bench).collect() == []
    found = decontaminate.find_contamination(docs, bench.limit(0))
    assert found.filter("size(spans) > 0 or size(items) > 0").count() == 0


def test_suffixes_and_occurrences_agree_with_plain_search():
    rng = random.Random(3)
    for _ in range(60):
        a = np.array([rng.randint(1, 3) for _ in range(rng.randint(1, 60))] + [0], dtype=np.int64)
        order = decontaminate.suffix_array(a).tolist()
        assert order == sorted(range(len(a)), key=lambda i: a[i:].tolist())
    for _ in range(40):
        h = np.array([rng.randint(1, 4) for _ in range(80)], dtype=np.uint64)
        first = np.array([0, 20, 20, 55, 80])
        index = decontaminate.FmIndex(h, first)
        wanted = np.array([[rng.randint(1, 5) for _ in range(3)] for _ in range(20)], dtype=np.uint64)
        which, at = index.occurrences(wanted)
        plain = {
            (p, i) for p in range(20) for t in range(4) for i in range(first[t], first[t + 1] - 2)
            if (h[i : i + 3] == wanted[p]).all()
        }
        assert set(zip(which.tolist(), at.tolist())) == plain and len(which) == len(plain)


# --- words that are hard to tell apart --------------------------------------------------


def test_long_and_patterned_words_are_no_copies(spark):
    from tests.llm.test_words import patterned

    rows = [(i, w) for i, w in enumerate(x for pair in patterned() for x in pair) if "\0" not in w]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = by_id(ngram_join.similar_components(df), "n_shingles", "component_id")
    assert found == brute.components(rows)
    bench = [(str(i), w) for i, w in rows if i % 2]
    docs = [(i, w) for i, w in rows if not i % 2]
    found = decontaminate.find_contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id string, text string")
    )
    expected = {i: (r[4],) for i, r in brute.contamination(docs, bench).items()}
    assert by_id(found.withColumn("bad", F.size("spans") > 0), "bad") == expected


def near_copies(seed, n, edits, size=120):
    """Copies of one text with some words changed: not all are near to each other."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(size)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(size)] = f"x{k}-{rng.randrange(99)}"
        out.append(" ".join(words))
    return out


def test_rows_without_an_id_link_others(spark):
    base = [f"w{i}" for i in range(100)]
    far, middle = list(base), list(base)
    far[10] = far[50] = far[90] = "other"
    middle[10] = "other"
    texts = [" ".join(w) for w in (base, middle, far)]
    alone = brute.components([(1, texts[0]), (2, texts[2])])
    assert alone[1][1] != alone[2][1] and brute.components(list(enumerate(texts)))[2][1] == 0
    rows = [(1, texts[0]), (2, texts[2]), (None, texts[1]), (None, texts[1]), (None, "lost words of their own kind here")]
    found = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found.collect()) == [
        ("1", "1"), ("2", "1"), ("None", "1"), ("None", "1"), ("None", "None")
    ]


@pytest.mark.parametrize("worthwhile", [0.0, 0.1, 2.0])
def test_rounds_of_stars_change_no_component(spark, monkeypatch, worthwhile):
    monkeypatch.setattr(ngram_join, "WORTHWHILE", worthwhile)
    rows = list(enumerate(near_copies(5, 60, 9) + near_copies(6, 25, 14)))
    found = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = brute.components(rows)
    assert len({c for _, c in expected.values()}) > 5
    assert by_id(found, "n_shingles", "component_id") == expected


def test_rows_that_share_an_id_own_their_texts(spark):
    texts = near_copies(8, 3, 2) + ["quite another text of several words " * 3]
    rows = [(7, texts[0]), (7, texts[3]), (9, texts[1]), (8, texts[2]), (7, texts[0])]
    found = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(7, 7), (7, 7), (7, 7), (8, 7), (9, 7)]


def test_a_group_of_near_copies_is_not_tested_pair_by_pair(spark, monkeypatch):
    rng = random.Random(11)
    base, rows = [f"w{i}" for i in range(140)], []
    for i in range(240):
        words = list(base)
        for j in rng.sample(range(len(words)), rng.randrange(1, 4)):
            words[j] = f"other{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    tested, linked = [], ngram_join.linked

    def counted(docs, pairs, *rest):
        tested.append(pairs.count())
        return linked(docs, pairs, *rest)

    monkeypatch.setattr(ngram_join, "linked", counted)
    found = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_id(found, "n_shingles", "component_id") == brute.components(rows)
    assert sum(tested) < len(rows) ** 2 // 5


def shuffles(df):
    """The lines of the plan that shuffle by a key."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return [line for line in out.getvalue().split("\n") if "Exchange hashpartitioning(" in line]


def test_sets_are_shuffled_once_and_never_written(spark, monkeypatch):
    texts = near_copies(3, 12, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    levels = ngram_join.shingle_levels(docs)
    rows = ngram_join.set_rows(docs, levels, 5, 75)
    classes = rows.select("class", F.struct("doc_id", "text_key").alias("owner"), "n").distinct()
    side = lambda x: classes.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"))
    pairs = side("a").join(side("b"), F.col("a") < F.col("b"))
    assert pairs.count() > 30
    written = []
    monkeypatch.setattr(ngram_join, "stored", lambda df: written.append(df) or df)
    # tables too large for Spark to broadcast by itself
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ngram_join.linked(docs, pairs, classes.select("class", "owner"), levels, 5, 75)
        moved = shuffles(found)
        expected = {(a, b) for a, b in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not written
    # either side of the join by class and fragment; the last two hold numbers of pairs
    with_parts = [x for x in moved if not ("n_a" in x and "n_b" in x)]
    assert len(with_parts) == 2 and all("fragment" in x for x in with_parts)
    sets = {r["class"]: set(x) for r in rows.collect() for x in [shingle_set(texts[r.doc_id])]}
    near = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    assert expected == {(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])} and expected


def shingle_set(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_hubs_come_with_the_postings(spark):
    rows = [(1, 10, 40, 0, 50, 10), (1, 11, 40, 0, 50, 11), (1, 12, 41, 0, 50, 11), (2, 10, 40, 0, 50, 10), (2, 13, 40, 0, 50, 10)]
    rows += [(3, 11, 40, 0, 50, 11), (3, 13, 90, 1, 99, 10)]
    schema = "shingle long, class long, n long, band int, reach long, root long"
    placed = ngram_join.contested(spark.createDataFrame(rows, schema).repartition("shingle"))
    assert {r.shingle for r in placed.collect()} == {1, 3}
    met = ngram_join.with_hubs(placed, 0)
    assert len(shuffles(met)) == 1
    got = {(r.shingle, r["class"]): r.hub and tuple(r.hub) for r in met.collect()}
    assert got == {(1, 10): (11, 40, 11), (1, 11): (10, 40, 10), (1, 12): (10, 40, 10), (3, 11): None, (3, 13): None}


def test_counts_of_the_sketch_are_packed_without_loss():
    rng = np.random.default_rng(2)
    counts = np.where(rng.random(4096) < 0.2, rng.integers(1, 65536, 4096), 0).astype(np.uint16)
    total = np.arange(4096)
    ngram_join._add_packed(total, ngram_join._pack(counts))
    assert (total == np.arange(4096) + counts).all()
    assert len(ngram_join._pack(counts)) < counts.nbytes // 3
