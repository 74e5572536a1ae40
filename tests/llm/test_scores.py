"""Toxicity, language model, mixing, quality rules, token counts and archives."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.llm import mixing, pitman_yor, quality, shared, token_count, toxicity, warc
from tests.llm import brute

# --- toxicity --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        w = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.randrange(5, 120))]
        bad = rng.random() < 0.2
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["Nasty,", "vile", "foul."]))
        rows.append((i, " ".join(w), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()


def test_held_out_documents_are_told_apart(labelled, clash):
    model = toxicity.fit(clash(labelled.drop("toxic")), labelled.select("doc_id", "toxic"))
    # sparse: a few of the coordinates
    assert 0 < len(model["at"]) < 2000
    scored = toxicity.with_scores(clash(labelled), model).filter(shared.fold(F.col("doc_id")) == 0)
    rows = scored.select("toxic", "score").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in rows]) > 0.97
    again = toxicity.fit(labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic"))
    assert again["at"].tolist() == model["at"].tolist() and np.allclose(again["weight"], model["weight"])


def test_scores_of_odd_tables(spark, labelled):
    docs = labelled.select("doc_id", "text")
    none = labelled.select("doc_id", "toxic").limit(0)
    model = toxicity.fit(docs, none)
    assert len(model["at"]) == 0 and toxicity.with_scores(docs.limit(0), model).collect() == []
    odd = spark.createDataFrame([(1, None), (None, ""), (2, " . "), (2, "x " * 50_000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.with_scores(odd, model).collect())
    twice = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, twice).select("doc_id", "label").collect()
    assert [tuple(r) for r in rows] == [(1, 1)]


def test_features_are_words_pairs_and_skips():
    import pyarrow as pa

    text, _ = toxicity.features(pa.array(["a b c", None, "A, b. c!", "a"]))
    # 3 words, 2 pairs, 1 skip
    assert np.bincount(text, minlength=4).tolist() == [6, 0, 6, 1]
    _, one = toxicity.features(pa.array(["a b c"]))
    _, two = toxicity.features(pa.array(["A, b. c!"]))
    assert one.tolist() == two.tolist()


# --- language model --------------------------------------------------------------------


def lm_rows():
    rng = random.Random(6)
    # a word depends on the one before it
    follow = {f"w{k}": [f"w{rng.randrange(60)}" for _ in range(3)] for k in range(60)}
    rows = []
    for i in range(400):
        w = [f"w{rng.randrange(60)}"]
        for _ in range(rng.randrange(1, 60)):
            known = w[-1] in follow and rng.random() < 0.9
            w.append(rng.choice(follow[w[-1]]) if known else f"w{rng.randrange(60)}")
            if rng.random() < 0.05:
                w.append(f"r{rng.randrange(400)}")
        rows.append((i, " ".join(w)))
    return [*rows, (400, None), (401, ""), (402, "W1 never-seen"), (403, rows[0][1] * 40), (403, rows[0][1]), (None, "w1")]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame(lm_rows(), "doc_id long, text string").withColumn("score", F.lit("mine"))
    return pitman_yor.with_scores(df, shared.fold(F.col("doc_id")) == 1).collect()


def test_base_scores_are_exact(scored):
    fold = lambda i: brute.fold("" if i is None else i) == 1
    tokens = lambda t: [*brute.words(t, lower=True), "\n"]
    rows = lm_rows()
    count = Counter(w for i, t in rows if not fold(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    expected = sorted(
        (i is None, i or 0, fold(i), len(tokens(t)), sum(w in count for w in tokens(t)), n,
         round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6))
        for i, t in rows
    )
    got = sorted(
        (r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
        for r in scored
    )
    assert got == expected


def test_the_model_beats_the_base_on_held_out_texts(scored):
    held = [r for r in scored if r.held_out and r.doc_id != 403]
    n = sum(r.n_tokens for r in held)
    model, base = (10 ** (-sum(r[c] for r in held) / n) for c in ("score", "base_score"))
    assert model < 0.6 * base


def test_scores_agree_between_runs_and_bucket_counts(spark, scored, monkeypatch):
    df = spark.createDataFrame(lm_rows(), "doc_id long, text string")
    again = pitman_yor.with_scores(df, shared.fold(F.col("doc_id")) == 1).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, r.score)
    assert sorted(map(key, again)) == sorted(map(key, scored))
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 4_000)
    monkeypatch.setattr(pitman_yor, "HOT_WORDS", 7)
    split = pitman_yor.with_scores(df, shared.fold(F.col("doc_id")) == 1).collect()
    a = {(r.doc_id, r.n_tokens): r for r in scored}
    for r in split:
        other = a[r.doc_id, r.n_tokens]
        # other draws, the same model
        assert r.n_known == other.n_known and abs(r.base_score - other.base_score) < 1e-6
        assert abs(r.score - other.score) < 0.05 * abs(other.score) + 0.1


def test_probabilities_of_a_restaurant_sum_to_one(spark):
    docs = spark.createDataFrame([(k, t) for k, t in lm_rows() if t], "doc_id long, text string")
    counts = pitman_yor.pair_counts(docs, 1)
    model = pitman_yor.train(counts)
    row = counts.first()
    bucket = pitman_yor.Bucket(row["bucket"], row["keys"], row["counts"])
    own, parent = bucket.samples(model)
    unseen = np.array([[model.parent(t, 0.0, 0.0)] for t in model.totals[pitman_yor.BURN_IN + 1 :]])
    for klass in np.unique(bucket.klass)[:20]:
        line = np.zeros(len(bucket.word))
        here = bucket.klass == klass
        line[bucket.of[here]] = own[here]
        many = np.full(len(line), klass)
        total = pitman_yor.probability(model, line, many, parent).sum()
        total += pitman_yor.probability(model, np.zeros(1), many[:1], unseen)[0]
        assert abs(total - 1) < 1e-9


def test_every_preceding_word_has_its_own_restaurant(spark):
    # more contexts than any fixed number of classes would keep apart: each has one follower
    rows = [(k, " ".join(f"a{j} b{j}" for j in range(k * 20, k * 20 + 20)) + " ") for k in range(1000)]
    rows = [(k, t * 6) for k, t in rows]
    df = spark.createDataFrame([*rows, (-1, "a7 b7"), (-2, "a7 b9")], "doc_id long, text string")
    got = {r.doc_id: r for r in pitman_yor.with_scores(df, F.col("doc_id") < 0).collect()}
    # b7 takes nearly all of the restaurant of a7, however many other contexts there are
    assert got[-1].score - got[-2].score > 4.5
    likely = [r.score / r.n_tokens for r in got.values() if r.doc_id >= 0]
    assert min(likely) > -0.25


def test_scores_do_not_depend_on_which_totals_are_shuffled(spark, scored, monkeypatch):
    df = spark.createDataFrame(lm_rows(), "doc_id long, text string")
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(pitman_yor, "HOT_WORDS", 7)
    monkeypatch.setattr(pitman_yor, "HOT_CONTEXTS", 5)
    key = lambda r: (str(r.doc_id), r.n_tokens)
    rows = pitman_yor.with_scores(df, shared.fold(F.col("doc_id")) == 1).collect()
    for a, b in zip(sorted(rows, key=key), sorted(scored, key=key), strict=True):
        assert key(a) == key(b) and abs(a.score - b.score) < 1e-6


def test_draws_have_the_mean_and_spread_of_a_binomial():
    draws = pitman_yor.Draws(0, 0, np.arange(20_000))
    for n, p in ((8, 0.3), (50, 0.9), (4000, 0.4), (9, 1.0), (9, 0.0)):
        x = draws.at(np.arange(20_000), n).binomial(np.full(20_000, n), np.full(20_000, p))
        assert abs(x.mean() - n * p) < 5 * math.sqrt(n * p * (1 - p) / 20_000) + 1e-9
        assert abs(x.var() - n * p * (1 - p)) < 0.06 * n * p * (1 - p) + 1e-9


def test_seating_follows_the_restaurant_process():
    rng = np.random.default_rng(1)
    customers = np.full(4000, 300)
    tables = pitman_yor.seat(customers, np.zeros(4000), np.full(4000, 1.0), 0.5, 1.0, rng)
    # expected tables of one dish with a certain base: G(s+n+d) G(s+1) / (d G(s+n) G(s+d)) - s/d
    log = math.lgamma(301.5) + math.lgamma(2) - math.lgamma(301) - math.lgamma(1.5)
    assert abs(tables.mean() - (math.exp(log) / 0.5 - 2)) < 1.0
    one = pitman_yor.seat(np.array([0, 1]), np.zeros(2), np.ones(2), 0.5, 1.0, rng)
    assert one.tolist() == [0, 1]


def test_scores_without_rows_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for held in (F.lit(True), F.lit(False)):
        rows = pitman_yor.with_scores(df, held).collect()
        assert len(rows) == 2 and all(r.score <= 0 for r in rows)
    assert pitman_yor.with_scores(df.limit(0), F.lit(False)).collect() == []


# --- mixing ----------------------------------------------------------------------------


def mixed_rows(n=600):
    rng = random.Random(3)
    share = [("a", 40), ("b", 2), ("c", 2), ("d", 30), ("é", 20), (None, 6)]
    names = [s for s, k in share for _ in range(k)]
    return [(i, "w " * rng.randrange(1, 30), rng.choice(names)) for i in range(n)]


def test_targets_and_shares(spark, clash, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 50)
    rows = mixed_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(clash(df)).collect()
    expected = brute.targets([(s, len(brute.words(t))) for _, t, s in rows])
    taken = Counter()
    source = {i: s for i, _, s in rows}
    for r in found:
        size, target = expected[source[r.doc_id]]
        assert r.source_size == size and abs(r.target - target) < 1e-6
        assert r.taken == r.size * r.copies <= 3 * r.size and len(r.finishes) == r.copies
        taken[source[r.doc_id]] += r.taken
    assert {s for s, (size, t) in expected.items() if t == 3 * size}
    for s, (_, target) in expected.items():
        assert abs(taken[s] - target) <= 0.03 * target + 40
    total = sum(n for n, _ in expected.values())
    assert 0 <= total - sum(taken.values()) < 40
    # all that finishes earlier is taken before anything later
    latest = max(max(r.finishes, default=0) for r in found)
    assert latest <= 1.2
    key = lambda r: (r.doc_id, r.taken)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(key, again)) == sorted(map(key, found))


def test_mixes_of_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    rows = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], schema)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows) == [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0)]
    same = [(1, "x y", "a")] * 5 + [(None, "x y", "b"), (None, None, "b"), (None, "z", None)]
    found = mixing.mix(spark.createDataFrame(same, schema)).collect()
    assert len(found) == 8 and sum(r.taken for r in found) <= 13


# --- quality rules ---------------------------------------------------------------------


def test_counts_agree_with_plain_ones(docs, corpus, clash):
    found = quality.with_counts(clash(docs)).collect()
    for r in found:
        text = next(t for i, t, _ in corpus if i == r.doc_id)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality(text)[:5]


def test_the_cascade_rejects_what_any_rule_rejects(spark, docs, corpus, clash):
    found = quality.cascade(clash(docs))
    verdicts = {r.doc_id: r.rejected_by for r in found.collect()}
    for i, text, _ in corpus:
        if brute.quality(text)[5]:
            assert verdicts[i]
    assert sum(v is None for v in verdicts.values()) > 25
    assert {"symbols", "capitals"} <= {
        r.rejected_by for r in quality.cascade(docs, [x for x in quality.RULES if x not in quality.BASE_RULES]).collect()
    }
    assert quality.cascade(docs.limit(0)).collect() == []


def test_rules_go_by_rejection_per_cost():
    slow, fast, idle = (quality.Rule(n, (), None) for n in ("slow", "fast", "idle"))
    order = quality.by_rejection_per_cost(
        [{"rule": slow, "rejects": 0.5, "cost": 5.0}, {"rule": fast, "rejects": 0.3, "cost": 1.0},
         {"rule": idle, "rejects": 0.0, "cost": 0.1}]
    )
    assert [r.name for r in order] == ["fast", "slow", "idle"]


def test_the_main_path_is_native(docs):
    for found in (quality.cascade(docs), quality.judged(docs), mixing.mix(docs)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_the_query_stops_at_the_first_rejection(spark, docs, corpus, clash):
    """A rule that fails on rows which an earlier rule rejects is never run there."""
    broken = quality.Rule("broken", ("n_words", "n_lines"), lambda n, x: F.when(n < 50, F.raise_error(F.lit("run"))).otherwise(x < 0))
    known = quality.counts("text") | {c: F.col(c) for c in quality.BASE_COUNTS}
    order = [*quality.BASE_RULES, broken]
    found = quality.with_counts(docs).withColumn("rejected_by", quality.verdict(order, known)).collect()
    assert {r.doc_id for r in found if r.rejected_by} == {i for i, t, _ in corpus if brute.quality(t)[5]}
    got = {r.doc_id: r for r in quality.judged(clash(docs)).collect()}
    for i, text, _ in corpus:
        assert tuple(got[i][c] for c in quality.BASE_COUNTS) == brute.quality(text)[:5]
    assert quality.judged(docs.limit(0)).collect() == []


def test_rules_have_a_cost_of_their_own(docs):
    twice = docs.unionAll(docs).unionAll(docs)
    found = {e["rule"].name: e for e in quality.estimate(twice)}
    assert all(e["cost"] > 0 and 0 <= e["rejects"] <= 1 for e in found.values())
    # windows of all words take far longer than one pass over the letters
    assert found["repeated_words"]["cost"] > 2 * found["capitals"]["cost"]
    assert [e["rejects"] for e in quality.estimate(docs.limit(0))] == [0.0] * len(quality.RULES)


def test_windows_are_compared_by_whole_hashes(spark):
    """A very long text without any repeated window has none, however many windows there are."""
    text = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, text), (2, text + " w5 w6 w7")]
    found = quality.with_counts(spark.createDataFrame(rows, "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r.n_repeat_words for r in found] == [0, 6]


# --- token counts ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.PATTERN


def test_counts_are_those_of_the_library(spark, docs, corpus, clash, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary[0])
    texts = [t for _, t, _ in corpus] + [
        "a<|endoftext|>b<|endoftext|>", "\x1c\x1d x \x85 y　z   ", "it's we'LL 12³½ \n\n\t x", "日本語 テキスト😀😀",
        "\x00\x01", "<|endoftext", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9,
    ]
    df = clash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in token_count.with_token_counts(df, *vocabulary).collect():
        text = texts[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)
    assert token_count.with_token_counts(docs.limit(0), *vocabulary).collect() == []


def test_the_lowest_rank_pair_merges_first():
    ranks = {(b"b", b"c"): 0, (b"a", b"b"): 1, (b"a", b"bc"): 2}
    assert token_count.symbols_left(b"abc", ranks) == 1
    assert token_count.symbols_left(b"abab", ranks) == 2
    assert token_count.symbols_left(b"bbc", ranks) == 2
    assert token_count.symbols_left(b"", ranks) == 0


# --- archives --------------------------------------------------------------------------


@pytest.fixture
def pages(spark):
    long = "<p>" + "text " * 40
    rows = [
        (5, "http://a/1", long), (2, "http://a/2\r\nX: y", long), (9, None, long), (9, None, long), (None, "u", long),
        (3, "u", None), (4, "ü", ""), (7, "u", "short"), (8, "u", "short"), (2, "again", long), (6, "u", "é" * 60),
        (11, "u", "big " * 90_000), (1, "u", "\r\n\r\nWARC/1.1\r\n" * 20),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_archives_return_what_was_written(spark, pages, clash):
    df, rows = pages
    folder = shared.shared_folder(spark)
    warc.write_bundles(warc.plan_records(clash(df)), folder, frame_bytes=500, bundle_bytes=900)
    groups = defaultdict(list)
    for page, _, html in rows:
        if page is not None:
            groups[html or ""].append(page)
    expected = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = min(groups[html or ""], default=None)
        revisit = len(data) >= 100 and page is not None and page != first
        expected.append(
            (page or 0, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response",
             first if revisit else 0)
        )
    found = warc.resolve(warc.read_records(spark, folder)).collect()
    got = [(r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in found]
    assert sorted(got) == sorted(expected)
    assert sum(r.record_type == "revisit" for r in found) == 3


def test_one_record_is_read_through_the_index(spark, pages):
    df, _ = pages
    folder = shared.shared_folder(spark)
    warc.write_bundles(warc.plan_records(df), folder, frame_bytes=500, bundle_bytes=900)
    name = warc.record_id(6, hashlib.sha256(("é" * 60).encode()).hexdigest())
    wanted = spark.createDataFrame([(name,), ("no such record",)], "record_id string")
    (found,) = warc.find_records(spark, folder, wanted).collect()
    assert (found.page_id, found.payload.decode()) == (6, "é" * 60)


def test_bundles_are_seekable_zstandard(spark, pages):
    import io

    import zstandard

    df, _ = pages
    folder = shared.shared_folder(spark)
    warc.write_bundles(warc.plan_records(df), folder, frame_bytes=500)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/archives").collect()
    for f in files:
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.content), read_across_frames=True).read()
        places = warc.frame_places(f.content)
        assert len(plain) == sum(n for _, _, n in places) and plain.startswith(b"WARC/1.1\r\n")
        start, packed, n = places[-1]
        assert zstandard.ZstdDecompressor().decompress(f.content[start : start + packed]) == plain[-n:]


def test_archives_of_an_empty_table(spark, pages):
    folder = shared.shared_folder(spark)
    warc.write_bundles(warc.plan_records(pages[0].limit(0)), folder)
    assert warc.resolve(warc.read_records(spark, folder)).collect() == []
