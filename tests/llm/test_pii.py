import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldlens.llm import pii
from tests.llm import brute

SOUP = st.lists(
    st.sampled_from(
        ["a", "Z9", "@", ".", "-", "+", " ", "  ", "(", ")", "1", "25", "256", "4111", "1111111111111111", "0", "007",
         "x.y", "é", "\n", "%", "4539 1488 0343 6467", "+1 (555) 010-9999", "192.168.0.1", "me@ex.org"]
    ),
    max_size=25,
).map("".join)


def as_brute(text):
    found = brute.personal_data(text)
    return [(k, a, b) for k, name in enumerate(pii.KINDS) for a, b in found[name]]


@settings(max_examples=1500, deadline=None)
@given(SOUP)
def test_fixed_formats_are_the_patterns(text):
    assert pii.base_spans(text) == as_brute(text)


def test_long_words_take_linear_time():
    for text in ("a", "1", "+1", "a@", "1.", "1 ", "(", "a@b.", "1-(", "@a.", "at ", "1(.)"):
        text = text * (300_000 // len(text))
        pii.base_spans(text)
        pii.proposals(text)


def valid_card(rng):
    while True:
        d = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if pii.luhn(d):
            return d


def number(rng, n):
    return "".join(rng.choice("0123456789") for _ in range(n))


def texts(seed, n=1200):
    """Prose with personal data, and with order numbers, versions and hex strings that are none."""
    rng = random.Random(seed)
    word = lambda: rng.choice("field water crop soil rain sun harvest seed and the of in".split())
    prose = lambda: " ".join(word() for _ in range(rng.randrange(3, 9)))
    kinds = [
        lambda: f"jo.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com",
        lambda: ".".join(str(rng.randrange(1, 256)) for _ in range(4)),
        lambda: valid_card(rng),
        lambda: f"+1 ({rng.randrange(100, 999)}) 555-{number(rng, 4)}",
        lambda: "order no. " + number(rng, rng.choice([8, 12, 14])),
        lambda: f"version {rng.randrange(300, 999)}.{rng.randrange(300, 999)}.{rng.randrange(9)}.{rng.randrange(9)}",
        lambda: 'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"',
        lambda: "see look@home and 1 + 1",
    ]
    return [" ".join([prose(), rng.choice(kinds)(), prose()]) for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(t,) for t in texts(1)]
    return pii.fit(spark.createDataFrame(rows, "text string"))


def spans(spark, model, rows):
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(rows)], "doc_id int, text string, spans string")
    return {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_personal_data(df, model).collect()}


def test_other_spellings_are_added_and_plain_numbers_left(spark, model):
    assert any(map(math.isfinite, model.least))
    new = texts(2, 400)
    found = spans(spark, model, new)
    for i, t in enumerate(new):
        assert [s[:3] for s in found[i] if s[3]] == as_brute(t)
    clean = [i for i, t in enumerate(new) if not as_brute(t)]
    assert sum(bool(found[i]) for i in clean) <= 0.02 * len(clean)
    rng = random.Random(3)
    spelt = [f"the field {pii.respelt(k, x, i)} and the rain" for i in range(40) for k, x in (
        (2, valid_card(rng)), (3, f"+1 ({rng.randrange(100, 999)}) 555-{number(rng, 4)}"))]
    found = spans(spark, model, spelt)
    assert sum(bool(found[i]) for i in range(len(spelt))) >= 0.7 * len(spelt)


def test_odd_texts(spark, model):
    rows = [None, "", " ", "x" * 100_000 + " me@ex.org", "me@ex.org", "me@ex.org"]
    found = spans(spark, model, rows)
    assert found == {0: [], 1: [], 2: [], 3: [(0, 100_001, 100_010, True)], 4: [(0, 0, 9, True)], 5: [(0, 0, 9, True)]}


def test_nothing_to_learn_from(spark):
    assert pii.fit(spark.createDataFrame([], "text string")) is None
    assert pii.fit(spark.createDataFrame([("plain words",), (None,)], "text string")) is None
    assert spans(spark, None, ["call +1 (555) 555-0100"]) == {0: [(3, 5, 22, True)]}


def test_redaction(spark):
    df = spark.createDataFrame([("to me@ex.org or +1 (555) 555-0100!",), (None,)], "text string")
    out = pii.find_personal_data(df, None).select(pii.redacted().alias("t"))
    assert [r.t for r in out.collect()] == ["to <email> or <phone>!", None]


def test_thresholds():
    margin = np.array([0.0, 1, 2, 3, 4] * 40)
    label = (margin >= 2).astype(float)
    assert pii.least_margin(margin, label) == 2
    assert pii.least_margin(margin, np.zeros(200)) == math.inf
    assert pii.least_margin(margin, label, seen=999) == math.inf


def test_query_counts_each_kind(spark, tmp_path):
    rows = [
        "+1 (555) 555-0100", "1.2.3.4 and 5.6.7.8", "4539148803436467", "me@ex.org 1.2.3.4 +1 (555) 555-0100", "plain",
        "you@ex.org me@ex.org and us@ex.org, 4539148803436467", None, "", "0" * 5000 + ".1.2.3",
    ]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in pii.op13_personal_data(spark, str(tmp_path)).collect()}
    assert sorted(found) == list(range(len(rows)))
    for i, text in enumerate(rows):
        # the plain patterns read parts as numbers, of which Python takes 4300 digits
        want = brute.personal_data(text) if i < 8 else brute.personal_data("") | {"ip": [(0, len(text))]}
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS], text
        named = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k])
        assert found[i].base_sha256 == hashlib.sha256(named.encode()).hexdigest()


def test_trees_learn_from_all_texts(spark):
    # of many texts few have an address: a part of them would not give as many examples as a threshold needs
    rare = F.when(F.col("id") % 1100 == 0, F.concat(F.lit("write to me"), "id", F.lit("@ex.org now")))
    other = F.when(F.col("id") % 500 == 1, F.concat(F.lit("order no. "), F.col("id") + 10**13, F.lit(" of")))
    docs = spark.range(110_000).select(F.coalesce(rare, other, F.concat(F.lit("text "), "id")).alias("text"))
    assert math.isfinite(pii.fit(docs).least[0])


def test_pools_of_parts_are_those_of_the_whole():
    rng = np.random.default_rng(4)
    rows = [(float(i), 3, int(rng.binomial(3, i / 300))) for i in range(300)]
    parts = [p for at in range(0, 300, 70) for p in pii.pooled(rows[at : at + 70])]
    assert pii.pooled(parts) == pii.pooled(rows)
