import random

import pytest

WORDS = "alpha beta gamma delta omega Ünder größe naïve rain soil field water crop yield leaf root".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", ",", ".", ""]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, source): copies, near copies, shared passages and lines, long, empty, null and odd texts."""
    rng = random.Random(5)
    passage = sentence(rng, 70)
    line = "a line that MANY documents share"
    base = sentence(rng, 160)
    words = base.split()
    rows, i = [], 0

    def add(text, source="s0"):
        nonlocal i
        rows.append((i * 3, text, source))
        i += 1

    for k in range(12):
        add(sentence(rng, 60) + "\n" + sentence(rng, 40), f"s{k % 5}")
    for k in range(6):
        add(base, "s0")
        near = list(words)
        near[10 * k] = "changed"
        near[10 * k + 70] = "again"
        add(" ".join(near), "s1")
    for _ in range(8):
        add(sentence(rng, 30) + "\n" + passage + "\n" + sentence(rng, 25), "s2")
    for _ in range(6):
        add("\t " + line.upper() + " \r\n" + sentence(rng, 20) + "\n" + line + "\n" + line + "\nshort", None)
    add(sentence(rng, 9000) + "\n" + passage + "\n" + sentence(rng, 4000), "s3")
    add("x" * 70_000 + " " + "y" * 70_000)
    for text in (None, "", " \t\n ", "one", "One two  three", "\n\n", "ünïcödé     words", "the same the same " * 40):
        add(text)
    add(sentence(rng, 20) + " ### $$$ | | | *** &&& " * 12)
    add("THESE ARE ALL CAPITALS " * 30)
    return rows


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, source string")


@pytest.fixture
def clash():
    """Adds columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = (
        "key n pos line n_lines n_dropped kept_text spans items n_words score label first last seed class hub "
        "digest copies size target taken draw row slice n_tokens n_bytes over_limit rejected_by held_out h x text_id"
    ).split()
    return lambda df: df.withColumns({c: F.lit("mine") for c in names if c not in df.columns})
