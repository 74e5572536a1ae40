import random

import numpy as np
import pyarrow as pa

from fieldlens.llm import tokens
from tests.llm.brute import words

TEXTS = ["", None, "a", " a  b\tc\n", "Ünder GROSS x y", "\x1c a \x0b b\x0c", "x" * 500 + " y", "", "end"]


def test_words_are_those_of_each_text():
    for lower in (False, True):
        found = tokens.split(pa.array(TEXTS), lower)
        plain = [w.encode() for t in TEXTS for w in words(t, lower)]
        assert found.texts() == plain
        assert found.counts.tolist() == [len(words(t)) for t in TEXTS]
        same = {}
        for text, h in zip(plain, found.hash.tolist()):
            assert same.setdefault(text, h) == h
        assert len(set(same.values())) == len(same)


def patterned():
    """Pairs of unlike words that sums of letters times powers of one number take for equal."""
    half = "ab" * 16_384, "ba" * 16_384
    more = "x" * 65_536, "y" * 65_536
    turn = ["a"]
    for _ in range(13):
        turn.append(turn[-1] + turn[-1].translate({97: 98, 98: 97}))
    other = [t.translate({97: 98, 98: 97}) for t in turn]
    pairs = [(half[0] + half[1], half[1] + half[0]), (more[0] + more[1], more[1] + more[0])]
    return pairs + list(zip(turn, other)) + [("a", "a\0"), ("a" * 8, "a" * 9), ("a" * 8 + "\0", "a" * 8)]


def test_long_and_patterned_words_are_told_apart():
    for a, b in patterned():
        found = tokens.split(pa.array([a, b, a])).hash.tolist()
        assert found[0] == found[2] != found[1], (len(a), a[:9])


def test_a_slice_has_the_words_of_its_rows():
    whole = tokens.split(pa.array(TEXTS))
    part = tokens.split(pa.array(TEXTS).slice(3, 3))
    assert part.texts() == whole.texts()[whole.first[3] : whole.first[6]]


def test_windows_and_minima_agree_with_plain_loops():
    rng = random.Random(1)
    h = np.array([rng.randrange(5) for _ in range(60)], np.uint64)
    for k in (1, 2, 3, 5, 16, 50):
        found = tokens.windows(h, k).tolist()
        plain = [tuple(h[i : i + k].tolist()) for i in range(len(h) - k + 1)]
        assert len(set(zip(found, plain))) == len(set(found)) == len(set(plain))
        least = tokens.sliding_minimum(h, k).tolist()
        assert least == [min(h[i : i + k].tolist()) for i in range(len(h) - k + 1)]
    assert not len(tokens.windows(h[:3], 5))


def test_joined_keeps_the_chosen_words():
    texts = [" a b  c ", None, "d", "\tü  é\n f", "", "z z"]
    found = tokens.split(pa.array(texts))
    for drop in range(len(found)):
        keep = np.arange(len(found)) != drop
        plain, at = [], 0
        for t in texts:
            w = words(t)
            plain.append(" ".join(x for j, x in enumerate(w, at) if j != drop))
            at += len(w)
        assert tokens.joined(found, keep, tokens.raw(pa.array(texts))[1]).to_pylist() == plain


def test_pieces_hold_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab" * k for k in range(40)])], ["text"])
    found = list(tokens.pieces(batch, limit=100))
    assert len(found) > 1
    assert [x for p in found for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert list(tokens.pieces(batch.slice(0, 0))) == []
