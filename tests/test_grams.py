"""Grams as whole arrays are those of the strings, for any text."""

import random
from collections import Counter

import numpy as np
import pytest

from tessaria.operators import grams as G

ODD = ["", "a", "abcd", "abcde", "aaaaaaaaaa", "x\0abcdef", "don’t “say” that – ever…", "日本語のテキストです", "mixed 日本 and latin", "😀 smile 😀", "ÀÉÎõü ߿ ࠀ abc", " ⟿⠀abcde", "a\nb\nc\nd\ne\nf"]


def _strings(text, n=5):
    return {text[i : i + n] for i in range(max(1, len(text) - n + 1))}


@pytest.mark.parametrize("n", [5, 3])
def test_numbers_are_those_of_the_strings(n):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abcdef é’\n") for _ in range(rng.randrange(2000))) for _ in range(40)]
    # A second round meets what is remembered, also where another gram took its place.
    for t in texts + texts[::-1]:
        assert G.ids(t, n).tolist() == sorted(G.digests(_strings(t, n)).tolist())


def test_few_places_give_the_same_numbers(monkeypatch):
    monkeypatch.setattr(G, "KNOWN", 4)
    monkeypatch.setattr(G, "_TABLES", {})
    for t in ODD * 2:
        assert G.ids(t).tolist() == sorted(G.digests(_strings(t)).tolist())


def test_digests_are_made_of_new_grams_alone(monkeypatch):
    monkeypatch.setattr(G, "_TABLES", {})
    made, digests = [], G.digests
    monkeypatch.setattr(G, "digests", lambda grams: made.append(len(grams)) or digests(grams))
    text = "the same words of a text stand here"
    G.ids(text)
    n = sum(made)
    G.ids(text + "s")
    assert n == len(_strings(text)) and sum(made) == n + 1


def test_shared_windows():
    for x in ODD:
        for y in ODD:
            a, b = G.window_set(x), G.window_set(y)
            assert G.shared(a, b) == len(_strings(x) & _strings(y))
            assert G.part_numbers(a, b, True).tolist() == sorted(G.digests(_strings(x) & _strings(y)).tolist())
            assert G.part_numbers(a, b, False).tolist() == sorted(G.digests(_strings(x) - _strings(y)).tolist())


@pytest.mark.parametrize("room", [1, 7, 1000])
def test_counts(room):
    rng, held, want = random.Random(2), G.Counts(room), Counter()
    for _ in range(50):
        some = rng.sample(range(40), rng.randrange(12))
        held.add(np.array(sorted(some), np.uint64))
        want.update(some)
    held.settle()
    assert dict(zip(held.keys.tolist(), held.n.tolist(), strict=True)) == want
