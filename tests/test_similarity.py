"""The ratio of two texts against difflib's, and how little of a long text it goes through."""

from __future__ import annotations

import difflib
import random
import time

from palimpsest.functions import text as tx


def test_ratio_is_that_of_difflib():
    rng = random.Random(7)
    for n in range(600):
        letters = ["ab", "abcdefgh ", "etaoin shrdlu" * 3 + "qxzäß0123456789"][n % 3]
        a, b = ("".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 40, 199, 201, 420]))) for _ in range(2))
        b = a[: len(a) // 2] + b if n % 4 == 0 else b
        assert tx.similarity(a, b) == (difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0)


def test_long_texts_take_a_fraction_of_the_time():
    rng = random.Random(8)
    a, b = (" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(5)) + ("q" if k % 40 == 0 else "") for k in range(3000)) for _ in range(2))
    at = time.perf_counter()
    whole = difflib.SequenceMatcher(None, a, b).ratio()
    took, at = time.perf_counter() - at, time.perf_counter()
    assert tx.similarity(a, b) == whole and time.perf_counter() - at < took / 2


def test_ratio_of_copies_with_changes_and_of_long_runs():
    """Texts of many rare characters, so that runs are longer than those that are looked up, repeated, moved and changed."""
    rng = random.Random(9)
    many, few = "".join(map(chr, range(0x4E00, 0x4E00 + 250))), "etaoinshrdlu" * 8 + "qxzj"
    for n in range(400):
        letters = [many, few, "ab", "aé😀z "][n % 4]
        b = "".join(rng.choice(letters) for _ in range(rng.choice([1, 30, 199, 200, 600])))
        parts = [b[k : k + 1 + n % 60] for k in range(0, len(b), 40)]
        rng.shuffle(parts)
        changed = [rng.choice(letters) if rng.random() < 0.02 else c for c in b]
        a = ["".join(parts), "".join(changed), b[len(b) // 3 :] + b[: len(b) // 2], (b[:20] * 30)[: 1 + n], b][n // 4 % 5]
        assert tx.similarity(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_time_grows_little_faster_than_the_text():
    """Texts eight times as long take less time than difflib takes for the short ones."""
    rng = random.Random(10)
    letters = "etaoin shrdlu" * 10 + "qxzjvk"
    made = lambda n: ["".join(rng.choices(letters, k=n)) for _ in range(2)]
    at = time.perf_counter()
    difflib.SequenceMatcher(None, *made(10_000)).ratio()
    took, at = time.perf_counter() - at, time.perf_counter()
    tx.similarity(*made(80_000))
    assert time.perf_counter() - at < took


def test_a_short_periodic_text_is_not_compared_at_every_place():
    at = time.perf_counter()
    assert tx.similarity("ab" * 10_000, "ab" * 90 + "c") == 2 * 180 / 20_181
    assert time.perf_counter() - at < 5
