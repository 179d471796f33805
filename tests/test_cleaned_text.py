"""Cleaned texts against the rules applied one after the other, and their time."""

from __future__ import annotations

import functools
import random
import re
import time
import unicodedata

from palimpsest.functions import fixed
from palimpsest.functions import text as tx


@functools.lru_cache(None)
def _kept(c: str) -> bool:
    return c in "\t\n\r" or " " <= c <= "~" or unicodedata.category(c)[0] in fixed.KEPT_CATEGORIES


def plainly(text: str) -> str:
    text = "".join(c if _kept(c) else " " for c in unicodedata.normalize("NFC", text))
    for pattern, put in fixed.NOISE:
        text = re.sub(pattern, put, text)
    return text.strip()


def test_cleaned_texts_are_those_of_the_rules():
    rng = random.Random(3)
    letters = ["ab ", "aab\n", "0aF: ,\n\t", "aZ9+/= ", "    x", "éü\u0000\x7f\x1c\x85é€😀\ud800", "aaaa    \n\n\n\n----", "etaoin shrdlu.,\n0"]
    for n in range(3000):
        each = letters[n % len(letters)] if n % 3 else "".join(letters)
        text = "".join(rng.choice(each) * rng.choice([1, 1, 1, 2, 3, 4, 5, 17, 41] if n % 2 else [1]) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 40, 90, 200])))
        assert tx.clean_for_embedding(text) == plainly(text), ascii(text)
    for text in ["", " ", "\n", "a" * 3, "a" * 4, "\n" * 9, "ab" * 8, "ab" * 7 + "a", "ab:" * 8, "ab" * 20 + "=", " a" * 30, "ab  " * 8, "x" + "ab" * 8 + "y" * 40, "Q7" * 20, "a" * 4 + "b" * 4, "a\ud83d"]:
        assert tx.clean_for_embedding(text) == plainly(text), ascii(text)


def test_long_texts_take_a_fraction_of_the_time():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("etaoinshrdlüß") for _ in range(5)) for _ in range(40_000))
    plainly("a"), tx.clean_for_embedding("a")
    at = time.perf_counter()
    wanted = plainly(text)
    took, at = time.perf_counter() - at, time.perf_counter()
    assert tx.clean_for_embedding(text) == wanted and time.perf_counter() - at < took / 3
