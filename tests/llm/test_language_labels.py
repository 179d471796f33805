"""Language identification with more labels than one pass learns."""

from __future__ import annotations

import numpy as np
import pytest

from palimpsest.llm import language
from palimpsest.llm.tokens import vocabulary

TEXTS = {"aa": "the house stands near the river", "bb": "das haus steht nahe am fluss und", "cc": "la maison est pres de la riviere", "dd": "casa blanca cerca del rio grande"}


def test_rare_labels_are_learned_too(spark, monkeypatch):
    rows = [(n * 100 + i, text, label) for n, (label, text) in enumerate(TEXTS.items()) for i in range(40 - n)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    path = vocabulary("piece_bpe_32k.model")
    parts, whole = (language.train(table, "doc_id", "text", "lang", path, languages=n) for n in (2, 200))
    assert parts.languages == whole.languages == sorted(TEXTS) and np.array_equal(parts.table, whole.table)
    told = language.identify(table, parts).collect()
    assert len(told) == len(rows) and all(r["lang_pred"] == list(TEXTS)[r["id"] // 100] for r in told)
    plain = language.Reader(whole).read(list(TEXTS.values()))
    monkeypatch.setattr(language, "ABREAST", 3)
    few = language.Reader(whole).read(list(TEXTS.values()))
    assert [x for x, _ in few] == [x for x, _ in plain] and [s for _, s in few] == pytest.approx([s for _, s in plain])


def test_very_long_words(monkeypatch):
    """Sums are the same however a word is cut into stretches, and memory doesn't follow the word."""
    import random
    import tracemalloc

    random.seed(3)
    names = language.letter_pieces(vocabulary("piece_bpe_32k.model"))
    pieces = language.Pieces(names)
    table = np.random.default_rng(1).dirichlet(np.full(pieces.n + 1, 0.5), 12).T + 1e-12
    words = ["\u2581" + "".join(random.choices("abcdefghijklmnoprstu\u00e4\u4e00", k=k)) for k in (1, 2, 15, 16, 17, 99, 300, 310)]
    lengths, arcs = pieces.lattice(words)
    alpha, scale = language._forward(lengths, arcs, max(map(len, words)), table)
    row = np.arange(len(words))
    plain = np.log(alpha[row, lengths]) + scale[row, lengths][:, None]
    for stretch in (1 << 13, 64, 17, 3):
        monkeypatch.setattr(language, "STRETCH", stretch)
        assert language.word_sums(pieces, table, words) == pytest.approx(plain, rel=1e-9)
    monkeypatch.undo()
    peaks = []
    for k in (20_000, 50_000):  # two stretches are held at most
        word = "\u2581" + "".join(random.choices("abcdefghij", k=k))
        tracemalloc.start()
        assert np.isfinite(language.word_sums(pieces, table, [word])).all()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] + 1_000_000


def test_a_reader_forgets_letters(monkeypatch):
    counts = {"aa": {"\u2581the": 5}, "bb": {"\u2581das": 5}}
    reader = language.Reader(language.learn(counts, ["\u2581", "\u2581the", "\u2581das", "t", "h", "e", "d", "a", "s"]))
    monkeypatch.setattr(language, "LETTERS", 50)
    for k in range(1, 40):
        assert [x for x, _ in reader.read(["the " + "h" * k, "das " + "s" * k])] == ["aa", "bb"]
        assert sum(map(len, reader.known)) <= max(50, 2 * k + 6)
