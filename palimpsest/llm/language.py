"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary (those made of letters, perhaps after the
mark of a word's beginning) get a probability in each language. The probability of
a word is the sum over all ways to cut it into pieces of the product of the
pieces' probabilities, by the forward algorithm; a letter that no piece matches
has a small fixed probability. A text's score is the sum over its words, and the
answer is the language with the largest sum.

The probabilities are learned by expectation maximisation (forward and backward
sums) from the counts of all words of a bounded sample of labelled rows: about
``docs_per_language`` rows of each label, ``languages`` labels at a time. Rows are held out when crc32 of
the id as text is 1 modulo 3. Every text is then read in whole, in
batches; a worker remembers the sums of words it has seen. A word of any length is
summed with bounded memory beside the word itself.

Defined results: null texts and texts without a letter are `und` with score 0;
of equal sums the alphabetically first language wins; the score is the posterior
probability under equal priors; with no labelled rows every answer is `und`; a
null id is never held out; repeated rows agree; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import col, text_or_empty
from .arrays import mix, runs
from .tokens import vocabulary

MARK = "▁"
_WORD = re.compile(r"[^\W\d_]+")
#: Probability of a letter that is no piece.
UNKNOWN = 1e-8
#: Added to the expected count of every piece.
SMOOTHING = 0.02
REMEMBERED = 300_000
#: Languages for which those and GROUP are meant; with more of them, fewer words are kept at once.
ABREAST = 200
#: Texts are read in groups of about so many characters.
GROUP = 1 << 20
#: Letters of a word that are looked up at once. Longer words are learned from in stretches of so many.
STRETCH = 1 << 13
#: Letters of remembered words before a worker starts afresh.
LETTERS = 1 << 24


def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + code.astype(np.uint64) + np.uint64(1))


class Pieces:
    """Lookup of pieces and of their beginnings by hash."""

    def __init__(self, pieces: list[str]):
        ids: dict[int, int] = {}
        for i, piece in enumerate(pieces):
            h = np.zeros(1, np.uint64)
            for n, c in enumerate(piece, 1):
                h = _step(h, np.array([ord(c)]))
                ids[int(h[0])] = i if n == len(piece) else ids.get(int(h[0]), -1)
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        self.keys = np.array(sorted(ids), np.uint64)
        self.ids = np.array([ids[int(k)] for k in self.keys], np.int64)

    def lattice(self, words: list[str]) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
        """Lengths, and (piece length, flat places where one starts, piece); id n is an unknown letter."""
        longest = max(map(len, words))
        codes = np.array(words, f"<U{longest}").view(np.uint32).reshape(len(words), longest)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat, width = codes.ravel(), longest
        at = np.flatnonzero(flat)
        h = np.zeros(len(at), np.uint64)
        room = width - at % width  # letters to the end of the row
        arcs = []
        for m in range(1, longest + 1):
            inside = room >= m
            at, h, room = at[inside], h[inside], room[inside]
            code = flat[at + m - 1]
            real = code != 0
            at, room = at[real], room[real]
            h = _step(h[real], code[real])
            near = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            known = self.keys[near] == h
            ids = np.where(known, self.ids[near], -1)
            if m == 1:
                arcs.append((1, at, np.where(ids < 0, self.n, ids)))
            elif (ids >= 0).any():
                arcs.append((m, at[ids >= 0], ids[ids >= 0]))
            at, h, room = at[known], h[known], room[known]
            if not len(at):
                break
        return lengths, arcs


def _by_length(words: list[str], cells: int = 1 << 18) -> Iterator[np.ndarray]:
    """Numbers of words in groups of similar length and bounded size."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        z = at + 1
        while z < len(order) and (z - at + 1) * sizes[order[z]] <= cells and sizes[order[z]] <= 2 * sizes[order[at]] + 4:
            z += 1
        yield order[at:z]
        at = z


def _by_end(arcs: list, width: int) -> list[list]:
    """(piece length, words, pieces) of the arcs that end at each place."""
    ends: list[list] = [[] for _ in range(width + 1)]
    for m, at, ids in arcs:
        word, start = np.divmod(at, width)
        order = np.argsort(start, kind="stable")
        cuts = runs(start[order])
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            k = order[a:z]
            ends[int(start[k[0]]) + m].append((m, word[k], ids[k]))
    return ends


def _forward(lengths: np.ndarray, arcs: list, width: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over segmentations: alpha[word, place, language] times exp(scale[word, place])."""
    n, languages = len(lengths), table.shape[1]
    alpha = np.zeros((n, width + 1, languages))
    scale = np.zeros((n, width + 1))
    alpha[:, 0] = 1.0
    by_end = _by_end(arcs, width)
    for j in range(1, width + 1):
        scale[:, j] = scale[:, j - 1]
        for m, word, ids in by_end[j]:
            shift = np.exp(scale[word, j - m] - scale[word, j])[:, None]
            alpha[word, j] += alpha[word, j - m] * shift * table[ids]
        if j % 16 == 0:  # keep long words from running out of range
            most = alpha[:, j].max(1)
            most[most <= 0] = 1.0
            alpha[:, j] /= most[:, None]
            scale[:, j] += np.log(most)
    return alpha, scale


def _last_sums(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of words of similar length.

    The forward sums go through STRETCH letters at a time and hold the last places only, as
    many as the longest piece has letters, so memory doesn't grow with the length of a word.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ring, ends, width = pieces.longest + 1, set(lengths.tolist()), int(lengths.max())
    alpha = np.zeros((ring, len(words), table.shape[1]))
    scale = np.zeros((ring, len(words)))
    alpha[0] = 1.0
    out = np.zeros(alpha.shape[1:])
    for low in range(0, width, STRETCH):
        high, back = min(width, low + STRETCH), max(0, low - pieces.longest)
        by_end = _by_end(pieces.lattice([w[back:high] for w in words])[1], high - back)
        for j in range(low + 1, high + 1):
            here, scaled = alpha[j % ring], scale[j % ring]
            here[:] = 0.0
            scaled[:] = scale[(j - 1) % ring]
            for m, word, ids in by_end[j - back]:
                shift = np.exp(scale[(j - m) % ring, word] - scaled[word])[:, None]
                here[word] += alpha[(j - m) % ring, word] * shift * table[ids]
            if j % 16 == 0:  # keep long words from running out of range
                most = here.max(1)
                most[most <= 0] = 1.0
                here /= most[:, None]
                scaled += np.log(most)
            if j in ends:
                k = lengths == j
                out[k] = np.log(np.maximum(here[k], 1e-300)) + scaled[k, None]
    return out


def word_sums(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(words), table.shape[1]))
    for k in _by_length(words):
        group = [words[i] for i in k]
        for a in range(0, table.shape[1], ABREAST):
            out[k, a : a + ABREAST] = _last_sums(pieces, table[:, a : a + ABREAST], group)
    return out


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    table: np.ndarray  # (pieces + 1, languages)


def learn(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = 3) -> Model:
    """counts: language -> marked word -> how often."""
    languages, lookup = sorted(counts), Pieces(pieces)
    table = np.full((lookup.n + 1, len(languages)), UNKNOWN)
    for g, language in enumerate(languages):
        cut: Counter = Counter()
        for word, n in counts[language].items():
            for at in range(0, len(word), STRETCH):
                cut[word[at : at + STRETCH]] += n
        words = list(cut)
        weight = np.array([cut[w] for w in words], float)
        p = np.full((lookup.n + 1, 1), 1.0 / lookup.n)
        for _ in range(rounds):
            p[-1] = UNKNOWN
            expected = np.zeros(lookup.n + 1)
            for k in _by_length(words):
                _expect(lookup, p, [words[i] for i in k], weight[k], expected)
            expected[:-1] += SMOOTHING
            p = (expected / expected[:-1].sum())[:, None]
        table[:, g] = p[:, 0]
    table[-1] = UNKNOWN
    return Model(languages, lookup, table)


def _expect(lookup: Pieces, p: np.ndarray, words: list[str], weight: np.ndarray, expected: np.ndarray) -> None:
    """Add the expected uses of each piece, from forward and backward sums."""
    lengths, arcs = lookup.lattice(words)
    width = max(map(len, words))
    alpha, scale = _forward(lengths, arcs, width, p)
    beta = np.zeros((len(words), width + 1))
    beta[np.arange(len(words)), lengths] = 1.0
    total = np.maximum(alpha[np.arange(len(words)), lengths, 0], 1e-300)
    starts: list[list] = [[] for _ in range(width)]
    for m, at, ids in arcs:
        word, start = np.divmod(at, width)
        order = np.argsort(start, kind="stable")
        cuts = runs(start[order])
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            k = order[a:z]
            starts[int(start[k[0]])].append((m, word[k], ids[k]))
    for i in range(width - 1, -1, -1):
        for m, word, ids in starts[i]:
            onward = p[ids, 0] * beta[word, i + m]
            beta[word, i] += onward
            use = alpha[word, i, 0] * onward * np.exp(scale[word, i] - scale[word, lengths[word]]) / total[word]
            np.add.at(expected, ids, use * weight[word])


def letter_pieces(model_path: str) -> list[str]:
    """The vocabulary's pieces of lower-case letters, with or without the mark."""
    import sentencepiece

    read = sentencepiece.SentencePieceProcessor(model_file=model_path)
    every = (read.id_to_piece(i) for i in range(read.get_piece_size()))
    return sorted({p for p in every if p == MARK or ((q := p.removeprefix(MARK)).isalpha() and q == q.lower())})


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter = Counter()
        for language, text in zip(batch["lang"], batch["text"], strict=True):
            counts.update((language, w) for w in _WORD.findall(text.lower()))
        yield pd.DataFrame([(a, w, n) for (a, w), n in counts.items()], columns=["lang", "word", "n"])


def held_out(name: str):
    return F.coalesce(F.crc32(F.encode(col(name).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, model_path: str, docs_per_language: int = 1500, languages: int = 200) -> Model | None:
    """Fit on the rows that are not held out: every label, ``languages`` of them in each pass over the rows."""
    known = docs.where(~held_out(id_col) & col(lang_col).isNotNull() & col(text_col).isNotNull())
    labels = known.groupBy(col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()
    draw = F.pmod(F.xxhash64(col(id_col), F.lit("sample")), F.lit(1_000_000)) / 1e6
    every = known.select(col(lang_col).alias("lang"), col(text_col).cast("string").alias("text"), draw.alias("draw"))
    pieces, models = letter_pieces(model_path) if labels else [], []
    for at in range(0, len(labels), languages):
        block = labels[at : at + languages]
        share = F.create_map(*[F.lit(x) for r in block for x in (r["lang"], min(1.0, docs_per_language / r["n"]))])
        sample = every.where(F.col("draw") < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("lang", "text")
        words = sample.mapInPandas(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        counts: dict[str, dict[str, int]] = {r["lang"]: {} for r in block}
        for r in words.orderBy("lang", "word").toLocalIterator():
            counts[r["lang"]][MARK + r["word"]] = r["n"]
        counts = {k: v for k, v in counts.items() if v}
        if counts:
            models.append(learn(counts, pieces))
    return _together(models) if models else None


def _together(models: list[Model]) -> Model:
    """One model of the languages of all; each language is learned by itself."""
    if len(models) == 1:
        return models[0]
    names = [x for m in models for x in m.languages]
    order = sorted(range(len(names)), key=names.__getitem__)
    return Model([names[i] for i in order], models[0].pieces, np.concatenate([m.table for m in models], 1)[:, order])


class Reader:
    """Answers for texts; the sums of words are remembered."""

    def __init__(self, model: Model):
        self.model, self.known, self.letters = model, {}, 0
        self.sums = np.zeros((0, len(model.languages)))
        self.most = REMEMBERED * ABREAST // max(ABREAST, len(model.languages))

    def read(self, texts: list[str]) -> list[tuple[str, float]]:
        found = [_WORD.findall(t.lower()) for t in texts]
        known = self.known
        fresh = list({w for words in found for w in words if w not in known})
        if len(known) + len(fresh) > self.most or self.letters + sum(map(len, fresh)) > LETTERS:
            known.clear()
            self.letters = 0
            self.sums = self.sums[:0]
            fresh = list({w for words in found for w in words})
        if fresh:
            self.letters += sum(map(len, fresh))
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            self.sums = np.concatenate([self.sums, word_sums(self.model.pieces, self.model.table, [MARK + w for w in fresh])])
        out = []
        for words in found:
            if not any(c.isalpha() for w in words for c in w):
                out.append(("und", 0.0))
                continue
            total = self.sums[[known[w] for w in words]].sum(0)
            best = int(total.argmax())
            out.append((self.model.languages[best], float(1.0 / np.exp(np.minimum(total - total[best], 0)).sum())))
        return out


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score of every row; only the text is read for a prediction."""
    kind = docs.schema[id_col].dataType.simpleString()

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model) if model else None
        most = GROUP * ABREAST // max(ABREAST, len(model.languages) if model else 0)
        for batch in batches:
            texts, told, group, held = batch.pop("text").tolist(), [], [], 0
            for i, t in enumerate(texts):
                group.append(t)
                held += len(t)
                if held >= most or i == len(texts) - 1:
                    told += reader.read(group) if reader else [("und", 0.0)] * len(group)
                    group, held = [], 0
            yield batch.assign(lang_pred=[t[0] for t in told], score=[t[1] for t in told])

    read = docs.select(col(id_col).alias("id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))
    return read.mapInPandas(answer, f"id {kind}, held_out boolean, lang_pred string, score double")


def op9_unigram_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, "doc_id", "text", "lang", vocabulary("piece_bpe_32k.model"))
    return identify(docs, model).withColumnRenamed("id", "doc_id")
