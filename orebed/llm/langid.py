"""Language identification with hyperdimensional profiles.

Each letter (and the space between words) has a random vector of +1 and -1. A letter n-gram is the elementwise product of its
letters' vectors, each rotated by its place in the n-gram; a text is the sum of its n-grams, and a language the sum of its
texts. A text has the language whose vector has the largest cosine with its own (Joshi, Halseth and Kanerva, 2016).

Rows: a null text and one without a letter are `und` with score 0. A tie goes to the language that sorts first. Without
training texts every text is `und`. Rows without a lang aren't learned from. Equal rows each give a row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebed.llm.frames import map_columns, pick

UNKNOWN = "und"
#: Texts are taken in runs of about so many characters, cut into pieces of about this length if longer.
RUN_CHARS = 1 << 19
#: n-gram vectors that a worker keeps.
KEPT_GRAMS = 1 << 14
#: So many letters at most make dense n-gram codes; beyond it codes are sorted instead.
DENSE_LETTERS = 128


@dataclass(frozen=True)
class Settings:
    """dims: length of the vectors. docs_per_language: about so many training documents of each language are learned from, drawn
    by a hash of doc_id. max_languages bounds what is sent to the driver and to each task: so many vectors."""

    dims: int = 1024
    ngram: int = 3
    docs_per_language: int = 4000
    max_languages: int = 1000


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its letter in lower case, or 0 for whatever isn't a letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


class Space:
    """Letter and n-gram vectors of one worker."""

    def __init__(self, dims: int, ngram: int) -> None:
        self.dims, self.ngram = dims, ngram
        self.number = np.full(0x110000, -1, np.int64)
        self.points: list[int] = []
        self.vectors: list[np.ndarray] = []
        self.known: dict[int, int] = {}
        self.grams = np.empty((KEPT_GRAMS, dims), np.int8)

    def _numbered(self, points: np.ndarray) -> np.ndarray:
        out = self.number[points]
        if (out < 0).any():
            for p in np.unique(points[out < 0]).tolist():
                self.number[p] = len(self.points)
                self.points.append(p)
                self.vectors.append((np.random.default_rng(p).integers(0, 2, self.dims) * 2 - 1).astype(np.int8))
            out = self.number[points]
        return out

    def _gram(self, letters: tuple[int, ...]) -> np.ndarray:
        out = np.ones(self.dims, np.int8)
        for place, letter in enumerate(letters):
            out *= np.roll(self.vectors[letter], self.ngram - 1 - place)
        return out

    def sums(self, texts: list[str]) -> np.ndarray:
        """The vector of each text; zero if it has no letter."""
        out = np.zeros((len(texts), self.dims), np.float64)
        piece, at, size = [], [], 0
        for i, text in enumerate(texts):
            start, lap = 0, self.ngram - 1
            while start < len(text):
                end = min(start + RUN_CHARS, len(text))
                while end < len(text) and not text[end - lap : end].isalpha():
                    end += 1  # cut between letters only, where no run of other characters is shortened
                # each piece begins with the last letters of the one before: the n-grams across the cut
                part = text[max(0, start - lap) : end]
                piece.append((part, start == 0, end == len(text)))
                at.append(i)
                size += len(part)
                if size >= RUN_CHARS:
                    self._add(out, piece, at)
                    piece, at, size = [], [], 0
                start = end
        if piece:
            self._add(out, piece, at)
        return out

    def _add(self, out: np.ndarray, pieces: list[tuple[str, bool, bool]], at: list[int]) -> None:
        joined = "".join((" " * first) + part + (" " * last) for part, first, last in pieces)
        owner = np.repeat(np.arange(len(pieces)), [len(part) + first + last for part, first, last in pieces])
        points = _letters()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != 0) | (points[:-1] != 0) | (owner[1:] != owner[:-1])
        points, owner = points[keep], owner[keep]
        n, size = self.ngram, len(points) - self.ngram + 1
        if size <= 0:
            return
        letters = self._numbered(points)
        base = 1 << max(7, (len(self.points) - 1).bit_length())
        codes = np.zeros(size, np.int64)
        for j in range(n):
            codes = codes * base + letters[j : j + size]
        whole = owner[:size] == owner[n - 1 :]
        whole &= np.logical_or.reduce([points[j : j + size] != 0 for j in range(n)])
        codes, owner = codes[whole], owner[:size][whole]
        if not len(codes):
            return
        if base <= DENSE_LETTERS and n <= 3:
            found = np.flatnonzero(np.bincount(codes, minlength=1))
            place = np.empty(int(found[-1]) + 1, np.int64)
            place[found] = np.arange(len(found))
            column = place[codes]
        else:
            found, column = np.unique(codes, return_inverse=True)
        for low in range(0, len(found), KEPT_GRAMS // 2):
            part = found[low : low + KEPT_GRAMS // 2]
            inside = (column >= low) & (column < low + len(part))
            counts = np.bincount(owner[inside] * len(part) + column[inside] - low, minlength=len(pieces) * len(part))
            sums = counts.reshape(len(pieces), len(part)).astype(np.float32) @ self.grams[self._rows(part, base)].astype(np.float32)
            np.add.at(out, at, sums)

    def _rows(self, codes: np.ndarray, base: int) -> list[int]:
        """Where the vectors of these n-grams are kept."""
        names = [tuple(code // base**j % base for j in range(self.ngram - 1, -1, -1)) for code in codes.tolist()]
        if len(self.known) + len(names) > KEPT_GRAMS:
            self.known.clear()
        rows = []
        for name in names:
            row = self.known.get(name)
            if row is None:
                row = self.known[name] = len(self.known)
                self.grams[row] = self._gram(name)
            rows.append(row)
        return rows


@lru_cache(2)
def _space(dims: int, ngram: int) -> Space:
    return Space(dims, ngram)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text is divisible by 5. Never for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, settings: Settings = Settings()) -> tuple[list[str], np.ndarray]:
    """The languages in order, and their vectors scaled to length 1. Learns from text and lang alone."""
    given = pick(docs, "doc_id", "text", "lang").where("text is not null and lang is not null and doc_id is not null")
    sizes = dict(given.groupBy("lang").count().limit(settings.max_languages + 1).collect())
    if len(sizes) > settings.max_languages:
        raise ValueError(f"more than {settings.max_languages} languages")
    if not sizes:
        return [], np.zeros((0, settings.dims))
    names, space = sorted(sizes), 1 << 30
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(space))
    shares = [(name, min(space, settings.docs_per_language * space // sizes[name])) for name in names]
    below = F.broadcast(given.sparkSession.createDataFrame(shares, "lang string, below long"))  # max_languages rows at most
    dims, ngram = settings.dims, settings.ngram

    def run(langs: list, texts: list) -> tuple[list, ...]:
        made = _space(dims, ngram).sums(texts)
        seen = sorted(set(langs))
        return seen, [made[[x == lang for x in langs]].sum(axis=0) for lang in seen]

    parts = map_columns(given.join(below, "lang").where(draw < F.col("below")).select("lang", "text"), run, "lang string, vector array<double>")
    sums = parts.select("lang", F.posexplode("vector").alias("dim", "value")).groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    vectors = np.zeros((len(names), dims))
    for lang, dim, value in sums.collect():  # languages x dimensions, however many documents
        vectors[names.index(lang), dim] = value
    norms = np.linalg.norm(vectors, axis=1)
    return [n for n, x in zip(names, norms) if x], vectors[norms > 0] / norms[norms > 0, None]


def _best(texts: list[str | None], model: tuple[list[str], np.ndarray], settings: Settings) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    names, vectors = model
    if not names:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    made = _space(settings.dims, settings.ngram).sums([t or "" for t in texts])
    norms = np.linalg.norm(made, axis=1)
    cosines = made @ vectors.T / np.maximum(norms, 1e-300)[:, None]
    best = cosines.argmax(axis=1)
    score = np.where(norms > 0, np.clip(cosines[np.arange(len(texts)), best], 0.0, 1.0), 0.0)
    return [names[b] if x else UNKNOWN for b, x in zip(best, norms)], score.tolist()


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the cosine, at least 0). Uses text alone."""
    given = pick(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), "text")
    return map_columns(given, lambda ids, held, texts: (ids, held, *_best(texts, model, settings)), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def tag(docs: DataFrame, model: tuple[list[str], np.ndarray], settings: Settings = Settings()) -> DataFrame:
    """docs (which has a text) with lang_pred and score; columns of these names are replaced."""
    given = docs.select(*(F.col(f"`{name}`") for name in docs.columns if name.lower() not in ("lang_pred", "score")))
    at = given.columns.index("text")
    schema = ", ".join(f"`{name}` {kind}" for name, kind in [*given.dtypes, ("lang_pred", "string"), ("score", "double")])
    return map_columns(given, lambda *columns: (*columns, *_best(columns[at], model, settings)), schema)


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Learn from the documents that aren't held out, and predict for all."""
    return predict(docs, train(docs.where(~held_out()), settings), settings)
