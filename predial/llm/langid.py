"""Language identification with hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predial.llm.common import bounded_sample

DIMENSIONS = 1024
N = 3
SEED = 20
#: At most so many documents make the profiles.
SAMPLE = 20_000
UNKNOWN = "und"
_SEVERAL_SPACES = re.compile(" +")


class Letters:
    """Random vectors of +1 and -1 for letters, and n-gram vectors bound from them.

    The vector of an n-gram is the elementwise product of its letters' vectors, each rotated by its place from the end.
    """

    LIMIT = 60_000

    def __init__(self, dimensions: int = DIMENSIONS, n: int = N, seed: int = SEED):
        self.dimensions, self.n, self.seed = dimensions, n, seed
        self.letters: dict[int, list[np.ndarray]] = {}
        self.places: dict[int, int] = {}
        self.grams = np.zeros((1024, dimensions), np.float32)

    def letter(self, code: int) -> list[np.ndarray]:
        if code not in self.letters:
            if len(self.letters) > 4096:
                self.letters.clear()
            drawn = np.random.default_rng((self.seed, code)).integers(0, 2, self.dimensions, np.int8) * 2 - 1
            self.letters[code] = [np.roll(drawn, i) for i in range(self.n)]
        return self.letters[code]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Rows of the n-grams, each given as a number with 21 bits for each letter."""
        if len(self.places) + len(grams) > self.LIMIT:
            self.places.clear()
        rows = []
        for gram in grams.tolist():
            row = self.places.get(gram)
            if row is None:
                row = self.places[gram] = len(self.places)
                if row >= len(self.grams):
                    self.grams = np.concatenate((self.grams, np.zeros_like(self.grams)))
                bound = np.ones(self.dimensions, np.int8)
                for i in range(self.n):
                    bound = bound * self.letter(gram >> (21 * i) & 0x1FFFFF)[i]
                self.grams[row] = bound
            rows.append(row)
        return self.grams[rows]


_letters: dict[tuple, Letters] = {}


def letters(*key: int) -> Letters:
    if key not in _letters:
        _letters[key] = Letters(*key)
    return _letters[key]


class _Fold(dict):
    """For str.translate: letters and their marks stay, everything else becomes a space."""

    def __missing__(self, code: int) -> int:
        self[code] = code if unicodedata.category(chr(code))[0] in "LM" else 32
        return self[code]


_fold = _Fold()


def grams(text: str, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the words of text, each word between spaces, with their counts; none without letters."""
    plain = _SEVERAL_SPACES.sub(" ", f" {text.lower().translate(_fold)} ")
    if not any(map(str.isalpha, plain)):  # marks alone are no word
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(plain.encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(codes) < n or len(codes) == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = np.zeros(len(codes) - n + 1, np.int64)
    for i in range(n):
        out |= codes[n - 1 - i : len(codes) - i] << (21 * i)
    return np.unique(out, return_counts=True)


def bundle(texts: pd.Series, space: Letters) -> np.ndarray:
    """The unit vector of each text: the sum of its n-gram vectors, frequent n-grams damped; zero without letters."""
    out = np.zeros((len(texts), space.dimensions), np.float32)
    for i, text in enumerate(texts):
        found, counts = grams(text or "", space.n)
        for at in range(0, len(found), Letters.LIMIT // 2):  # very long texts, part by part
            part = slice(at, at + Letters.LIMIT // 2)
            out[i] += np.sqrt(counts[part]).astype(np.float32) @ space.vectors(found[part])
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


def profiles(known: DataFrame, key: tuple = (DIMENSIONS, N, SEED)) -> tuple[list[str], np.ndarray]:
    """Language names and the sums of their documents' vectors. known: text, lang. One partial sum for each language and
    Arrow batch leaves the executors; the driver gets one vector for each language."""

    def partial(batches):
        for part in batches:
            vectors = bundle(part["text"], letters(*key))
            sums = pd.DataFrame(vectors).groupby(part["lang"].to_numpy()).sum()
            yield pd.DataFrame({"lang": np.repeat(sums.index.to_numpy(), key[0]), "i": np.tile(np.arange(key[0]), len(sums)), "v": sums.to_numpy(np.float64).ravel()})

    summed = known.select("text", "lang").mapInPandas(partial, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("v")).orderBy("lang").collect()
    return [r.lang for r in rows], np.array([[x.v for x in r.v] for r in rows]).reshape(len(rows), key[0])


def language(docs: DataFrame, known: DataFrame, sample: int = SAMPLE, key: tuple = (DIMENSIONS, N, SEED)) -> DataFrame:
    """The language of each document: the profile with the greatest cosine to its vector.

    docs: doc_id, text; other columns are ignored. known: doc_id, text, lang, of which the rows with a lang and with the at
    most `sample` smallest hashes of doc_id are learned from: all rows of a doc_id that repeats, none without a doc_id.
    Returns doc_id, lang_pred, score (the cosine, after the mean of all profiles has been taken out of both vectors, clipped
    to 0 and 1), one row per row; a null or empty text, one without letters (marks are none), or any without a learned
    language is "und" with score 0. Ties go to the first language by name. Texts are read whole, however long.
    """
    known = known.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull())
    picked = F.broadcast(bounded_sample(known.select("doc_id").distinct(), "doc_id", sample))
    names, sums = profiles(known.join(picked, "doc_id", "left_semi"), key)
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    middle = unit.mean(axis=0) if len(unit) > 1 else np.zeros(key[0])
    apart = unit - middle
    apart /= np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-12)

    def predict(batches):
        for part in batches:
            for at in range(0, len(part), 512):
                rows = part.iloc[at : at + 512]
                vectors = bundle(rows["text"], letters(*key))
                some = np.linalg.norm(vectors, axis=1) > 0
                if not names:
                    some[:] = False
                shifted = vectors - middle * (vectors @ middle)[:, None] / max(middle @ middle, 1e-12)
                shifted /= np.maximum(np.linalg.norm(shifted, axis=1, keepdims=True), 1e-12)
                cosines = shifted @ apart.T if names else np.zeros((len(rows), 1))
                best = cosines.argmax(axis=1)
                yield pd.DataFrame({
                    "doc_id": rows["doc_id"],
                    "lang_pred": np.where(some, np.array(names or [UNKNOWN], object)[best], UNKNOWN),
                    "score": np.where(some, np.clip(cosines[np.arange(len(rows)), best], 0, 1), 0.0),
                })

    kept = docs.select("doc_id", "text")
    return kept.mapInPandas(predict, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
