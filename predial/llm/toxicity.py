"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predial.llm import features
from predial.llm.common import NOT_ALNUM, Words, bounded_sample, staged, text_batches, use_checkpoints

#: At most so many labelled rows are learned from.
SAMPLE = 24_000
#: Parts of 10 of the sample: from which the lexicon, and from which the trees are learned; the rest calibrates.
LEXICON_TENTHS, TREE_TENTHS = 4, 4
LEXICON_SIZE = 3_000
PREFIXES = (4, 5, 6)
NEAR = 6
#: Second-person words.
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "ya", "u", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "du",
    "dich", "dir", "dein", "deine", "deiner", "deinen", "ihr", "euch", "euer", "eure", "ti", "tus", "tuyo", "usted",
    "ustedes", "vosotros", "os", "vuestro", "vuestra",
)
#: Insults that are looked for in any case.
SEED_INSULTS = (
    "idiot", "moron", "stupid", "dumb", "loser", "trash", "scum", "worthless", "pathetic", "disgusting", "clown", "fool",
    "garbage", "imbecile", "jerk", "freak", "filth", "vermin", "crap", "bastard", "ugly", "hate", "shut", "kill",
)
_LEET = [str.maketrans("013457@$!", f"o{one}eastasi") for one in "li"]
#: Chunks with a character that may stand for a letter, or between letters.
_MARKED = re.compile(r"[^\s]*[0134579@$!*._\-][^\s]*")
_OTHER = re.compile(r"[^a-z]+")
_NAMES = (
    "insults", "insult_density", "learned", "learned_density", "strongest", "weight", "near_second_person", "second_person",
    "hidden_insult_rate",
)


def _keys(found: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Word rows and hashes: of the whole words, and of their beginnings."""
    return [(np.arange(len(found.keys)), found.keys), *(found.prefix_keys(n) for n in PREFIXES)]


def _sorted_keys(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(Words(pa.array([" ".join(words)]), NOT_ALNUM).keys)


def _isin(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(keys), bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys


def hidden_insults(text: str) -> int:
    """Chunks that are an insult only when signs that stand for letters are read as these, or signs between letters go."""
    n = 0
    for chunk in _MARKED.findall(text.lower()):
        plain = chunk.strip(".!_-*")
        n += plain not in SEED_INSULTS and any(_OTHER.sub("", x) in SEED_INSULTS for x in (plain, *map(plain.translate, _LEET)))
    return n


def _features(texts: pa.Array, lexicon: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The surface features and those of _NAMES; lexicon is sorted."""
    base, found = features.surface(texts)
    n = len(texts)
    count = np.maximum(np.bincount(found.doc, minlength=n), 1).astype(float)
    insult = _isin(found.keys, _sorted_keys(SEED_INSULTS))
    weight = np.zeros(len(found.keys))
    for rows, keys in _keys(found):
        hit = _isin(keys, lexicon)
        weight[rows[hit]] = np.maximum(weight[rows[hit]], weights[np.searchsorted(lexicon, keys[hit])])
    person = _isin(found.keys, _sorted_keys(SECOND_PERSON))
    bad = insult | (weight > 0)
    place = np.where(person, np.arange(len(person)), -10 * NEAR)
    behind = np.maximum.accumulate(place) if len(place) else place
    ahead = np.minimum.accumulate(np.where(person, np.arange(len(person)), 10**12)[::-1])[::-1] if len(place) else place
    here = np.arange(len(place))
    near = np.zeros(len(place), bool)
    for other, ok in ((behind, behind >= 0), (ahead, ahead < 10**12)):
        other = np.where(ok, other, 0)
        if len(place):
            near |= ok & (np.abs(here - other) <= NEAR) & (found.doc[other] == found.doc)
    total = lambda x: np.bincount(found.doc, weights=x, minlength=n)
    strongest = np.zeros(n)
    np.maximum.at(strongest, found.doc, weight)
    hidden = np.zeros(n)
    marked = np.flatnonzero(base[:, features.NAMES.index("marked_words")] + base[:, features.NAMES.index("digits")] > 0)
    for i in marked.tolist():
        hidden[i] = hidden_insults(texts[i].as_py() or "") / count[i]
    extra = np.column_stack([
        total(insult), total(insult) / count, total(weight > 0), total(weight > 0) / count, strongest,
        total(weight) / count, total(bad & near), total(person) / count, hidden,
    ])
    return np.column_stack([base, extra])


def _add_features(rows: DataFrame, lexicon: np.ndarray, weights: np.ndarray) -> DataFrame:
    """rows without text and with an array column features."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")

    def add(batches):
        for table in text_batches(batches, 2 << 20):
            found = _features(table.column("text").combine_chunks(), lexicon, weights)
            flat = pa.array(found.reshape(-1))
            offsets = pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32))
            yield from table.drop(["text"]).append_column("features", pa.ListArray.from_arrays(offsets, flat)).to_batches()

    return rows.mapInArrow(add, f"{schema}, features array<double>")


def learn_lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Words and beginnings of words that toxic documents hold and others don't: sorted hashes, and log-odds weights.

    rows: text, label. Documents are counted on the executors; at most size terms reach the driver.
    """

    def terms(batches):
        for table in text_batches(batches, 2 << 20):
            found = features.surface(table.column("text").combine_chunks())[1]
            label = table.column("label").to_numpy().astype(np.int64)
            keys = np.concatenate([k for _, k in _keys(found)])
            doc = np.concatenate([found.doc[r] for r, _ in _keys(found)])
            order = np.lexsort((keys, doc))
            keys, doc = keys[order], doc[order]
            new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))) if len(keys) else np.zeros(0, bool)
            u, code = np.unique(keys[new], return_inverse=True)
            bad = np.bincount(code, weights=label[doc[new]], minlength=len(u))
            every = np.bincount(code, minlength=len(u))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(bad), pa.array(every - bad)], ["term", "bad", "good"])

    docs = rows.groupBy().agg(F.sum("label"), F.count("*")).first()
    n_bad, n_good = docs[0] or 0, docs[1] - (docs[0] or 0)
    counted = rows.select("text", "label").mapInArrow(terms, "term long, bad double, good double")
    counted = counted.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.1) / (n_bad + 0.2)) - F.log((F.col("good") + 0.1) / (n_good + 0.2))
    spread = F.sqrt(1 / (F.col("bad") + 0.1) + 1 / (F.col("good") + 0.1))
    best = counted.filter("bad >= 2").withColumn("w", odds).withColumn("z", odds / spread).filter("w > 2.2")
    best = best.orderBy(F.desc("z"), "term").limit(size).select("term", "w").collect()
    keys = np.array([r.term for r in best], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r.w for r in best])[order]


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """A calibrated probability of label 1 for each document, from its text alone.

    docs: doc_id, text; a null text counts as empty, and empty texts get the score of a text without any feature. labels:
    doc_id, label (0, 1; null ones are left out), the rows that may be learned from; of rows with equal doc_id one
    counts. At most sample of them are used, those with the smallest hashes of doc_id. Without labels of both kinds every
    score is the share of 1. Returns doc_id, score; one row per row of docs.
    """
    spark = docs.sparkSession
    use_checkpoints(spark)
    docs = docs.select("doc_id", "text")
    picked = bounded_sample(labels.select("doc_id", "label").dropna().groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id", sample)
    part = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(10))
    known = docs.join(F.broadcast(picked), "doc_id").select("text", F.col("label").cast("double"), part.alias("part"))
    known = staged(known, "toxic-sample")
    lexicon, weights = learn_lexicon(known.filter(F.col("part") < LEXICON_TENTHS))
    rest = _add_features(known.filter(F.col("part") >= LEXICON_TENTHS), lexicon, weights)
    rest = staged(rest, "toxic-features").select("label", "part", array_to_vector("features").alias("features"))
    trees = F.col("part") < LEXICON_TENTHS + TREE_TENTHS
    kinds = {(r.label, r.t) for r in rest.groupBy("label", trees.alias("t")).count().collect()}
    if not {(0.0, True), (1.0, True)} <= kinds:
        share = known.agg(F.avg("label")).first()[0] or 0.0
        return docs.select("doc_id", F.lit(float(share)).alias("score"))
    fitted = GBTClassifier(maxIter=25, maxDepth=4, stepSize=0.2, minInstancesPerNode=3, subsamplingRate=0.8, seed=5, maxBins=48).fit(rest.filter(trees))
    fitted.setFeaturesCol("features")
    chance = vector_to_array(F.col("probability"))[1]
    judged = fitted.transform(rest.filter(~trees)).select("label", chance.alias("chance"))
    # Half a row of each kind at either end keeps the ends of the curve off 0 and 1.
    ends = spark.createDataFrame([(0.0, 0.0, 0.5), (1.0, 1.0, 0.5)], "label double, chance double, weight double")
    curve = IsotonicRegression(featuresCol="chance", labelCol="label", weightCol="weight", predictionCol="score").fit(
        judged.withColumn("weight", F.lit(1.0)).unionByName(ends)
    )
    scored = _add_features(docs, lexicon, weights).select("doc_id", array_to_vector("features").alias("features"))
    scored = curve.transform(fitted.transform(scored).select("doc_id", chance.alias("chance")))
    return scored.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))
