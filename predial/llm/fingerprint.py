"""Canonical exact digests of documents, with built-in functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from predial.llm.common import staged, whole_ids

_ICU = "com.ibm.icu"
#: Digests of several rows are broadcast up to this number; above, all texts are grouped by their digests.
BROADCAST_DIGESTS = 200_000
#: Ranges of doc_id that are cut by quantiles; each is then cut evenly into buckets, of which there are at most so many.
RANGES, BUCKETS = 512, 1 << 18


def canonical(text: Column) -> Column:
    """Unicode NFKC with full case folding; runs of white space become one space, none at the ends; null becomes ''.

    Folding may undo a normal form and the other way round, so both are applied twice, behind a first normalisation.
    """
    text = F.coalesce(text, F.lit(""))
    compose = lambda x: F.java_method(F.lit(f"{_ICU}.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    fold = lambda x: F.java_method(F.lit(f"{_ICU}.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    # Plain ASCII has neither forms nor foldings beyond lower case.
    normal = F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(compose(fold(compose(fold(compose(text))))))
    return F.trim(F.regexp_replace(normal, r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits of xxhash, as 32 hex digits: two chains of different seeds."""
    word = lambda salt: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(salt), canon))), 16, "0")
    return F.concat(word(1), word(2))


def collisions(canon: DataFrame, hashed: Callable[[Column], Column] = digest) -> DataFrame:
    """Canonical texts that share their digest with another text: digest, canon, variant. With 128 bits there should be none.

    canon: a column canon. Rows are grouped by digest and text together, so bytes are compared wherever digests are equal,
    and copies collapse before the shuffle. Only digests of several texts are looked at again.
    """
    counted = canon.groupBy(hashed(F.col("canon")).alias("digest"), "canon").agg(F.count("*").alias("n_docs"))
    several = counted.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    order = Window.partitionBy("digest").orderBy("canon")
    return counted.join(several, "digest", "left_semi").select("digest", "canon", (F.row_number().over(order) - 1).alias("variant"))


def with_fingerprint(
    rows: DataFrame, columns: dict[str, str], collided: DataFrame | None, hashed: Callable[[Column], Column] = digest
) -> DataFrame:
    """Replace canonical texts by fingerprints: columns maps the name of a canonical text to that of its fingerprint.

    The fingerprint is the digest; where another text has the same digest, variants from 1 on get "-variant" behind it.
    """
    for canon, name in columns.items():
        rows = rows.withColumn(name, hashed(F.col(canon)))
        if collided is not None:
            found = collided.select(F.col("digest").alias(name), F.col("canon").alias(canon), F.col("variant").alias("_variant"))
            rows = rows.join(found, [name, canon], "left")
            rows = rows.withColumn(name, F.when(F.col("_variant") > 0, F.concat_ws("-", name, "_variant")).otherwise(F.col(name)))
            rows = rows.drop("_variant")
    return rows


def fingerprints(docs: DataFrame, hashed: Callable[[Column], Column] = digest) -> DataFrame:
    """docs with fingerprint: equal for texts that are equal after normalisation, different for others.

    docs: doc_id, text; other columns are dropped. A null text is the empty text; rows with equal doc_id stay apart.
    """
    docs = docs.select("doc_id", "text")
    collided = staged(collisions(docs.select(canonical(F.col("text")).alias("canon")), hashed), "collisions")
    rows = docs.withColumn("canon", canonical(F.col("text")))
    return with_fingerprint(rows, {"canon": "fingerprint"}, None if collided.isEmpty() else collided, hashed).select("doc_id", "text", "fingerprint")


def _place(value: Column, edges: list[int]) -> Column:
    """The number of edges below value, which ascend; by bisection."""
    if not edges:
        return F.lit(0)
    known = F.array(*(F.lit(x).cast("long") for x in edges))
    half = lambda at: F.floor((at.a + at.b) / 2).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(len(edges).bit_length())),
        F.struct(F.lit(0).alias("a"), F.lit(len(edges)).alias("b")),
        lambda at, _: F.when(at.a >= at.b, at).otherwise(
            F.when(F.element_at(known, half(at) + 1) < value, F.struct((half(at) + 1).alias("a"), at.b.alias("b"))).otherwise(
                F.struct(at.a.alias("a"), half(at).alias("b"))
            )
        ),
        lambda at: at.a,
    )


def with_next(docs: DataFrame, bucket_bytes: int = 2 << 20, ranges: int = RANGES, buckets: int = BUCKETS) -> DataFrame:
    """Each row with next_text, next_id and next_tie: those of the row behind it in descending doc_id (nulls last, equal ids
    in the order of their texts' hashes, tie); behind the last row comes the first.

    Rows are dealt into buckets of about bucket_bytes: ranges of doc_id by quantiles, each cut into even parts; rows without
    an id by the hash of their text. The first row of each bucket is also sent to the bucket before, so that each finds all
    its successors by itself. There are at most BUCKETS buckets for each range of ids, so what is broadcast is bounded.
    """
    spark = docs.sparkSession
    docs = whole_ids(docs).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n_bytes, rows, known, least, most = docs.agg(F.sum(F.octet_length("text")), F.count("*"), F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(buckets, math.ceil((n_bytes or 0) / bucket_bytes)))
    cuts: list[int] = []
    if known:
        tops = min(n, ranges)
        cuts = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / tops for i in range(1, tops)], 0.2 / tops)} - {most}) if tops > 1 else []
    parts = math.ceil(n / (len(cuts) + 1))
    # Range 0 holds the largest ids; rows without ids come behind all others.
    highs, lows = [*cuts, most or 0], [least or 0, *(x + 1 for x in cuts)]
    place = _place(F.col("doc_id"), cuts)
    bound = lambda x: F.element_at(F.array(*(F.lit(v).cast("double") for v in x)), place + 1)
    share = (bound(highs) - F.col("doc_id")) / (bound(highs) - bound(lows) + 1)
    clip = lambda x, m: F.least(F.greatest(F.floor(x * m), F.lit(0)), F.lit(m - 1))
    without = max(1, math.ceil(n * (1 - known / max(rows, 1))))
    of_none = len(cuts) + 1
    bucket = F.when(F.col("doc_id").isNull(), F.lit(of_none * parts) + clip(F.col("tie") / 2.0**64 + 0.5, without))
    bucket = bucket.otherwise((F.lit(len(cuts)) - place) * parts + clip(share, parts)).cast("long")
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).withColumn("bucket", bucket)
    # The first row: the largest id, then the least tie.
    first = F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("id"), F.bitwise_not("tie").alias("not_tie"))
    top = F.least(F.floor(F.col("bucket") / parts), F.lit(of_none)).alias("top")
    heads = staged(dealt.groupBy("bucket").agg(F.max(first).alias("head")).select("bucket", "head", top), "next-heads")
    # One row for each range, at most RANGES + 1.
    lasts = [(r.top, r.bucket) for r in heads.groupBy("top").agg(F.max("bucket").alias("bucket")).orderBy("top").collect()]
    wraps = spark.createDataFrame([(t, lasts[i - 1][1]) for i, (t, _) in enumerate(lasts)], "top long, wrap long")
    inside = F.lag("bucket").over(Window.partitionBy("top").orderBy("bucket"))
    guests = heads.join(F.broadcast(wraps), "top").select(
        F.col("bucket").alias("b"), F.col("head.id").alias("d"), F.bitwise_not("head.not_tie").alias("t"), F.coalesce(inside, "wrap").alias("other")
    )
    is_head = (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    there = F.struct(F.col("other").alias("bucket"), F.lit(True).alias("guest"))
    places = F.explode(F.when(F.col("other").isNull(), F.array(here)).otherwise(F.array(here, there)))
    both = dealt.join(F.broadcast(guests), is_head, "left").select("doc_id", "text", "tie", places.alias("at"))
    order = Window.partitionBy("at.bucket").orderBy("at.guest", F.col("doc_id").desc_nulls_last(), "tie")
    after = F.lead(F.struct("text", "doc_id", "tie")).over(order).alias("after")
    found = both.select("doc_id", "text", "tie", "at", after).filter(~F.col("at.guest"))
    return found.select("doc_id", "text", "tie", F.col("after.text").alias("next_text"), F.col("after.doc_id").alias("next_id"), F.col("after.tie").alias("next_tie"))


def _edited(text: str, after: str) -> Column:
    """The text with its last half replaced by as much of what comes after, or by all of it."""
    half = f"cast(floor(char_length({text}) / 2) as int)"
    return F.expr(f"case when char_length({text}) > 1 then concat(left({text}, char_length({text}) - {half}), left({after}, {half})) else {text} end")


def edited_pairs(docs: DataFrame, hashed: Callable[[Column], Column] = digest) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness.

    docs: doc_id (an integer type, may be null or repeat; other types raise), text (null: empty); other columns are ignored. The edited text has its last floor(n_chars / 2) characters replaced by the first as many (or
    all) of the next row's text; see with_next(). Likeness is 1 for canonical texts of equal bytes, 0 for others.
    Fingerprints are equal where canonical texts are, edited ones included. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, one row per row.
    """
    kind = whole_ids(docs).schema["doc_id"].dataType
    rows = with_next(docs).select(
        "doc_id", "tie", "next_id", "next_tie", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(_edited("text", "next_text").cast("binary"), 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("canon"), canonical(_edited("text", "next_text")).alias("edited_canon"), canonical(F.col("next_text")).alias("next_canon"),
    )
    like = lambda other: (F.col("canon") == F.col(other)).cast("double")
    rows = rows.withColumns({"near_edited": like("edited_canon"), "near_next": like("next_canon")})
    rows = with_fingerprint(rows, {"canon": "fingerprint", "edited_canon": "edited_fingerprint"}, None, hashed)
    found = staged(rows.drop("canon", "edited_canon", "next_canon"), "fingerprints")
    found = _told_apart(docs, found, hashed)
    return found.select(F.col("doc_id").cast(kind), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _told_apart(docs: DataFrame, found: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """found, where digests that different canonical texts have are made different: of texts and of edited texts alike."""
    # An edited text that equals its own text needs no look.
    edits = found.filter("near_edited = 0").select(F.col("edited_fingerprint").alias("digest"), F.lit(True).alias("edited"))
    every = found.select(F.col("fingerprint").alias("digest"), F.lit(False).alias("edited")).unionByName(edits)
    several = every.groupBy("digest").agg(F.count("*").alias("n"), F.max("edited").alias("edited")).filter("n > 1")
    several = staged(several.select("digest", "edited"), "several")
    n, with_edits = several.agg(F.count("*"), F.count_if("edited")).first()
    if not n:
        return found
    few = F.broadcast if n <= BROADCAST_DIGESTS else (lambda x: x)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("canon", canonical(F.col("text")))
    texts = texts.join(few(several.select(F.col("digest").alias("d"))), hashed(F.col("canon")) == F.col("d"), "left_semi")
    texts = texts.select(F.xxhash64("text").alias("tie"), F.lit(None).cast("long").alias("next_tie"), "canon")
    if with_edits:
        # What these rows' texts and the next ones are is read again, not shuffled with all others.
        asked = found.filter("near_edited = 0").join(several.filter("edited").select(F.col("digest").alias("edited_fingerprint")), "edited_fingerprint", "left_semi")
        asked = staged(asked.select("tie", "next_tie").distinct(), "edited-again")
        few = F.broadcast if asked.count() <= BROADCAST_DIGESTS else (lambda x: x)
        known = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
        known = known.join(few(asked.select("tie").union(asked.select("next_tie")).distinct()), "tie", "left_semi").distinct()
        known = staged(known, "edited-texts")
        edited = asked.join(known, "tie").join(known.select(F.col("tie").alias("next_tie"), F.col("text").alias("next_text")), "next_tie")
        texts = texts.unionByName(edited.select("tie", "next_tie", canonical(_edited("text", "next_text")).alias("canon")))
    texts = texts.withColumn("digest", hashed(F.col("canon")))
    counted = texts.groupBy("digest", "canon").agg(F.count("*").alias("n"))
    collided = counted.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    if collided.isEmpty():
        return found
    variants = collisions(texts.select("canon"), hashed).select("digest", "canon", F.when(F.col("variant") > 0, F.concat_ws("-", "digest", "variant")).otherwise(F.col("digest")).alias("new"))
    new = staged(texts.join(variants, ["digest", "canon"]).select("tie", "next_tie", "new").distinct(), "new-digests")
    of_text = new.filter("next_tie is null").select("tie", F.col("new").alias("new_text"))
    of_edit = new.filter("next_tie is not null").select("tie", "next_tie", F.col("new").alias("new_edit"))
    found = found.join(of_text, "tie", "left").join(of_edit, ["tie", "next_tie"], "left")
    name = F.coalesce("new_text", "fingerprint")
    return found.withColumn("edited_fingerprint", F.when(F.col("near_edited") == 1, name).otherwise(F.coalesce("new_edit", "edited_fingerprint"))).withColumn("fingerprint", name)
