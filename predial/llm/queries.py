"""The registered queries of the text operators, each over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from predial.llm import align, bpe, decontam, fingerprint, langid, lm, neardup, packing, phrases, quality, repeats, tokens, toxicity
from predial.llm.common import held_out, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; crossing tokens go to the line with most of their characters."""
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness; see fingerprint.edited_pairs()."""
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from labels outside the held-out quarter."""
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id", 4, 2))
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), labels.select("doc_id", F.col("toxic").alias("label")))
    return scored.select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removal of bytes that a smaller doc_id has as well, in strings of 50, does to every document."""
    return repeats.removal_report(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    predicted = langid.language(docs, docs.filter(~held_out("doc_id", 4, 2)))
    return predicted.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in pieces, packed into sequences of at most 4096."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every text under a model of those outside the held-out tenth."""
    return lm.score(table(spark, sf_dir, "documents"), ~held_out("doc_id", 10, 0))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document and the class's size."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def site_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, score: str = "score", keep: str = "keep") -> DataFrame:
    """Documents scored with the labels of sf_dir; their source is the host, source and language the path."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.quality(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"), score=score, keep=keep)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, and whether it is kept."""
    return site_quality(spark, table(spark, sf_dir, "documents"), sf_dir).select("doc_id", "score", "keep")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items of which they hold 0.8 or more of the shingles."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of each language whose words stand together most unusually often."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the bytes decoded from them, as digests."""
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256")
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers go together in every document."""
    found = align.alignments(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.withColumn("groups_sha256", digest).drop("groups")


def queries() -> dict:
    found = (
        op1_token_counts, op2_fingerprints, op3_toxicity, op4_repeats, op5_language, op6_packing, op7_language_model, op8_near_duplicates, op9_quality, op10_decontamination, op11_collocations, op12_byte_bpe, op13_alignment,
    )
    return {f.__name__: f for f in found}


#: Distinct shingles of five words, or one of all words of a shorter text, for the texts of a table.
_SHINGLES = r"""
    select id, n, case when n < 5 then array_to_string(w, ' ') else array_to_string(w[i:i+4], ' ') end as s
    from (select id, w, len(w) as n, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i
          from (select {id} as id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+') as w from {table})
          where len(w) > 0)
"""


def oracle_sql() -> dict[str, str]:
    docs, items = (_SHINGLES.format(id=i, table=t) for i, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    return {
        "op10_decontamination": f"""
with d as (select distinct id, least(n, 5) as k, s from ({docs})),
     b as (select distinct id, least(n, 5) as k, s from ({items})),
     total as (select id, count(*) as n from b group by id)
select d.id as doc_id, b.id as item_id, count(*)::double / any_value(total.n) as containment
from d join b on d.s = b.s and d.k = b.k join total on total.id = b.id
group by d.id, b.id having count(*)::double / any_value(total.n) >= 0.8""",
        "op11_collocations": r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces),
total as (select lang, sum(len(w))::hugeint as n from w group by lang),
grams as (
  select lang, size, array_to_string(w[i:i+size-1], ' ') as phrase, count(*)::hugeint as f
  from (select lang, w, size, unnest(range(1, len(w) - size + 2)) as i from w, range(1, 6) sizes(size) where len(w) >= size)
  group by all having count(*) >= 100),
cand as (select * from grams where size > 1),
kept as (
  select * from cand c where not exists (
    select 1 from cand d where d.lang = c.lang and d.size > c.size and 100 * d.f >= 100 * c.f
      and contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts as (
  select lang, phrase, f, k, array_to_string(w[1:k], ' ') as a, array_to_string(w[k+1:size], ' ') as b, size
  from (select *, string_split(phrase, ' ') as w, unnest(range(1, size)) as k from kept)),
scored as (
  select c.lang, c.phrase, c.f as a, x.f as l, y.f as r, n, k, (1000 * c.f * n) // (x.f * y.f) as score
  from cuts c join grams x on x.lang = c.lang and x.phrase = c.a and x.size = k
    join grams y on y.lang = c.lang and y.phrase = c.b and y.size = c.size - k join total on total.lang = c.lang),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest) where rank <= 2000""",
    }
