"""Document quality: text evidence combined with what is known of its host and path, by empirical Bayes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predial.llm import features
from predial.llm.common import bounded_sample, fresh, salted, staged, text_batches

#: At most so many labelled rows are fitted on.
SAMPLE = 24_000
KEEP = 0.5
#: Sites are broadcast up to this number; above, rows are shuffled to them.
BROADCAST_SITES = 20_000


def expanded(base: np.ndarray) -> np.ndarray:
    """Features with a second, saturating form, so that a linear model can tell rare from frequent."""
    return np.column_stack([base, np.sqrt(np.abs(base)), np.minimum(base * 20, 1)])


def _with(rows: DataFrame, name: str, kind: str, compute) -> DataFrame:
    """rows and a column that compute makes from an Arrow array of texts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def add(batches):
        for table in text_batches(batches, 2 << 20):
            yield from table.append_column(name, compute(table.column("text").combine_chunks())).to_batches()

    return rows.mapInArrow(add, f"{schema}, {name} {kind}")


def _lists(found: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)), pa.array(found.reshape(-1)))


def strength(groups: DataFrame, n: str, mean: str, prior: float | Column) -> float:
    """The number of rows that a prior is worth, by moments: how far group means spread beyond chance.

    groups: one row per group with its count n and mean; prior: what the means are expected to be.
    """
    prior = F.lit(prior) if isinstance(prior, float) else prior
    chance = prior * (1 - prior)
    r = groups.agg(
        F.sum(F.col(n) * F.pow(F.col(mean) - prior, 2)).alias("spread"),
        F.sum(chance).alias("noise"),
        F.sum(F.col(n) * chance).alias("scale"),
        F.sum(chance).alias("groups"),
    ).first()
    if not r.scale:
        return 1e6
    rho = (r.spread - r.noise) / max(r.scale - r.noise, 1e-9)
    return float(np.clip((1 - rho) / rho if rho > 1e-6 else 1e6, 1.0, 1e6))


def site_posteriors(known: DataFrame) -> tuple[DataFrame, float]:
    """Posterior means of host and path: (host, path, posterior), and the global mean.

    known: host, path, label. A path's mean is shrunk toward its host's posterior, a host's toward the global mean, each
    by the strength that the spread between groups shows. Partial aggregation keeps hot hosts from one task.
    """
    paths = staged(known.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("label").alias("good")), "quality-paths")
    total = paths.agg(F.sum("good"), F.sum("n")).first()
    mean = float(((total[0] or 0) + 0.5) / ((total[1] or 0) + 1))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    of_hosts = strength(hosts.withColumn("m", F.col("host_good") / F.col("host_n")), "host_n", "m", mean)
    hosts = hosts.withColumn("host_posterior", (F.col("host_good") + of_hosts * mean) / (F.col("host_n") + of_hosts))
    both = paths.join(hosts, "host").select("host", "path", "n", "good", "host_posterior")
    of_paths = strength(both.withColumn("m", F.col("good") / F.col("n")), "n", "m", F.col("host_posterior"))
    by_path = both.select("host", "path", ((F.col("good") + of_paths * F.col("host_posterior")) / (F.col("n") + of_paths)).alias("posterior"))
    by_host = hosts.select("host", F.col("host_posterior"))
    return by_path.unionByName(by_host.select("host", F.lit("\0any").alias("path"), F.col("host_posterior").alias("posterior"))), mean


def quality(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = KEEP, sample: int = SAMPLE,
    score: str = "score", keep: str = "keep", broadcast_sites: int = BROADCAST_SITES,
) -> DataFrame:
    """docs with score (0 to 1: how likely label 1 is) and keep (score >= threshold), under the names given for them.

    docs: doc_id, text and the columns that host and path are made of; all are returned, one row per row, whatever they are
    called; only columns with the names given for score and keep are replaced. A null text is empty. labels: doc_id, label
    (0, 1; nulls are left out; of equal doc_id one counts). The text model is fitted on at most sample of the labelled rows;
    hosts and paths are counted over all of them. An unseen path falls back on its host, an unseen or null host on the
    global mean. Without labels of both kinds the score is the global mean, and 0.5 without any.
    """
    docs = docs.drop(score, keep)
    at_host, at_path, evidence, of_path, of_host = (fresh(x, [*docs.columns, score, keep]) for x in ("host", "path", "evidence", "of_path", "of_host"))
    names = [*docs.columns, score, keep]
    docs = docs.withColumns({at_host: F.coalesce(host, F.lit("")), at_path: F.coalesce(path, F.lit(""))})
    labels = labels.select("doc_id", "label").dropna().groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    known = docs.select("doc_id", F.col(at_host).alias("host"), F.col(at_path).alias("path")).join(labels, "doc_id")
    sites, mean = site_posteriors(known)
    sites = staged(sites, "quality-sites")
    picked = F.broadcast(bounded_sample(labels, "doc_id", sample))
    fit_on = _with(docs.select("doc_id", "text").join(picked, "doc_id").select("text", "label"), "features", "array<double>", lambda t: _lists(expanded(features.surface(t)[0])))
    fit_on = staged(fit_on.select("label", "features"), "quality-sample").select("label", array_to_vector("features").alias("features"))
    n_known, n_good = fit_on.agg(F.count("*"), F.sum("label")).first()
    if n_good and n_good < n_known:
        fitted = LogisticRegression(regParam=0.002, maxIter=100, standardization=True).fit(fit_on)
        weights, base = fitted.coefficients.toArray(), float(fitted.intercept)
    else:
        weights, base = np.zeros(3 * len(features.NAMES)), float(np.log(mean / (1 - mean)))
    rows = _with(docs, evidence, "double", lambda t: pa.array(expanded(features.surface(t)[0]) @ weights + base))
    by_path = sites.select(F.col("host").alias(at_host), F.col("path").alias(at_path), F.col("posterior").alias(of_path))
    by_host = sites.filter(F.col("path") == "\0any").select(F.col("host").alias(at_host), F.col("posterior").alias(of_host))
    if sites.count() <= broadcast_sites:
        rows = rows.join(F.broadcast(by_path), [at_host, at_path], "left").join(F.broadcast(by_host), at_host, "left")
    else:
        # Posteriors are found for the distinct pairs of host and path, so that whole rows are joined once.
        pairs = docs.select(at_host, at_path).distinct().join(by_path, [at_host, at_path], "left")
        pairs = salted(pairs, by_host, [at_host], F.col(at_path), "left")
        rows = salted(rows, pairs, [at_host, at_path], F.struct("doc_id", "text"), "left")
    site = F.coalesce(of_path, of_host, F.lit(mean))
    logit = lambda p: F.log(p / (1 - p))
    margin = F.col(evidence) + logit(site) - logit(F.lit(mean))
    return rows.withColumn(score, 1 / (1 + F.exp(-margin))).withColumn(keep, F.col(score) >= threshold).select(*names)
