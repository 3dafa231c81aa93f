"""Clusters and factor scores: Lloyd's algorithm for all groups at once, and multiple correspondence analysis."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predial.operators.stats import exact_quantiles, subset_quantiles
from predial.operators.store import unwritten, written

MAX_K, ROWS_PER_CLUSTER = 5, 30


def group_kmeans(points: DataFrame, group: str, key: str, x: str = "x", y: str = "y", max_iter: int = 20, k_of: DataFrame | None = None) -> DataFrame:
    """(key, group, cluster) for k-means within each group, all groups in one job per iteration.

    k is one for each ROWS_PER_CLUSTER rows, or the k of k_of (group, k), from 1 to MAX_K. Starts are spread over each group's x order, so results do not
    depend on chance; clusters are numbered by their centre. Only counts of changed centres reach the driver.
    """
    rows = written(points.select(key, group, F.col(x).alias("x"), F.col(y).alias("y")).dropna())
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"), F.percentile("x", F.array(*(F.lit((2 * i + 1) / (2 * MAX_K)) for i in range(MAX_K)))).alias("q"), F.avg("y").alias("my"))
    wanted = F.floor(F.col("n") / ROWS_PER_CLUSTER)
    if k_of is not None:
        sizes, wanted = sizes.join(k_of.select(group, F.col("k").alias("_k")), group), F.col("_k")
    k = F.least(F.lit(MAX_K), F.greatest(F.lit(1), wanted)).cast("int")
    starts = sizes.select(group, "my", "q", k.alias("k")).select(group, "my", "q", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("c"))
    centres = starts.select(group, "c", F.element_at("q", (F.floor((F.col("c") * 2 + 1) * MAX_K / (2 * F.col("k"))) + 1).cast("int")).alias("cx"), F.col("my").alias("cy"))
    centres = written(centres)
    assigned = None
    for _ in range(max_iter):
        near = rows.join(centres.groupBy(group).agg(F.collect_list(F.struct("c", "cx", "cy")).alias("all")), group)
        best = F.array_min(F.transform("all", lambda a: F.struct((F.pow(F.col("x") - a["cx"], 2) + F.pow(F.col("y") - a["cy"], 2)).alias("d"), a["c"].alias("c"))))
        assigned = near.select(key, group, "x", "y", best["c"].alias("c"))
        new = written(assigned.groupBy(group, "c").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")))
        moved = new.join(centres.select(group, "c", F.col("cx").alias("ox"), F.col("cy").alias("oy")), [group, "c"], "left")
        moved = moved.filter((F.abs(F.col("cx") - F.coalesce("ox", F.lit(1e18))) > 1e-9) | (F.abs(F.col("cy") - F.coalesce("oy", F.lit(1e18))) > 1e-9))
        centres = new
        if moved.isEmpty():
            break
    order = centres.withColumn("cluster", F.row_number().over(Window.partitionBy(group).orderBy("cx", "cy", "c")) - 1)
    return assigned.join(order.select(group, "c", "cluster"), [group, "c"]).select(key, group, "cluster")


def correspondence_scores(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, indice, declaradas): the first axis of a multiple correspondence analysis.

    Category co-occurrences are counted in Spark; their matrix, as large as the number of categories squared, is decomposed
    on the driver. Rows with missing answers are placed at the mean of their given categories. The sign makes the index
    grow with the number of yes.
    """
    long = rows.select(key, F.explode(F.array(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(c + "="), F.col(c))) for c in columns))).alias("cat")).filter("cat is not null")
    complete = rows.dropna(subset=columns)
    burt = complete.select(F.array(*(F.concat(F.lit(c + "="), F.col(c)) for c in columns)).alias("cats"))
    pairs = burt.select(F.explode("cats").alias("a"), "cats").select("a", F.explode("cats").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    names, axis, value, _ = _axis([(r.a, r.b, r.n) for r in pairs.collect()])  # categories squared
    scores = rows.sparkSession.createDataFrame([(n, float(a)) for n, a in zip(names, axis, strict=True)], "cat string, v double")
    return long.join(F.broadcast(scores), "cat").groupBy(key).agg((F.avg("v") / float(np.sqrt(max(np.sqrt(max(value, 0)), 1e-12)))).alias("indice"), F.count("*").alias("declaradas"))


def fold_index(train: DataFrame, columns: list[str], fold: str) -> tuple[DataFrame, DataFrame]:
    """(fold, cat, v) and (fold, contributions): the first axis of a correspondence analysis of each fold's complete training
    rows (C5, LM17): coordinates of categories, scaled so that a row's mean of its categories is its index, and each category's
    contribution to the axis. The counts of category pairs are formed for all folds in one job; their matrices, as large as the
    number of categories squared, are decomposed on the driver."""
    cats = F.array(*(F.concat(F.lit(c + "="), F.col(c)) for c in columns))
    whole = train.dropna(subset=columns).select(fold, cats.alias("cats"))
    pairs = whole.select(fold, F.explode("cats").alias("a"), "cats").select(fold, "a", F.explode("cats").alias("b")).groupBy(fold, "a", "b").agg(F.count("*").alias("n")).collect()
    spark, out, shares = train.sparkSession, [], []
    for f in sorted({r[fold] for r in pairs}):
        names, axis, value, mass = _axis([(r.a, r.b, r.n) for r in pairs if r[fold] == f])
        scale = max(float(np.sqrt(max(value, 0))), 1e-12)
        out += [(f, n, float(x) / scale) for n, x in zip(names, axis, strict=True)]
        shares += [(f, n, float(m * x * x / value) if value > 0 else None) for n, x, m in zip(names, axis, mass, strict=True)]
    return spark.createDataFrame(out, f"{fold} int, cat string, v double"), spark.createDataFrame(shares, f"{fold} int, cat string, contribucion double")


def _axis(pairs: list[tuple[str, str, int]]) -> tuple[list[str], np.ndarray, float, np.ndarray]:
    """Names, coordinates on the first axis, its inertia and masses of categories, from counts of their pairs. The sign makes
    coordinates of "=Sí" positive on the whole."""
    names = sorted({a for a, _, _ in pairs})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b, n in pairs:
        m[at[a], at[b]] = n
    mass = np.diag(m) / np.diag(m).sum()
    scaled = m / m.sum() / np.sqrt(np.outer(mass, mass)) - np.sqrt(np.outer(mass, mass))
    values, vectors = np.linalg.eigh(scaled)
    axis = vectors[:, -1] / np.sqrt(mass) * np.sqrt(max(values[-1], 0))
    yes = np.array([n.endswith("=Sí") for n in names])
    if yes.any() and (axis[yes] * mass[yes]).sum() < 0:
        axis = -axis
    return names, axis, float(values[-1]), mass


def with_index(rows: DataFrame, coordinates: DataFrame, columns: list[str], fold: str, name: str) -> DataFrame:
    """rows with the mean coordinate of the categories that they give, 0 for none: missing answers are passive."""
    per = F.map_from_entries(F.collect_list(F.struct("cat", "v")))
    known = coordinates.groupBy(fold).agg(per.alias("_known"))  # one small map a fold
    found = F.filter(F.transform(F.array(*(F.concat(F.lit(c + "="), F.col(c)) for c in columns)), lambda c: F.col("_known")[c]), lambda x: x.isNotNull())
    mean = F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(found)).otherwise(0.0)
    return rows.join(F.broadcast(known), fold, "left").withColumn(name, F.coalesce(mean, F.lit(0.0))).drop("_known")


def stability(points: DataFrame, group: str, key: str, labels: DataFrame, reps: int = 20, share: float = 0.8, least: float = 0.7) -> DataFrame:
    """How well the clusters of each group hold up when points are left out (C2): (group, puntos, subzonas, ari_mediano, ari_p10,
    inestable); groups with one cluster are left out.

    points: key, group, x, y; labels: (key, cluster) of points, those without one don't count. Each replicate clusters the
    points whose hash with its number is under share, with as many clusters as the labels have, then puts *all* points to
    their nearest centre and compares with the labels by the adjusted Rand index. All replicates of all groups are clustered in
    one job per iteration, over blocks of points that tell for each replicate who is in it; points are not repeated.
    """
    rows = written(points.select(group, F.col(key).alias("_point"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(labels.select(F.col(key).alias("_point"), F.col("cluster").cast("string").alias("_label")), "_point").filter("_label is not null"))
    sizes = written(rows.groupBy(group).agg(F.count("*").alias("puntos"), F.count_distinct("_label").alias("k")).filter("k > 1"))
    rows = rows.join(sizes.select(group), group)
    member = lambda rep, point: F.pmod(F.xxhash64(rep, point), F.lit(1000)) < int(1000 * share)
    blocks = _blocks(rows.select(group, "x", "y", "_label", F.array(*(member(F.lit(r), F.col("_point")) for r in range(1, reps + 1))).alias("_in")), group)
    copies = lambda df: df.withColumn("_set", F.explode(F.sequence(F.lit(1), F.lit(reps)))).filter(member(F.col("_set"), F.col("_cell"))).withColumn("_c", F.lit(1))
    known = rows.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    edges = subset_quantiles(known, "x", [group], [(2 * i + 1) / (2 * MAX_K) for i in range(MAX_K)], F.col("_point"), copies=copies)
    centres = written(_starts(edges.join(sizes.select(group, "k"), group), blocks, group, reps))
    for _ in range(20):
        before, centres = centres, written(_moved(blocks, centres, group, reps))
        unwritten(before)
        if centres.filter("moved").isEmpty():
            break
    cells = _labels_met(blocks, centres, group, reps).groupBy("_rep", group, "_label", "_new").agg(F.sum("n").alias("n"))
    per = rand_index_of(written(cells), "_label", "_new", "_rep", group)
    out = per.groupBy(group).agg(F.median("ari").alias("ari_mediano"), F.percentile("ari", F.lit(0.1)).alias("ari_p10"))
    out = out.join(sizes.select(group, "puntos", F.col("k").alias("subzonas")), group)
    unwritten(edges, centres, blocks)
    return out.select(group, "puntos", "subzonas", "ari_mediano", "ari_p10", (F.col("ari_mediano") < least).alias("inestable"))


#: Points of a group that are handled together, and points that a task holds while it forms such blocks.
BLOCK_POINTS, HELD_POINTS = 1 << 12, 1 << 16


def _blocks(rows: DataFrame, group: str) -> DataFrame:
    """Points as blocks of a group: coordinates, labels and the replicates that each is in, a bit for each."""
    kind = rows.schema[group]
    out = T.StructType([kind, *(T.StructField(c, T.BinaryType()) for c in ("x", "y", "member")), T.StructField("label", T.ArrayType(T.StringType()))])

    def flushed(key, parts, keys):
        table = pa.concat_tables(parts).combine_chunks()
        member = table.column("_in").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        x, y = (table.column(c).to_numpy().astype(float) for c in "xy")
        member = member & ~np.isnan(x)[:, None] & ~np.isnan(y)[:, None]
        arrays = [pa.array([key], keys), *(pa.array([v.tobytes()], pa.binary()) for v in (x, y, np.packbits(member.T, axis=1))), pa.array([table.column("_label").to_pylist()], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, [group, "x", "y", "member", "label"])

    def run(batches):
        held: dict = {}
        total, keys = 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = batch.schema.field(group).type
            coded = batch.column(batch.schema.get_field_index(group)).dictionary_encode()
            of = coded.indices.to_numpy(zero_copy_only=False)
            for i, key in enumerate(coded.dictionary.to_pylist()):
                part = table.take(pa.array(np.flatnonzero(of == i)))
                held.setdefault(key, []).append(part)
                total += part.num_rows
                if sum(p.num_rows for p in held[key]) >= BLOCK_POINTS:
                    parts = held.pop(key)
                    total -= sum(p.num_rows for p in parts)
                    yield flushed(key, parts, keys)
            if total > HELD_POINTS:
                yield from (flushed(key, parts, keys) for key, parts in held.items())
                held, total = {}, 0
        yield from (flushed(key, parts, keys) for key, parts in held.items())

    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return written(rows.repartition(tasks).mapInArrow(run, out))


def _unblock(row: dict, reps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y = np.frombuffer(row["x"]), np.frombuffer(row["y"])
    return x, y, np.unpackbits(np.frombuffer(row["member"], np.uint8).reshape(reps, -1), axis=1, count=len(x)).view(bool)


def _starts(edges: DataFrame, blocks: DataFrame, group: str, reps: int) -> DataFrame:
    """(group, m, moved): the first centres of all replicates, spread over each one's x order, at its mean of y. edges: (group,
    _set, q, k)."""
    out = T.StructType([edges.schema[group], T.StructField("m", T.ArrayType(T.DoubleType())), T.StructField("moved", T.BooleanType())])

    def place(key, table):
        m = np.full((reps, MAX_K, 2), np.inf)
        for rep, q, k in zip(*(table.column(c).to_pylist() for c in ("_set", "q", "k")), strict=True):
            k = min(MAX_K, max(1, k))
            m[rep - 1, :k, 0] = [q[(2 * c + 1) * MAX_K // (2 * k)] for c in range(k)]
        return table.select([group]).slice(0, 1).append_column("m", pa.array([m.ravel()], pa.list_(pa.float64()))).append_column("moved", pa.array([True]))

    def met(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in left.schema})
        m, mean = (t.column("m").combine_chunks().flatten().to_numpy().reshape(reps, MAX_K, 2).copy() for t in (left, right))
        m[:, :, 1] = np.where(np.isinf(m[:, :, 0]), np.inf, mean[:, :1, 1])
        return left.select([group]).append_column("m", pa.array([m.ravel()], pa.list_(pa.float64()))).append_column("moved", pa.array([True]))

    spread = edges.groupBy(group).applyInArrow(place, out)
    one = F.array(*(F.lit(0.0 if i % (2 * MAX_K) < 2 else float("inf")) for i in range(reps * MAX_K * 2)))
    whole = _moved(blocks, written(edges.select(group).distinct().withColumn("m", one)), group, reps)
    return written(spread).groupBy(group).cogroup(whole.groupBy(group)).applyInArrow(met, out)


def _moved(blocks: DataFrame, centres: DataFrame, group: str, reps: int) -> DataFrame:
    """(group, m, moved): the means of the points that are nearest to each centre, among the replicate's members. A centre
    without points is infinitely far from then on."""
    kind = blocks.schema[group]
    sums = T.StructType([kind, *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("s", "old"))])
    out = T.StructType([kind, T.StructField("m", T.ArrayType(T.DoubleType())), T.StructField("moved", T.BooleanType())])

    def flushed(held, keys):
        columns = [pa.array(list(held), keys), *(pa.array([v[i].ravel() for v in held.values()], pa.list_(pa.float64())) for i in range(2))]
        return pa.RecordBatch.from_arrays(columns, [group, "s", "old"])

    def part(batches):
        held: dict = {}
        for batch in batches:
            keys = batch.schema.field(group).type
            for row in batch.to_pylist():
                x, y, member = _unblock(row, reps)
                m = np.array(row["m"]).reshape(reps, MAX_K, 2)
                if row[group] not in held:
                    held[row[group]] = np.zeros((reps, MAX_K, 3)), m
                total = held[row[group]][0]
                for r in range(reps):
                    mx, my = x[member[r]], y[member[r]]
                    label = _closest(mx, my, m[r])
                    for j, w in enumerate((None, mx, my)):
                        total[r, :, j] += np.bincount(label, w, MAX_K)
            if len(held) * reps * MAX_K * 5 > 1 << 22:
                yield flushed(held, keys)
                held = {}
        if held:
            yield flushed(held, keys)

    def added(key, table):
        total = table.column("s").combine_chunks().flatten().to_numpy().reshape(-1, reps, MAX_K, 3).sum(axis=0)
        old = table.column("old").combine_chunks()[0].values.to_numpy().reshape(reps, MAX_K, 2)
        some = total[:, :, :1] > 0
        new = np.where(some, total[:, :, 1:] / np.maximum(total[:, :, :1], 1), np.inf)
        with np.errstate(invalid="ignore"):
            moved = bool((some & (np.abs(new - old) > 1e-9)).any())
        return table.select([group]).slice(0, 1).append_column("m", pa.array([new.ravel()], pa.list_(pa.float64()))).append_column("moved", pa.array([moved]))

    return blocks.join(centres.select(group, "m"), group).select(group, "x", "y", "member", "m").mapInArrow(part, sums).groupBy(group).applyInArrow(added, out)


def _closest(x: np.ndarray, y: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None] - centres[:, 0]) ** 2 + (y[:, None] - centres[:, 1]) ** 2).argmin(axis=1)


def _labels_met(blocks: DataFrame, centres: DataFrame, group: str, reps: int) -> DataFrame:
    """(group, _rep, _label, _new, n): how many of *all* points with a label are nearest to each centre, centres numbered by place;
    replicates without members have none."""
    kind = blocks.schema[group]
    names = [group, "_rep", "_label", "_new", "n"]
    out = T.StructType([kind, T.StructField("_rep", T.IntegerType()), T.StructField("_label", T.StringType()), T.StructField("_new", T.IntegerType()), T.StructField("n", T.LongType())])

    def flushed(held, keys):
        rows = [(g, r + 1, label, c, n) for (g, label), m in held.items() for r, c in zip(*np.nonzero(m), strict=True) for n in (m[r, c],)]
        kinds = [keys, pa.int32(), pa.string(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], t) for i, t in enumerate(kinds)], names)

    def run(batches):
        held: dict = {}
        for batch in batches:
            keys = batch.schema.field(group).type
            for row in batch.to_pylist():
                x, y, _ = _unblock(row, reps)
                m = np.array(row["m"]).reshape(reps, MAX_K, 2)
                labels, code = np.unique(np.array(row["label"], object), return_inverse=True)
                for r in range(reps):
                    if np.isinf(m[r, :, 0]).all():
                        continue
                    order = np.lexsort((m[r, :, 1], m[r, :, 0]))
                    counts = np.bincount(code * MAX_K + _closest(x, y, m[r][order]), minlength=len(labels) * MAX_K).reshape(-1, MAX_K)
                    for label, n in zip(labels.tolist(), counts, strict=True):
                        held.setdefault((row[group], label), np.zeros((reps, MAX_K), np.int64))[r] += n
            if len(held) * reps * MAX_K > 1 << 20:
                yield flushed(held, keys)
                held = {}
        if held:
            yield flushed(held, keys)

    return blocks.join(centres.select(group, "m"), group).mapInArrow(run, out)


def rand_index(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """The adjusted Rand index of two labelings by group (C6); 1 where both have one label."""
    return rand_index_of(rows.groupBy(*by, a, b).agg(F.count("*").alias("n")), a, b, *by)


def rand_index_of(cells: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """rand_index() from the numbers n of rows by group and both labels."""
    pairs = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    out = cells.groupBy(*by).agg(F.sum(pairs("n")).alias("s"), F.sum("n").alias("n"))
    for name, label in (("sa", a), ("sb", b)):
        out = out.join(cells.groupBy(*by, label).agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(pairs("m")).alias(name)), list(by))
    expected = F.try_divide(F.col("sa") * F.col("sb"), pairs("n"))
    top = (F.col("sa") + F.col("sb")) / 2 - expected
    return out.select(*by, F.when(top == 0, 1.0).otherwise(F.try_divide(F.col("s") - expected, top)).alias("ari"))


#: Rows that a silhouette is measured on.
SILHOUETTE_ROWS = 5_000


def sampled(rows: DataFrame, key: str, most: int = SILHOUETTE_ROWS) -> DataFrame:
    """The rows that silhouette() takes."""
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def silhouette(rows: DataFrame, columns: list[str], label: str, key: str, most: int = SILHOUETTE_ROWS) -> DataFrame:
    """The mean Euclidean silhouette over at most `most` rows, those with the least hashes (C4): the bounded sample is part of
    the measure. Distances are summed by row and cluster, so no matrix is held."""
    some = written(sampled(rows.select(key, label, *columns), key, most))
    other = some.select(F.col(key).alias("_k"), F.col(label).alias("_l"), *(F.col(c).alias(f"_o_{c}") for c in columns))
    d = F.sqrt(reduce(lambda a, b: a + b, ((F.col(c) - F.col(f"_o_{c}")) * (F.col(c) - F.col(f"_o_{c}")) for c in columns)))
    per = some.crossJoin(F.broadcast(other)).filter(F.col(key) != F.col("_k")).groupBy(key, label, "_l").agg(F.avg(d).alias("d"))
    own = per.groupBy(key).agg(F.min(F.when(F.col(label) == F.col("_l"), F.col("d"))).alias("a"), F.min(F.when(F.col(label) != F.col("_l"), F.col("d"))).alias("b"))
    return own.agg(F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silueta"))


def _hashed(keys: np.ndarray, *numbers: int) -> np.ndarray:
    """Uniform numbers in (0, 1) for each key, other ones for other numbers."""
    seed = np.uint64(0)
    for x in numbers:
        seed = (seed ^ np.uint64(x + 1)) * np.uint64(0x9E3779B97F4A7C15)
    h = keys ^ seed
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the squared distance to it."""
    d = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)
    label = d.argmin(axis=1)
    return label, d[np.arange(len(x)), label]


#: Rows that a task's arrays hold at once, so that they stay in the processor's cache.
HELD_ROWS = 1 << 13


def _sums(x: np.ndarray, centres: list[np.ndarray], k: int) -> list[np.ndarray]:
    """For each of some runs (cluster, 2 + columns): the number of rows nearest to a centre, the sum of all rows' squared distances
    (of all clusters, in the first), and the sums of the rows' columns. Rows are the columns of products of matrices, so that
    nothing is done row by row; of equally near centres the first counts, as in _nearest()."""
    table = np.column_stack([x, np.ones(len(x))])
    columns, squares = np.ascontiguousarray(table.T), float((x * x).sum())
    d = np.vstack([np.column_stack([-2 * c, (c * c).sum(axis=1)]) for c in centres]) @ columns  # squared distances, less the row's own
    ends = np.cumsum([0, *map(len, centres)])
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        best = d[a:b].min(axis=0)
        nearest = d[a:b] == best
        if np.count_nonzero(nearest) > len(x):
            nearest &= np.cumsum(nearest, axis=0) == 1
        sums = np.zeros((k, table.shape[1] + 1))
        found = nearest.astype(float) @ table
        sums[: b - a, 0], sums[: b - a, 2:] = found[:, -1], found[:, :-1]
        sums[0, 1] = max(float(best.sum()) + squares, 0.0)  # the distances of all clusters: only their sum is asked for
        out.append(sums)
    return out


@dataclass
class Runs:
    """k-means of many runs: centres by run, the sum of squared distances of each, and the replicate that a run belongs to."""

    centres: dict[int, np.ndarray]
    inertia: dict[int, float]
    replicate: dict[int, int]

    def best(self) -> dict[int, np.ndarray]:
        """The centres of each replicate's best start."""
        out = {}
        for rep in sorted(set(self.replicate.values())):
            run = min((r for r, q in self.replicate.items() if q == rep), key=lambda r: (self.inertia[r], r))
            out[rep] = self.centres[run]
        return out


def kmeans_runs(rows: DataFrame, key: str, vector: str, k: int, replicates: tuple[int, ...] = (0,), starts: int = 20, share: float = 0.8, max_iter: int = 30, tolerance: float = 1e-4) -> Runs:
    """kmeans_of_sizes() with k clusters only."""
    return kmeans_of_sizes(rows, key, vector, (k,), replicates, starts, share, max_iter, tolerance)[k]


def kmeans_of_sizes(rows: DataFrame, key: str, vector: str, sizes: tuple[int, ...], replicates: tuple[int, ...] = (0,), starts: int = 20, share: float = 0.8, max_iter: int = 30, tolerance: float = 1e-4) -> dict[int, Runs]:
    """k-means with k-means++ starts for every number of clusters, replicate and start at once (C4, C8): one job a round for all
    of them. A start draws its rows one after another, so fewer clusters start at the first of those that more start at.

    Replicate 0 has all rows, others those whose hash with the replicate's number is under share. rows: key, vector (an array
    of numbers without nulls). Only centres, as many as there are runs times k, pass the driver. A run whose centres move by less
    than tolerance (squared, in all) is left out of later rounds; an emptied cluster keeps its centre.
    """
    # Dealt evenly: each round lasts as long as its largest file does.
    parts = 4 * rows.sparkSession.sparkContext.defaultParallelism
    slim = written(rows.select(F.xxhash64(key).alias("h"), F.col(vector).cast("array<double>").alias("z")).repartition(parts))
    first = slim.first()
    if first is None:
        raise ValueError("no rows")
    d = len(first.z)
    runs = {i: rep for i, rep in enumerate(r for r in replicates for _ in range(starts))}
    most_clusters = max(sizes)

    def batches_of(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, HELD_ROWS):
                part = batch.slice(i, HELD_ROWS)
                yield part.column(0).to_numpy().view(np.uint64), part.column(1).flatten().to_numpy().reshape(-1, d)

    def inside(h: np.ndarray, rep: int) -> np.ndarray:
        return np.flatnonzero(_hashed(h, rep) < share) if rep else np.arange(len(h))

    def pick(centres: dict[int, np.ndarray], turn: int) -> dict[int, np.ndarray]:
        """A row for each run, drawn in proportion to its squared distance from the run's centres: the least of exponential
        times, each divided by its weight."""

        def draw(batches):
            best: dict[int, tuple[float, list[float]]] = {}
            for h, x in batches_of(batches):
                members = {rep: inside(h, rep) for rep in set(runs.values())}
                longest = float(np.sqrt((x * x).sum(axis=1).max()))
                for run, rep in runs.items():
                    at, c = members[rep], centres[run]
                    if not len(at):
                        continue
                    u = _hashed(h[at], 1 << 20, run, turn)
                    if run in best:
                        # No weight is over most, so only rows whose exponential time is under the best's share can be earlier.
                        most = (longest + float(np.sqrt((c * c).sum(axis=1).max()))) ** 2 if len(c) else 1.0
                        some = np.flatnonzero(u >= np.exp(-best[run][0] * most * (1 + 1e-9)) * (1 - 1e-9))
                        at, u = at[some], u[some]
                        if not len(at):
                            continue
                    weight = _nearest(x[at], c)[1] if len(c) else np.ones(len(at))
                    with np.errstate(divide="ignore"):
                        time = np.where(weight > 0, -np.log(u) / weight, np.inf)
                    i = int(time.argmin())
                    if run not in best or time[i] < best[run][0]:
                        best[run] = float(time[i]), x[at[i]].tolist()
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([t for t, _ in best.values()]), pa.array([z for _, z in best.values()])], ["run", "t", "z"])

        found = slim.mapInArrow(draw, "run int, t double, z array<double>").groupBy("run").agg(F.min_by("z", F.struct("t", "z")).alias("z")).collect()
        return {r.run: np.vstack([centres[r.run], r.z]) for r in found}

    centres = {run: np.zeros((0, d)) for run in runs}
    for turn in range(most_clusters):
        centres = centres | pick(centres, turn)
    centres = {(k, run): c[:k] for k in sizes for run, c in centres.items()}
    names = list(centres)
    inertia, moving = {}, set(centres)
    for _ in range(max_iter):

        def step(batches, now={name: centres[name] for name in names if name in moving}):
            by_replicate: dict[int, list[tuple[int, int]]] = {}
            for name in now:
                by_replicate.setdefault(runs[name[1]], []).append(name)
            total = {name: np.zeros((most_clusters, d + 2)) for name in now}
            for h, x in batches_of(batches):
                for rep, of in by_replicate.items():
                    mine = x[inside(h, rep)] if rep else x
                    if len(mine):
                        for name, sums in zip(of, _sums(mine, [now[n] for n in of], most_clusters), strict=True):
                            total[name] += sums
            yield pa.RecordBatch.from_arrays([pa.array([names.index(n) for n in total], pa.int32()), pa.array([t.ravel() for t in total.values()], pa.list_(pa.float64()))], ["run", "m"])

        added = F.array(*(F.sum(F.col("m")[i]) for i in range(most_clusters * (d + 2))))
        for r in slim.mapInArrow(step, "run int, m array<double>").groupBy("run").agg(added.alias("m")).collect():
            name = names[r.run]
            m, old = np.array(r.m).reshape(most_clusters, d + 2), centres[name]
            m = m[: len(old)]
            new = np.where(m[:, :1] > 0, m[:, 2:] / np.maximum(m[:, :1], 1), old)
            inertia[name] = float(m[:, 1].sum())
            if ((new - old) ** 2).sum() <= tolerance:
                moving.discard(name)
            centres[name] = new
        if not moving:
            break
    unwritten(slim)
    return {k: Runs({r: centres[k, r] for r in runs}, {r: inertia[k, r] for r in runs}, runs) for k in sizes}


def labelled(rows: DataFrame, vector: str, centres: np.ndarray, name: str = "cluster") -> DataFrame:
    """rows with the number of the nearest centre."""
    d = lambda c: reduce(lambda a, b: a + b, ((F.col(vector)[j] - float(v)) * (F.col(vector)[j] - float(v)) for j, v in enumerate(c)))
    return rows.withColumn(name, F.array_min(F.array(*(F.struct(d(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres))))["i"])


def segment_agreement(rows: DataFrame, vector: str, runs: Runs, k: int) -> list[tuple[int, float, list[float]]]:
    """For each replicate but 0: the adjusted Rand index of its segments of *all* rows against replicate 0's, and the segments'
    sizes in percent under the renaming that agrees most (C7, C8). Counts of label pairs are formed in one job."""
    best = runs.best()
    base = best.pop(0)

    def count(batches):
        tables = {rep: np.zeros((k, k), np.int64) for rep in best}
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                own = _nearest(x, base)[0]
                for rep, c in best.items():
                    tables[rep] += np.bincount(own * k + _nearest(x, c)[0], minlength=k * k).reshape(k, k)
        yield pa.RecordBatch.from_arrays([pa.array(list(tables), pa.int32()), pa.array([t.ravel() for t in tables.values()], pa.list_(pa.int64()))], ["rep", "n"])

    summed = F.array(*(F.sum(F.col("n")[i]) for i in range(k * k)))
    found = rows.select(F.col(vector).cast("array<double>").alias("z")).mapInArrow(count, "rep int, n array<long>").groupBy("rep").agg(summed.alias("n")).collect()
    out = []
    for r in sorted(found, key=lambda r: r.rep):
        table = np.array(r.n, float).reshape(k, k)
        pairs = lambda m: (m * (m - 1) / 2).sum()
        expected = pairs(table.sum(axis=0)) * pairs(table.sum(axis=1)) / pairs(table.sum())
        top = (pairs(table.sum(axis=0)) + pairs(table.sum(axis=1))) / 2 - expected
        order = max(permutations(range(k)), key=lambda p: sum(table[i, j] for i, j in enumerate(p)))
        out.append((r.rep, 1.0 if top == 0 else float((pairs(table) - expected) / top), [float(100 * table[:, j].sum() / table.sum()) for j in order]))
    return out


def imputed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with nulls replaced by the median of the column, and <column>_falta."""
    out = rows
    for c in columns:  # each column's median from the rows as they came
        middle = exact_quantiles(rows, c, [0.5]).select(F.col("q")[0].alias("_m"))
        out = out.crossJoin(F.broadcast(middle)).withColumns({f"{c}_falta": F.col(c).isNull(), c: F.coalesce(F.col(c), F.col("_m"))}).drop("_m")
    return out


def named_segments(centres: DataFrame, label: str, rooms: str, equipment: str, strict: bool = True) -> DataFrame:
    """(label, segmento): four clusters by what stands out of their centres (C9): the one with most rooms, with most equipment
    and with fewest rooms, each chosen among all four, and the rest. Raises if they are not four, or if one would get two
    names: then the rule does not tell them apart. Not strict: such a cluster and those left over have no name (null)."""
    found = centres.select(label, rooms, equipment).collect()  # four rows
    if len(found) != 4:
        raise ValueError("four clusters are needed")
    names: dict[int, list[str]] = {r[label]: [] for r in found}
    for name, pick in (("familiares", lambda r: -r[rooms]), ("equipados", lambda r: -r[equipment]), ("chicos", lambda r: r[rooms])):
        names[min(found, key=lambda r: (pick(r), r[label]))[label]].append(name)
    twice = {k: n for k, n in names.items() if len(n) > 1}
    if twice and strict:
        raise ValueError(f"one cluster would be all of {next(iter(twice.values()))}: the naming rule is ambiguous")
    rest = None if twice else "intermedios"
    rows = [(k, n[0] if len(n) == 1 else None if n else rest) for k, n in names.items()]
    return centres.sparkSession.createDataFrame(rows, f"{label} int, segmento string")
