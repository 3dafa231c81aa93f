"""Near-duplicate documents by consistent weighted sampling of TF-IDF word shingles, verified by weighted Jaccard similarity.

Texts with equal sets of shingles are copies: one of them stands for all, also in document counts, so these don't depend on
how often a text is copied. The others are dealt into shards, which learn their shingles' document counts from the tasks
that own them by hash. A shingle in one document only can't be shared, so a document keeps just its shared shingles and the
total weight of the others; one whose shared weight is under the threshold has no partner. The rest are sampled, banded,
compared with the least member of each band and then, where a band's members are not connected yet, with one another; all
links are verified exactly, and classes are the connected components of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from predial.llm.common import (
    NOT_ALNUM, SHINGLE_WORDS, WORD_PATTERN, Words, discard, fresh, mix64, pack, partitions_for, runs, salted, shingles, sorted_groups, staged,
    text_batches, text_bytes, unpack, whole_ids,
)

THRESHOLD = 0.8
#: A shingle weighs 1 if all documents have it and 1 + IDF_SHARE if one has: so much rarity counts. With weights in
#: proportion to rarity, a few own words would part near copies of a text that has many near copies.
IDF_SHARE = 0.25
SAMPLES = 64
#: Samples in a band; bands of several sizes put a document in coarse and fine company. Who shares a finer band also shares a
#: coarse one.
BAND_ROWS = (4, 8, 16)
COARSE = SAMPLES // BAND_ROWS[0]
SHARD_BYTES = 6 << 20
#: Text for each task that owns shingles.
OWNER_BYTES = 20 << 20
#: Rounds with leaders; they only save work.
ROUNDS = 2
#: Estimated similarities this far below the threshold are not verified. A pair at 0.8 agrees in fewer than 34 of 64 samples
#: with probability 3.2e-7.
SLACK = 0.27
#: Members of a band, and bytes of their sets, that are compared with one another in one task; a larger band is split into
#: blocks of so many.
CELL, CELL_BYTES = 2048, 4 << 20
#: Members of bands in a task that compares them, bytes of sets in one, and pairs whose samples are held at once.
CELL_ROWS, TASK_BYTES, PAIRS = 20_000, 24 << 20, 1 << 15
_SCHEMA = "part int, data binary"
_ROW = pa.schema([("part", pa.int32()), ("data", pa.binary())])
_SET_SCHEMA = "node long, doc long, weight double, data binary, samples binary"
_LAST = 2**63 - 1
_draw = np.random.default_rng(8)
_R = -np.log(_draw.random(1 << 16) * _draw.random(1 << 16) + 1e-300)
_LOG_C = np.log(-np.log(_draw.random(1 << 16) * _draw.random(1 << 16) + 1e-300))
_BETA = _draw.random(1 << 16)
_SALTS = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64))


def node(doc_id: Column, text: Column) -> Column:
    """What stands for a row: rows with equal doc_id and text are one node."""
    return F.xxhash64(doc_id, F.xxhash64(F.coalesce(text, F.lit(""))))


def idf(n_docs: int, df: np.ndarray) -> np.ndarray:
    """1 for a shingle of all documents, 1 + IDF_SHARE for one of a single document."""
    return 1 + IDF_SHARE * np.log(n_docs / np.maximum(df, 1)) / max(np.log(n_docs), 1e-9)


def _owner(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Shard:
    """Distinct shingles (64 bits) of each row with their counts, and those of the shard."""

    def __init__(self, rows: pa.Table):
        found, bounds = shingles(Words(pc.utf8_lower(pc.fill_null(rows.column("text").combine_chunks(), "")), NOT_ALNUM), SHINGLE_WORDS)
        doc = np.repeat(np.arange(rows.num_rows), np.diff(bounds))
        order = np.lexsort((found, doc))
        key, doc = found[order], doc[order]
        at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))) if len(key) else np.zeros(0, np.int64)
        self.key, self.doc, self.tf = key[at], doc[at], np.diff(np.append(at, len(key)))
        self.keys, self.place, self.counts = np.unique(self.key, return_inverse=True, return_counts=True)


def _runs(owner: np.ndarray):
    return ((int(owner[i]), i, j) for i, j in runs(owner))


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def _digests(batches):
    """A digest of each row's shingles and their counts; rows without shingles are left out."""
    for rows in text_batches(batches, 2 << 20):
        shard = Shard(rows)
        bounds = np.searchsorted(shard.doc, np.arange(rows.num_rows + 1))
        picked = np.flatnonzero(np.diff(bounds))
        tf = shard.tf.astype(np.int64)
        same = [xxhash.xxh3_128_hexdigest(shard.key[i:j].tobytes() + tf[i:j].tobytes()) for i, j in zip(bounds[picked], bounds[picked + 1], strict=True)]
        nodes, docs = (rows.column(c).to_numpy()[picked] for c in ("node", "doc"))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(docs, pa.int64()), pa.array(same, pa.string())], ["node", "doc", "same"])


def _firsts(nodes: np.ndarray, rows: pa.Table) -> pa.Table:
    """The rows that stand for their copies, each once."""
    found = rows.column("node").to_numpy()
    keep = np.zeros(len(found), bool)
    keep[np.unique(found, return_index=True)[1]] = True
    return rows.filter(pa.array(keep & np.isin(found, nodes)))


def _ask(me: int, rows: pa.Table, parts: int) -> pa.Table:
    shard = Shard(rows)
    owned, data = [], []
    for part, i, j in _runs(_owner(shard.keys, parts)):
        owned.append(part)
        data.append(pack(np.array([me]), np.diff(shard.keys[i:j], prepend=np.uint64(0)), _small(shard.counts[i:j])))
    return pa.Table.from_arrays([pa.array(owned, pa.int32()), pa.array(data, pa.binary())], schema=_ROW)


def _total(batches):
    asked = []
    for batch in batches:
        for data in batch.column("data"):
            me, steps, n = unpack(data.as_py())
            asked.append((int(me[0]), np.cumsum(steps), n))
    if not asked:
        return
    keys = np.concatenate([x[1] for x in asked])
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    at = sorted_groups(ordered)
    total = np.add.reduceat(np.concatenate([x[2].astype(np.int64) for x in asked])[order], at)
    of = np.empty(len(keys), np.int64)
    of[order] = np.repeat(total, np.diff(np.append(at, len(keys))))
    ends = np.cumsum([len(x[1]) for x in asked])
    for (me, x, _), end in zip(asked, ends.tolist(), strict=True):
        data = pack(ordered[:1], _small(of[end - len(x) : end]))
        yield pa.RecordBatch.from_arrays([pa.array([me], pa.int32()), pa.array([data], pa.binary())], schema=_ROW)


def sample(key: np.ndarray, log_weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Consistent weighted samples, one row of 32-bit values for each set: sets are runs of elements beginning at `at`."""
    out = np.empty((len(at), SAMPLES), np.uint32)
    size = np.diff(np.append(at, len(key)))
    for k, salt in enumerate(_SALTS):
        pick = (mix64(key ^ salt) >> np.uint64(48)).astype(np.int64)
        r, beta = _R[pick], _BETA[pick]
        t = np.floor(log_weight / r + beta)
        value = _LOG_C[pick] - r * (t - beta + 1)
        least = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, at), size))
        best = least[np.searchsorted(least, at)]  # the first of equal ones
        out[:, k] = mix64(key[best] * np.uint64(0x100000001B3) + t[best].astype(np.int64).view(np.uint64) + np.uint64(k)) >> np.uint64(32)
    return out


def _sets(answers: pa.Table, rows: pa.Table, n_docs: int, threshold: float) -> pa.Table:
    """The rows that may have a partner, as sets of shared shingles with weights, and samples of them.

    answers holds totals (data), and the rows that stand for their copies (node)."""
    rows = _firsts(answers.column("node").drop_null().to_numpy(), rows)
    answers = answers.filter(answers.column("data").is_valid())
    shard = Shard(rows)
    got = sorted(((int(a[0]), n) for a, n in map(unpack, answers.column("data").to_pylist())), key=lambda x: x[0])
    df = np.concatenate([n.astype(np.int64) for _, n in got])[shard.place] if got else np.zeros(0, np.int64)
    weight = shard.tf * idf(n_docs, df)
    shared = df > 1
    n = rows.num_rows
    whole = np.bincount(shard.doc, weights=weight, minlength=n)
    common = np.bincount(shard.doc[shared], weights=weight[shared], minlength=n)
    good = (whole > 0) & (common >= threshold * whole * (1 - 1e-9))
    use = shared & good[shard.doc]
    key, doc, tf, df, weight = (x[use] for x in (shard.key, shard.doc, shard.tf, df, weight))
    picked = np.flatnonzero(good)
    bounds = np.searchsorted(doc, np.append(picked, n))
    nodes, docs = (rows.column(c).to_numpy() for c in ("node", "doc"))
    rest = np.maximum(whole - common, 0)[picked]
    rest[rest < 1e-9 * whole[picked]] = 0
    data = []
    for i in range(len(picked)):
        s = slice(bounds[i], bounds[i + 1])
        data.append(pack(np.diff(key[s], prepend=np.uint64(0)), _small(tf[s]), _small(df[s])))
    if len(picked):
        # What a row shares with none is one element that only it has.
        own = mix64(nodes[picked].view(np.uint64) + np.uint64(SAMPLES))
        where = bounds[1:]
        all_keys = np.insert(key, where, own)
        logs = np.insert(np.log(weight), where, np.log(np.where(rest > 0, rest, 1e-300)))
        drawn = sample(all_keys, logs, bounds[:-1] + np.arange(len(picked)))
        samples = [x.tobytes() for x in drawn]
    else:
        samples = []
    return pa.Table.from_arrays(
        [pa.array(nodes[picked], pa.int64()), pa.array(docs[picked], pa.int64()), pa.array(whole[picked], pa.float64()), pa.array(data, pa.binary()), pa.array(samples, pa.binary())],
        ["node", "doc", "weight", "data", "samples"],
    )


def _bands(batches):
    """The bands of each set: coarse ones first, by nth; size is that of the set."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        drawn = np.frombuffer(b"".join(batch.column("samples").to_pylist()), np.uint32).reshape(n, SAMPLES).astype(np.uint64)
        keys = []
        for rows in BAND_ROWS:
            for at in range(0, SAMPLES, rows):
                value = np.full(n, at * 1000 + rows, np.uint64)
                for i in range(at, at + rows):
                    value = mix64(value * np.uint64(0x100000001B3) + drawn[:, i])
                keys.append(value.view(np.int64))
        m = len(keys)
        held = [np.repeat(batch.column(c).to_numpy(), m) for c in ("node", "doc", "size")]
        yield pa.RecordBatch.from_arrays([pa.array(np.stack(keys, 1).ravel()), pa.array(np.tile(np.arange(m, dtype=np.int32), n)), *map(pa.array, held)], ["band", "nth", "node", "doc", "size"])


def _estimates(batches):
    """How many samples of each pair agree, as a share."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SAMPLES) for c in ("samples", "other_samples"))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("other"), pa.array((a == b).mean(axis=1))], ["node", "other", "estimate"])


class Cell:
    """Members of one cell, in the order of their roots."""

    def __init__(self, table: pa.Table):
        nth, root, block, nodes = (table.column(c).to_numpy() for c in ("nth", "root", "block", "node"))
        order = np.lexsort((nodes, root))
        self.order, self.nth, self.root, self.block, self.node = order, int(nth[0]), root[order], block[order], nodes[order]
        drawn = table.column("samples").combine_chunks() if isinstance(table.column("samples"), pa.ChunkedArray) else table.column("samples")
        self.drawn = np.frombuffer(b"".join(drawn.to_pylist()), np.uint32).reshape(-1, SAMPLES)[order]

    def pairs(self, least: float):
        """Pairs (i, j) of different roots (in a cell of two blocks, of different blocks) with samples that agree to at least
        `least`, of those that meet in no coarse band before this one."""
        n = len(self.root)
        ends = np.append(np.flatnonzero(self.root[1:] != self.root[:-1]) + 1, n)
        first = ends[np.searchsorted(ends, np.arange(n), "right")]  # a member meets those of later roots
        count = n - first
        total, i, rows = np.cumsum(count), 0, BAND_ROWS[0]
        while i < n:
            j = max(int(np.searchsorted(total, total[i] - count[i] + PAIRS, "right")), i + 1)
            of = np.repeat(np.arange(i, j), count[i:j])
            to = np.arange(len(of)) - np.repeat(np.cumsum(count[i:j]) - count[i:j], count[i:j]) + first[of]
            met = (self.block[of] < 0) | (self.block[of] != self.block[to])
            of, to = of[met], to[met]
            same = self.drawn[of] == self.drawn[to]
            close = same.mean(axis=1) >= least
            of, to, same = of[close], to[close], same[close]
            before = same[:, : self.nth * rows].reshape(len(of), self.nth, rows).all(axis=2).any(axis=1)
            yield of[~before], to[~before]
            i = j


def _cells(batches):
    """The rows of each cell as a table; batches are sorted by cell."""
    held = []
    for batch in batches:
        for i, j in runs(batch.column("cell").to_numpy()):
            part = batch.slice(i, j - i)
            if held and held[-1].column("cell")[0] != part.column("cell")[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


_MEMBER = ["cell", "nth", "root", "block", "node", "size"]


def _needed(batches, least: float):
    """Members of cells that have a candidate."""
    for table in _cells(batches):
        cell = Cell(table)
        hit = np.zeros(len(cell.root), bool)
        for i, j in cell.pairs(least):
            hit[i] = hit[j] = True
        if hit.any():
            yield from table.select(_MEMBER).take(pa.array(cell.order[hit])).to_batches()


class Sets:
    """Sets of shingles of a cell's members, over one common numbering of shingles."""

    def __init__(self, table: pa.Table, order: np.ndarray, n_docs: int):
        data = table.column("data").to_pylist()
        got = [unpack(data[i]) for i in order.tolist()]
        self.whole = table.column("weight").to_numpy()[order]
        self.size = np.array([len(x[0]) for x in got], np.int64)
        self.ends = np.cumsum(self.size)
        keys = np.concatenate([np.cumsum(x[0]) for x in got])
        self.tf = np.concatenate([x[1].astype(np.int64) for x in got])
        _, first, self.place = np.unique(keys, return_index=True, return_inverse=True)
        self.weight = idf(n_docs, np.concatenate([x[2].astype(np.int64) for x in got])[first])
        self.mine = np.zeros(len(first), np.int64)

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarities of member i to others."""
        s = slice(self.ends[i] - self.size[i], self.ends[i])
        self.mine[self.place[s]] = self.tf[s]
        both = np.zeros(len(others))
        bound = np.cumsum(self.size[others]) >> 22  # some 4 million shingles at a time
        for a, b in runs(bound):
            o = others[a:b]
            n = self.size[o]
            at = np.cumsum(n) - n
            pick = np.repeat(self.ends[o] - n - at, n) + np.arange(at[-1] + n[-1])
            place = self.place[pick]
            both[a:b] = np.add.reduceat(np.minimum(self.tf[pick], self.mine[place]) * self.weight[place], at)
        self.mine[self.place[s]] = 0
        return both / np.maximum(self.whole[i] + self.whole[others] - both, 1e-300)


def _linked(batches, least: float, n_docs: int, threshold: float):
    """Links (a, b) that connect members of a cell: of all its pairs at threshold or above, those that join what others of
    them have not joined yet."""
    for table in _cells(batches):
        cell = Cell(table)
        up = {x: x for x in cell.root.tolist()}
        sets = Sets(table, cell.order, n_docs)

        def top(x: int, up=up) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        a, b = [], []
        for of, to in cell.pairs(least):
            for x, y in runs(of):
                i, mine = int(of[x]), int(cell.root[of[x]])
                others = to[x:y]
                if up[mine] != mine or len(up) > 1:
                    here = top(mine)
                    others = others[np.array([top(r) != here for r in cell.root[others].tolist()], bool)]
                if not len(others):
                    continue
                for j in others[sets.similar(i, others) >= threshold].tolist():
                    p, q = top(mine), top(int(cell.root[j]))
                    if p != q:
                        up[max(p, q)] = min(p, q)
                        a.append(int(cell.node[i]))
                        b.append(int(cell.node[j]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _unmet(bands: DataFrame, roots: DataFrame | None, own: DataFrame, n_docs: int, threshold: float, least: float) -> DataFrame:
    """Links (a, b) among all pairs of a common coarse band and different roots whose samples agree to at least `least`.

    A large band is split into blocks, with a cell for each two of them; a pair is looked at in the first band that it shares.
    Pairs don't leave their task: at first only the members that have a candidate do, then the links that connect some.
    """
    members = bands.filter(F.col("nth") < COARSE).select("band", "nth", "node", "size")
    if roots is not None:
        members = members.join(roots, "node", "left").select("band", "nth", "node", "size", F.coalesce("root", "node").alias("root"))
    else:
        members = members.withColumn("root", F.col("node"))
    # A band whose members are connected already has nothing to say.
    mixed = members.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b")
    blocks = F.greatest(F.ceil(F.col("n") / CELL), F.ceil(F.col("bytes") / CELL_BYTES)).cast("int")
    members = staged(members.join(mixed.select("band", blocks.alias("blocks")), "band"), "near-mixed")
    # A band in g blocks has a cell for every two blocks, and one for each block by itself.
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = members.withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("band", F.least("mine", "with"), F.greatest("mine", "with"))
    # Within its own cell (block -1) a block's members meet one another, in the others only those of the other block.
    block = F.when(F.col("mine") == F.col("with"), -1).otherwise(F.col("mine")).alias("block")
    cells = cells.select(cell.alias("cell"), "nth", "root", block, "node", "size")
    least_parts = int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = members.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    dealt = cells.join(own.select("node", "samples"), "node").repartition(max(least_parts, -(-n // CELL_ROWS)), "cell").sortWithinPartitions("cell")
    needed = staged(dealt.mapInArrow(lambda b: _needed(b, least), cells.select(_MEMBER).schema), "near-needed")
    n = needed.agg(F.coalesce(F.sum(F.col("size") + 8 * SAMPLES), F.lit(0))).first()[0]
    dealt = needed.join(own.select("node", "samples", "weight", "data"), "node").repartition(max(least_parts, -(-n // TASK_BYTES)), "cell").sortWithinPartitions("cell")
    links = staged(dealt.mapInArrow(lambda b: _linked(b, least, n_docs, threshold), "a long, b long"), "near-links")
    discard(members, needed)
    return links


def weighted_jaccard(a: bytes, b: bytes, weight_a: float, weight_b: float, n_docs: int) -> float:
    (ka, ta, da), (kb, tb, _) = unpack(a), unpack(b)
    _, i, j = np.intersect1d(np.cumsum(ka), np.cumsum(kb), assume_unique=True, return_indices=True)
    both = float((np.minimum(ta[i].astype(np.int64), tb[j].astype(np.int64)) * idf(n_docs, da[i].astype(np.int64))).sum())
    return both / max(weight_a + weight_b - both, 1e-300)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: long): root is the least node of its connected component.

    Each level points every node at its least neighbour, and at what that one points at; edges between different roots
    make the next, smaller level. Nothing but whether a level has edges reaches the driver.
    """
    levels, left = [], edges.select("a", "b").distinct()
    while True:
        left = before = staged(left, "edges")
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root"))
        near = staged(near, "nearest")
        above = near.select(F.col("node").alias("root"), F.col("root").alias("up"))
        levels.append(staged(near.join(above, "root").select("node", F.col("up").alias("root")), "level"))
        a, b = (levels[-1].select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        left = left.join(a, "a").join(b, "b").filter("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        done = left.isEmpty()
        if done:
            discard(before, near)
            break
        discard(near)
    out = levels[0]
    for level in levels[1:]:
        out = out.join(level.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left")
        out = out.select("node", F.coalesce("up", "root").alias("root"))
    out = staged(out, "near-roots")
    discard(*levels)
    return out


def classes(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those of rows that have near-duplicates: (node, doc, root), root naming the class by a number.

    rows: node (a hash that stands for the row; rows of one node are equal), doc (smaller ones stand for others), text. Copies
    (equal sets of shingles) stand for one another. Of the others, every row is compared with the least member of each of
    its bands; what a band's leader does not draw into its component gets a leader of its own in the next of ROUNDS rounds.
    These rounds only save work: afterwards all pairs of a band that are not connected yet are compared. A link can only be
    missing between rows that share no coarse band, or by SLACK, and are not connected through others either.
    """
    spark = rows.sparkSession
    n_bytes = text_bytes(rows)
    parts, shards = partitions_for(spark, n_bytes, OWNER_BYTES), partitions_for(spark, n_bytes, SHARD_BYTES)
    named = staged(rows.mapInArrow(_digests, "node long, doc long, same string"), "near-digests")
    # Of copies, the one with the least doc is counted and compared.
    least = named.groupBy("same").agg(F.min(F.struct("doc", "node")).alias("least"), F.count("*").alias("copies"))
    least = staged(least.select("same", F.col("least.node").alias("least"), "copies"), "near-copies")
    n_docs = least.count()
    part = F.pmod("node", F.lit(shards)).cast("int")
    firsts = least.select(F.col("least").alias("node")).withColumn("part", part)
    dealt = rows.withColumn("part", part).groupBy("part")
    asked = firsts.groupBy("part").cogroup(dealt).applyInArrow(lambda key, a, b: _ask(key[0].as_py(), _firsts(a.column("node").to_numpy(), b), parts), _SCHEMA)
    answers = asked.repartitionById(parts, "part").mapInArrow(_total, _SCHEMA)
    answers = answers.unionByName(firsts, allowMissingColumns=True).groupBy("part")
    own = staged(answers.cogroup(dealt).applyInArrow(lambda a, b: _sets(a, b, n_docs, threshold), _SET_SCHEMA), "near-sets")
    own = own.withColumn("size", F.octet_length("data").cast("long"))
    bands = own.select("node", "doc", "size", "samples").mapInArrow(_bands, "band long, nth int, node long, doc long, size long")
    # A band with one member leads nowhere.
    several = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    bands = staged(bands.join(several, "band", "left_semi").withColumn("root", F.col("node")), "near-bands")
    left, joined, tried, roots = bands, None, None, None
    for _ in range(ROUNDS):
        leaders = left.groupBy("band").agg(F.min(F.struct("doc", "node", "root")).alias("lead")).select("band", F.col("lead.node").alias("other"), F.col("lead.root").alias("led"))
        met = left.join(leaders, "band")
        pairs = met.filter("root != led").select("node", "other").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["node", "other"], "left_anti")
        sampled = own.select("node", "samples")
        close = pairs.join(sampled, "node").join(sampled.select(F.col("node").alias("other"), F.col("samples").alias("other_samples")), "other")
        close = close.mapInArrow(_estimates, "node long, other long, estimate double").filter(F.col("estimate") >= threshold - SLACK)
        close = staged(close.select("node", "other"), "near-pairs")
        found = staged(_verified(close, own, n_docs, threshold), "near-links")
        tried = close if tried is None else tried.unionByName(close)
        if not found.isEmpty():
            joined = found if joined is None else joined.unionByName(found)
            before, roots = roots, components(joined)
            discard(before)
        # A band's members that are not with its leader now go on.
        if roots is not None:
            of = lambda name, to: roots.select(F.col("node").alias(name), F.col("root").alias(to))  # noqa: E731, B023
            met = met.drop("root", "led").join(of("node", "_r"), "node", "left").join(of("other", "_l"), "other", "left")
            met = met.select("band", "node", "doc", "other", F.coalesce("_r", "node").alias("root"), F.coalesce("_l", "other").alias("led"))
        left = staged(met.filter("root != led").select("band", "node", "doc", "root"), "near-left")
        if left.isEmpty():
            break
    found = _unmet(bands, roots, own, n_docs, threshold, threshold - SLACK)
    if not found.isEmpty():
        joined = found if joined is None else joined.unionByName(found)
        before, roots = roots, components(joined)
        discard(before)
    if roots is None:
        of_copies = least.filter("copies > 1").select("same", F.col("least").alias("root"))
    else:
        of_copies = least.join(roots.withColumnRenamed("node", "least"), "least", "left").filter("copies > 1 or root is not null")
        of_copies = of_copies.select("same", F.coalesce("root", "least").alias("root"))
    return salted(named, of_copies, ["same"], F.col("node")).select("node", "doc", "root")


def _verified(pairs: DataFrame, sets: DataFrame, n_docs: int, threshold: float) -> DataFrame:
    """Those of pairs (node, other) whose weighted Jaccard similarity reaches threshold, as a, b."""
    mine = sets.select("node", "weight", "data")
    other = sets.select(F.col("node").alias("other"), F.col("weight").alias("other_weight"), F.col("data").alias("other_data"))

    def verify(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("data", "other_data", "weight", "other_weight"))
            good = np.array([weighted_jaccard(*x, n_docs) >= threshold for x in zip(*columns, strict=True)], bool)
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept.column("node"), kept.column("other")], ["a", "b"])

    return pairs.join(mine, "node").join(other, "other").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The near-duplicate class of each row.

    docs: doc_id (an integer type, others raise), text; other columns are ignored. Texts are compared by their five-word
    shingles, weighted by count and by rarity (see idf()), where texts with equal shingles count as one document; a class is
    all that is connected by similarities of at least threshold. Texts with fewer words have one shingle; texts without
    words (null and empty ones) are alone. Rows with equal or null doc_id stay rows of their own. Returns doc_id, class_id
    (the least doc_id of the class, its own for a single row, null if none has one), class_size (rows), one row per row.
    """
    kind = whole_ids(docs).schema["doc_id"].dataType
    rows = docs.select(node(F.col("doc_id"), F.col("text")).alias("node"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    found = staged(classes(rows, threshold), "near-classes")
    names = staged(found.groupBy("root").agg(F.min("doc").alias("class_id"), F.count("*").alias("class_size")), "near-names")
    named = salted(found.select("node", "root").distinct(), names, ["root"], F.col("node")).select("node", "class_id", "class_size")
    out = docs.select("doc_id", node(F.col("doc_id"), F.col("text")).alias("node")).join(named, "node", "left")
    class_id = F.when(F.col("class_id") != _LAST, F.col("class_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", class_id.cast(kind).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def row_hash(docs: DataFrame, seed: int) -> Column:
    """A 64-bit hash over all columns; entries of a map are taken in the order of their keys."""
    entries = lambda f: F.array_sort(F.map_entries(F.col(f"`{f.name}`"))) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`")
    return F.xxhash64(F.lit(seed), *map(entries, docs.schema))


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with one row of each class: the one with the least doc_id, of equal ones that with the least hash
    over all columns; rows that are equal in all columns, the entries of maps included, count once. Rows whose text has no words
    all stay. A row is told apart by two hashes of 64 bits; rows that agree in the first and not in the second all stay, so that
    no stranger is lost to a collision."""
    whole_ids(docs)
    key, second = fresh("node", docs.columns), fresh("second", docs.columns)
    # Rows of one text and id differ in the hash of their other columns.
    rows = docs.filter(F.coalesce("text", F.lit("")).rlike(WORD_PATTERN)).withColumns({key: row_hash(docs, 0), second: row_hash(docs, 1)})
    found = staged(classes(rows.select(F.col(key).alias("node"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), "text"), threshold), "near-classes")
    first = staged(found.groupBy("root").agg(F.min(F.struct("doc", "node")).alias("first")).select("root", F.col("first.node").alias("first")), "near-firsts")
    others = salted(found.distinct(), first, ["root"], F.col("node")).filter(F.col("node") != F.col("first")).select(F.col("node").alias(key))
    strangers = rows.groupBy(key).agg(F.min(second).alias("a"), F.max(second).alias("b")).filter("a != b").select(key)
    kept = rows.join(others.join(strangers, key, "left_anti"), key, "left_anti").dropDuplicates([key, second]).drop(key, second)
    return kept.unionByName(docs.filter(~F.coalesce("text", F.lit("")).rlike(WORD_PATTERN)))
