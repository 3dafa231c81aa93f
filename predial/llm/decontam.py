"""Benchmark decontamination: short items are found inside long documents by MinHash over size partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from predial.llm.common import NOT_ALNUM, SHINGLE_WORDS, Words, discard, mix64, shingles, staged, text_batches

THRESHOLD = 0.8
HASHES = 48
#: Items are searched for in blocks of at most so many bytes of text, each broadcast to the executors and dropped in turn.
BLOCK_BYTES = 8 << 20
_SEEDS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def size_class(n: np.ndarray) -> np.ndarray:
    """Items of 2**(c-1)+1 to 2**c shingles are of class c."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


class Items:
    """Distinct shingles of each item, their number's class and their minima under each hash function."""

    def __init__(self, ids: list, texts: list[str]):
        found, bounds = shingles(Words(pc.utf8_lower(pa.array(texts, pa.string())), NOT_ALNUM))
        sets = [np.unique(found[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        keep = [i for i, x in enumerate(sets) if len(x)]
        self.ids, self.sets = [ids[i] for i in keep], [sets[i] for i in keep]
        self.counts = np.array([len(x) for x in self.sets], np.int64)
        self.classes = size_class(self.counts)
        minima = np.array([[(x * s).min() for s in _SEEDS] for x in self.sets], np.uint64).reshape(-1, HASHES)
        self.tables = {}
        for c in np.unique(self.classes).tolist():
            of = np.flatnonzero(self.classes == c)
            keys = mix64(minima[of] + np.arange(HASHES, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)).ravel()
            rows = np.repeat(of, HASHES)
            order = np.argsort(keys, kind="stable")
            self.tables[c] = keys[order], rows[order]
        # All pairs of item and shingle, by shingle, for the exact check.
        flat = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(self.sets)), self.counts)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]


def _pairs(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of keys, every place of an equal entry of sorted_keys: (index of keys, index of sorted_keys)."""
    a = np.searchsorted(sorted_keys, keys, "left")
    there = np.flatnonzero(np.append(sorted_keys, sorted_keys[-1:])[a] == keys) if len(sorted_keys) else np.zeros(0, np.int64)
    n = np.zeros(len(keys), np.int64)  # most keys are not there
    n[there] = np.searchsorted(sorted_keys, keys[there], "right") - a[there]
    ends = np.cumsum(n)
    return np.repeat(np.arange(len(keys)), n), np.repeat(a - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def candidates(found: np.ndarray, bounds: np.ndarray, items: Items) -> np.ndarray:
    """Pairs (row, item) that share a minimum: rows are cut into blocks of the class's largest size, and a window is two
    blocks in a row, so that any passage as long as an item lies in a window at most twice its size."""
    pairs, cuts = [], []
    counts = np.diff(bounds)
    rows = np.flatnonzero(counts > 0)
    if not len(rows) or not items.tables:
        return np.zeros(0, np.int64)
    # Blocks of 16 or fewer shingles as columns, a row's last one filled up with its last shingle; a block of a class is made of
    # whole blocks of the class before.
    size = min(4, *items.tables)
    blocks = -(-counts[rows] >> size)
    starts = np.cumsum(blocks) - blocks
    begins = np.repeat(bounds[rows] - (starts << size), blocks) + (np.arange(blocks.sum()) << size)
    columns = found[np.minimum(begins + np.arange(1 << size)[:, None], np.repeat(bounds[rows + 1] - 1, blocks))]
    for c in sorted(items.tables):
        blocks = -(-counts[rows] >> c)
        row = np.repeat(rows, blocks)
        firsts = np.cumsum(blocks) - blocks
        nth = np.arange(len(row)) - np.repeat(firsts, blocks)
        last = np.concatenate((row[1:] != row[:-1], [True])) if len(row) else np.zeros(0, bool)
        cuts.append((*items.tables[c], row, np.repeat(starts, blocks) + (nth << (c - size)), last))
        starts, size = firsts, c
    for i, seed in enumerate(_SEEDS):
        lowest = (columns * seed).min(axis=0)
        for keys, of, row, begins, last in cuts:
            lowest = np.minimum.reduceat(lowest, begins)
            window = np.where(last, lowest, np.minimum(lowest, np.append(lowest[1:], lowest[-1:])))
            marked = mix64(window + np.uint64(i) * np.uint64(0xD6E8FEB86659FD93))
            hit, place = _pairs(keys, marked)
            pairs.append(row[hit] * len(items.ids) + of[place])
    return np.unique(np.concatenate([*pairs, np.zeros(0, np.int64)]))


def contained(found: np.ndarray, bounds: np.ndarray, items: Items, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates whose row holds at least threshold of the item's distinct shingles: rows, items, shares."""
    pairs = candidates(found, bounds, items)
    row, item = pairs // max(len(items.ids), 1), pairs % max(len(items.ids), 1)
    share = np.zeros(len(pairs))
    for r in np.unique(row).tolist():
        _, place = _pairs(items.flat, np.unique(found[bounds[r] : bounds[r + 1]]))
        of = slice(*np.searchsorted(row, [r, r + 1]))
        share[of] = np.bincount(items.owner[place], minlength=len(items.ids))[item[of]]
    share /= np.maximum(items.counts[item], 1) if len(items.ids) else 1
    good = share >= threshold
    return row[good], item[good], share[good]


def _blocks(benchmark: DataFrame, limit: int):
    """Items in blocks of about limit bytes of text, each read by itself, and whether it is the only one."""
    benchmark = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = -(-total // limit)
    for i in range(n):
        part = benchmark if n == 1 else benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        rows = part.collect()
        yield Items([r.item_id for r in rows], [r.text for r in rows]), n == 1


def _found(texts: pa.Array, items: Items, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, bounds = shingles(Words(pc.utf8_lower(texts), NOT_ALNUM), SHINGLE_WORDS)
    return contained(found, bounds, items, threshold)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of a document and an item of which it holds at least threshold of the distinct word shingles.

    docs: doc_id, text; benchmark: item_id, text; ids of any type, which may be null or repeat; other columns are ignored.
    Returns doc_id, item_id, containment, one row per pair of a row of docs and a row of benchmark. Null and empty texts
    match nothing. An item of fewer than five words is one shingle of all its words, which only a document of the same
    words has. Items over one block are searched for block by block: each block's matches are written before the next block
    is read, so that the driver and the executors never hold more than one.
    """
    kept = docs.select("doc_id", "text")
    kinds = kept.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = StructType([StructField("doc_id", kinds[0]), StructField("item_id", kinds[1]), StructField("containment", DoubleType())])
    item_type, out = to_arrow_type(kinds[1]), None
    for items, alone in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def search(batches, shared=shared):
            items = shared.value
            for table in text_batches(batches, 3 << 20):
                row, item, share = _found(table.column("text").combine_chunks(), items, threshold)
                ids = table.column("doc_id").combine_chunks().take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array([items.ids[i] for i in item.tolist()], item_type), pa.array(share)], ["doc_id", "item_id", "containment"])

        found = kept.mapInArrow(search, schema)
        if not alone:
            found = staged(found, "matches")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item; see matches(). Nothing is shuffled. Of tables that it wrote
    between blocks of items only the last is left; docs itself is never deleted, written or not."""
    out = docs
    for items, alone in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def keep(batches, shared=shared):
            for table in text_batches(batches, 3 << 20):
                clean = np.ones(table.num_rows, bool)
                clean[_found(table.column("text").combine_chunks(), shared.value, threshold)[0]] = False
                yield from table.filter(pa.array(clean)).to_batches()

        before, out = out, out.mapInArrow(keep, out.schema)
        if not alone:
            out = staged(out, "clean")
            if before is not docs:
                discard(before)
            shared.destroy()
    return out
