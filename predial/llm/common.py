"""Helpers that several text operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import math
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: A word: a run of characters other than ASCII control characters, spaces and punctuation.
WORD_PATTERN = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
_WORD = re.compile(WORD_PATTERN)
SHINGLE_WORDS = 5
np.seterr(over="ignore")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)


def _return_memory() -> None:
    """Let this process give large freed arrays back to the system at once, Arrow's too. Workers live for many tasks, and all of an
    executor's share its memory; by default both allocators keep what the largest task needed."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        mallopt = ctypes.CDLL(None).mallopt
        for option, value in ((_MMAP_THRESHOLD, 1 << 18), (_TRIM_THRESHOLD, 1 << 20), (_ARENA_MAX, 2)):
            mallopt(option, value)


#: Numbers of the options in malloc.h.
_TRIM_THRESHOLD, _MMAP_THRESHOLD, _ARENA_MAX = -1, -3, -8
_return_memory()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without a configured one, a local session gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"file://{tempfile.gettempdir()}/predial-shared").rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, so that they need no copy of their own."""
    context = spark.sparkContext
    if getattr(context, "_predial_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="predial-")) / "predial.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(path))
    context._predial_shipped = True


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    _staged.add((spark, path))
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        if df is not None and hasattr(df, "staged_at"):
            _delete(df.sparkSession, df.staged_at)


_staged: set[tuple[SparkSession, str]] = set()


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    _staged.discard((spark, path))


@atexit.register
def _discard_all() -> None:
    """What is left when the driver ends; a session that has stopped already keeps its tables."""
    for spark, path in list(_staged):
        with contextlib.suppress(Exception):
            _delete(spark, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished jobs now: it does so once the driver's garbage collectors, Python's and the
    JVM's, have found that no plan refers to them. The last plan of all is still held by Spark's listeners."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(name: str, columns: list[str]) -> str:
    """name, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_ids(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs, whose key must be of an integer type."""
    kind = docs.schema[key].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{key} is of type {kind.simpleString()}; an integer type is needed")
    return docs


SALTS = 16


def salted(many: DataFrame, few: DataFrame, on: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """many joined to few, whose keys are distinct: each key's rows of many are dealt over SALTS tasks by the hash of spread."""
    salt = fresh("salt", [*many.columns, *few.columns])
    many = many.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    few = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.join(few, [*on, salt], how).drop(salt)


def use_checkpoints(spark: SparkSession) -> None:
    """Give iterative library code a checkpoint folder where the session has none yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def partitions_for(spark: SparkSession, n_bytes: int, target: int = 24 << 20) -> int:
    """Enough partitions for target bytes each, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / target), 1)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def held_out(key: str | Column, folds: int, fold: int) -> Column:
    """True for rows whose crc32(key as text) leaves the remainder fold; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most bound rows, those with the smallest hash of key: the same ones on every run.

    Of many rows, only those under a hash that about bound + 10 * sqrt(bound) rows stay under are sorted.
    """
    hashed, n = F.xxhash64(F.lit(7), key), rows.count()
    wanted = bound + 10 * math.sqrt(bound)
    if n > wanted:
        rows = rows.filter(hashed <= int(2**64 * (wanted / n)) - 2**63)
    return rows.orderBy(hashed, key).limit(bound)


_POWER = np.uint64(0x2545F4914F6CDD1D)
_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, at least, of a number and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        one = np.ones(1, np.uint64)
        _powers[:] = (np.cumprod(np.concatenate((one, np.full(size, x, np.uint64)))) for x in (_POWER, _INVERSE))
    return _powers[0], _powers[1]


def separators(spaces_only: bool) -> np.ndarray:
    """Which of the 256 bytes end a word: ASCII white space alone, or all of ASCII but letters and digits."""
    out = np.zeros(256, bool)
    if spaces_only:
        out[[32, *range(9, 14)]] = True
    else:
        out[:128] = [not chr(i).isalnum() for i in range(128)]
    return out


SPACES, NOT_ALNUM = separators(True), separators(False)


def range_keys(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Hashes of byte ranges, whose begins and ends ascend, in steps of about step bytes to keep memory small."""
    out = np.empty(len(begins), np.uint64)
    i = 0
    while i < len(begins):
        j = max(i + 1, int(np.searchsorted(begins, begins[i] + step)))
        a, b, e = begins[i], begins[i:j] - begins[i], ends[i:j] - begins[i]
        part = raw[a : a + e[-1]]
        up, down = powers(len(part) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part + np.uint64(1)) * up[: len(part)])))
        out[i:j] = mix64((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64) * _MIX2)
        i = j
    return out


class Words:
    """Words of an Arrow array of texts (nulls count as empty), as byte ranges with 64-bit content hashes.

    raw: the bytes of all texts; starts, ends: each word's range; doc: the row of each word; keys: the hashes.
    """

    def __init__(self, texts: pa.Array, separator: np.ndarray):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
        self.raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offsets = at - at[0]
        inside = ~separator[self.raw]
        before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
        begins = self.offsets[:-1][self.offsets[:-1] < len(inside)]
        before[begins] = False
        after = np.concatenate((inside[1:], [False])) if len(inside) else inside
        after[begins[begins > 0] - 1] = False
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.keys = range_keys(self.raw, self.starts, self.ends)

    def word(self, i: int) -> str:
        return self.raw[self.starts[i] : self.ends[i]].tobytes().decode()

    def prefix_keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of at least n bytes, and the hashes of their first n bytes."""
        rows = np.flatnonzero(self.ends - self.starts >= n)
        return rows, mix64(range_keys(self.raw, self.starts[rows], self.starts[rows] + n) + np.uint64(n))

    def words(self, rows: np.ndarray) -> list[str]:
        raw = self.raw.tobytes()
        return [raw[a:b].decode() for a, b in zip(self.starts[rows].tolist(), self.ends[rows].tolist(), strict=True)]

    def bounds(self) -> np.ndarray:
        """Where the words of each row begin and end in the word arrays."""
        return np.searchsorted(self.doc, np.arange(len(self.offsets)))


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * _MIX2
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def shingles(found: Words, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n-word shingle in order, and where those of each row begin and end.

    A row with fewer words has one shingle of all of them; a row without words has none.
    """
    bounds = found.bounds()
    counts = np.diff(bounds)
    mixed = mix64(found.keys)
    total = len(mixed)
    whole = np.zeros(total, np.uint64)
    for i in range(min(n, total)):
        whole[: total - i] = whole[: total - i] * np.uint64(0x100000001B3) + mixed[i:]
    short = np.flatnonzero((counts > 0) & (counts < n))
    for row in short.tolist():
        value = np.uint64(0)
        for x in mixed[bounds[row] : bounds[row + 1]]:
            value = value * np.uint64(0x100000001B3) + x
        whole[bounds[row]] = value + np.uint64(counts[row]) * _MIX
    many = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out = np.concatenate(([0], np.cumsum(many)))
    take = np.repeat(bounds[:-1] - out[:-1], many) + np.arange(out[-1])
    return mix64(whole[take]), out


def pack(*arrays: np.ndarray) -> bytes:
    """Several arrays as one compressed value, byte planes apart so that small numbers take little room."""
    head = [np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], np.int64).tobytes()]
    body = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    raw = b"".join(head + body)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(value: bytes) -> list[np.ndarray]:
    size = int(np.frombuffer(value, np.int64, 1)[0])
    raw = pa.decompress(memoryview(value)[8:], size, codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    at, out = 8 * (1 + 2 * n), []
    for code, count in head.reshape(n, 2).tolist():
        kind = np.dtype(chr(code))
        planes = np.frombuffer(raw, np.uint8, count * kind.itemsize, at).reshape(kind.itemsize, count)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(count))
        at += count * kind.itemsize
    return out


def text_batches(batches, limit: int = 24 << 20):
    """Split and merge Arrow batches into tables of about limit bytes of text."""
    held, size = [], 0
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        if not batch.num_rows:
            continue
        lengths = np.nan_to_num(np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), float)) + 64
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0.0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit - size, "right")))
            held.append(batch.slice(start, stop - start))
            size += ends[min(stop, batch.num_rows) - 1] - base
            start = stop
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def sorted_groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def runs(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """Begins and ends of the runs of equal keys."""
    at = sorted_groups(sorted_keys).tolist()
    return list(zip(at, [*at[1:], len(sorted_keys)], strict=True)) if at else []
