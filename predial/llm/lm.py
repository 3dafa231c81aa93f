"""Interpolated modified Kneser-Ney trigram model of words: counted in Spark, looked up in memory-mapped sorted arrays.

Texts are dealt into shards. Each shard sends the hashes of its distinct word triples, with their training counts, to the
tasks that own them; those add up the counts of all shards and answer every shard with the totals of just the triples that it
asked for. One shard for each triple then counts it for the pair that it begins with and the pair that it ends with; pairs are
totalled and answered in the same way, then words. To score its texts, a shard writes what it was answered as arrays sorted
by hash, maps them into memory and looks its tokens up.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from predial.llm.common import SPACES, Words, free_shuffles, mix64, pack, partitions_for, runs, sorted_groups, staged, text_bytes, unpack

SHARD_BYTES = 8 << 20
#: Text for each task that owns triples, pairs and words.
OWNER_BYTES = 16 << 20
#: Hashes of the marks before and behind each text; no word has them but by chance.
BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
TRIPLES, TRIPLE_TOTALS, PAIRS, PAIR_TOTALS, PAIR_FOLLOWS, WORDS, WORD_TOTALS, NUMBER = range(8)
_SCHEMA = "part int, kind tinyint, data binary, n long"
_ROW = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("data", pa.binary()), ("n", pa.int64())])
#: Numbers summed over all tasks: triples seen 1, 2, 3, 4 times; pairs with 1, 2, 3, 4 words before them, all pairs; words
#: with 1, 2, 3, 4, at least 3 words before them; training tokens, distinct ones.
_NUMBERS = ("t1", "t2", "t3", "t4", "p1", "p2", "p3", "p4", "pairs", "w1", "w2", "w3", "w4", "w3up", "tokens", "distinct")


def _row(part: int, kind: int, data: bytes | None, n: int | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int8()), pa.array([data], pa.binary()), pa.array([n], pa.int64())], schema=_ROW)


def _owner(keys: np.ndarray, n: int) -> np.ndarray:
    """In the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _followed(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix64(context * np.uint64(0x9E3779B97F4A7C15) + mix64(token))


#: The pair of two marks, context of each text's first token.
_START = _followed(np.array([BEGIN]), np.array([BEGIN]))[0]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, where one of each is, and the place of every key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    at = sorted_groups(ordered)
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(keys))))
    return ordered[at], order[at], place


def _shifted(place: np.ndarray, begins: np.ndarray, first: int) -> np.ndarray:
    """For each token what its predecessor has; first for those that begin a text."""
    out = np.concatenate(([0], place[:-1]))
    out[begins] = first
    return out


class Shard:
    """Tokens of some texts with hashes of the pairs and triples that they end."""

    def __init__(self, rows: pa.Table):
        column = rows.column("row").combine_chunks()
        column = column if not isinstance(column, pa.ChunkedArray) else pa.concat_arrays(column.chunks)
        found = Words(pc.ascii_lower(pc.fill_null(pc.struct_field(column, "text"), "")), SPACES)
        n = rows.num_rows
        bounds = found.bounds()
        self.begins = bounds[:-1] + np.arange(n)  # each text has its words and an end
        self.tokens = np.full(len(found.keys) + n, END)
        is_word = np.ones(len(self.tokens), bool)
        is_word[bounds[1:] + np.arange(n)] = False
        self.tokens[is_word] = found.keys
        self.train = np.repeat(rows.column("train").to_numpy().astype(bool), np.diff(bounds) + 1)
        before = np.concatenate(([BEGIN], self.tokens[:-1]))
        before[self.begins] = BEGIN
        self.pairs = _followed(before, self.tokens)

    def triples(self) -> np.ndarray:
        context = np.concatenate(([_START], self.pairs[:-1]))
        context[self.begins] = _START
        return _followed(context, self.tokens)

    def with_marks(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs and words, each with the mark that texts begin with at the end."""
        return np.append(self.pairs, _START), np.append(self.tokens, BEGIN)


def _small(x: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def _questions(me: int, kind: int, keys: np.ndarray, columns: list[np.ndarray], parts: int) -> pa.Table:
    """For each owner its distinct keys in order, as differences, with what this shard knows of them."""
    owner = _owner(keys, parts)
    out = [_row(int(owner[i]), kind, pack(np.array([me]), np.diff(keys[i:j], prepend=np.uint64(0)), *(_small(c[i:j]) for c in columns))) for i, j in runs(owner)]
    return pa.Table.from_batches(out, _ROW)


def _ask_triples(key, rows: pa.Table, parts: int) -> pa.Table:
    shard = Shard(rows)
    keys, _, place = _distinct(shard.triples())
    return _questions(key[0].as_py(), TRIPLES, keys, [np.bincount(place, weights=shard.train).astype(np.int64)], parts)


class Asked:
    """What the shards ask of one owner: distinct keys, one question for each key, sums of the columns by key."""

    def __init__(self, batches, parts: int):
        found = [unpack(data.as_py()) for batch in batches for data in batch.column("data")]
        self.shards = [int(x[0][0]) for x in found]
        if not found:
            return
        keys, self.first, self.place = _distinct(np.concatenate([np.cumsum(x[1]) for x in found]))
        self.sums = [np.bincount(self.place, weights=np.concatenate([x[i] for x in found])).astype(np.int64) for i in range(2, len(found[0]))]
        self.mine = _owner(keys[:1], parts)
        self.ends = np.cumsum([len(x[1]) for x in found]).tolist()

    def answers(self, kind: int, columns: list[np.ndarray], told: np.ndarray | None = None):
        """Rows with the columns' values for each shard's keys; told: keys that one shard is to count for their parts."""
        bits = np.zeros(len(self.place), bool)
        if told is not None:
            bits[self.first[told]] = True
        for me, i, j in zip(self.shards, [0, *self.ends], self.ends, strict=False):
            yield _row(me, kind, pack(self.mine, *(_small(c[self.place[i:j]]) for c in columns), np.packbits(bits[i:j])))


def _numbers(first: str, values):
    for i, value in enumerate(values, _NUMBERS.index(first)):
        yield _row(i, NUMBER, None, int(value))


def _of_each(x: np.ndarray) -> list[int]:
    return [int((x == k).sum()) for k in (1, 2, 3, 4)]


def _total_triples(batches, parts: int):
    asked = Asked(batches, parts)
    if asked.shards:
        (total,) = asked.sums
        yield from asked.answers(TRIPLE_TOTALS, [total], total > 0)
        yield from _numbers("t1", _of_each(total))


def _answers(table: pa.Table, kind: int) -> list[list[np.ndarray]]:
    """The answers of one kind to a shard, without their heads, in the order in which it asked."""
    found = [unpack(x) for x in table.filter(pc.equal(table.column("kind"), kind)).column("data").to_pylist()]
    return [x[1:] for x in sorted(found, key=lambda x: int(x[0][0]))]


def _joined(found: list[list[np.ndarray]], i: int) -> np.ndarray:
    return np.concatenate([x[i].astype(np.int64) for x in found]) if found else np.zeros(0, np.int64)


def _told(found: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Which keys this shard is to count, and their totals."""
    told = np.flatnonzero(np.concatenate([np.unpackbits(x[1], count=len(x[0])) for x in found]))
    return told, _joined(found, 0)[told]


def _statistics(context: np.ndarray, total: np.ndarray, end: np.ndarray, n: int) -> list[np.ndarray]:
    """For each of n contexts how many totals are 1, 2 and more, and the sum of the latter, which is mostly 0 and so takes less
    room than that of all; for each end how many it has."""
    often = total > 2
    more = np.bincount(context[often], weights=total[often], minlength=n).astype(np.int64)
    return [*(np.bincount(context[x], minlength=n) for x in (total == 1, total == 2, often)), more, np.bincount(end, minlength=n)]


def _ask_pairs(key, totals: pa.Table, rows: pa.Table, parts: int) -> pa.Table:
    """A shard's pairs, with what the triples that it is to count add to their statistics."""
    if not rows.num_rows:
        return _ROW.empty_table()
    shard = Shard(rows)
    told, total = _told(_answers(totals, TRIPLE_TOTALS))
    first = _distinct(shard.triples())[1][told]
    keys, _, place = _distinct(shard.with_marks()[0])
    context = _shifted(place[:-1], shard.begins, place[-1])
    return _questions(key[0].as_py(), PAIRS, keys, _statistics(context[first], total, place[first], len(keys)), parts)


def _total_pairs(batches, parts: int):
    asked = Asked(batches, parts)
    if asked.shards:
        *context, follows = asked.sums
        yield from asked.answers(PAIR_TOTALS, context)
        yield from asked.answers(PAIR_FOLLOWS, [follows], follows > 0)
        yield from _numbers("p1", (*_of_each(follows), (follows > 0).sum()))


def _ask_words(key, totals: pa.Table, rows: pa.Table, parts: int) -> pa.Table:
    """A shard's words with their training counts, and what the pairs that it is to count add to their statistics."""
    if not rows.num_rows:
        return _ROW.empty_table()
    shard = Shard(rows)
    told, total = _told(_answers(totals, PAIR_FOLLOWS))
    pairs, words = shard.with_marks()
    first = _distinct(pairs)[1][told]  # the pair of two marks follows nothing and is never told
    keys, _, place = _distinct(words)
    counts = np.bincount(place[:-1], weights=shard.train, minlength=len(keys)).astype(np.int64)
    context = _shifted(place[:-1], shard.begins, place[-1])
    return _questions(key[0].as_py(), WORDS, keys, [counts, *_statistics(context[first], total, place[first], len(keys))], parts)


def _total_words(batches, parts: int):
    asked = Asked(batches, parts)
    if asked.shards:
        total, follows = asked.sums[0], asked.sums[5]
        yield from asked.answers(WORD_TOTALS, asked.sums)
        yield from _numbers("w1", (*_of_each(follows), (follows > 2).sum(), total.sum(), (total > 0).sum()))


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and more, by the counts of counts; thin data fall back on fixed ones."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    found = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(found, [0, 0.05, 0.05, 0.05], [0, 1, 2, 3])


class Mapped:
    """Arrays in a file of this task's own temporary folder, memory-mapped; the file goes with the object, so that nothing is
    left and a task that runs again makes its own."""

    def __init__(self, **arrays: np.ndarray):
        self.file = tempfile.TemporaryFile()
        places = {}
        for name, x in arrays.items():
            places[name] = self.file.tell(), x.dtype, len(x)
            self.file.write(np.ascontiguousarray(x).tobytes() + b"\0" * (-x.nbytes % 64))
        self.file.flush()
        for name, (at, kind, n) in places.items():
            setattr(self, name, np.memmap(self.file, kind, "r", at, (n,)) if n else np.zeros(0, kind))


def _level(total: np.ndarray, cut: np.ndarray, context: np.ndarray, left: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """One level of interpolation: discounted totals within their contexts, the rest by the level below."""
    some = np.maximum(context, 1)
    return np.where(context > 0, np.maximum(total - cut[np.minimum(total, 3)], 0) / some + left / some * lower, lower)


def _score(answers: pa.Table, rows: pa.Table, pair_numbers: dict[str, int], schema: pa.Schema) -> pa.Table:
    if not rows.num_rows:
        return schema.empty_table()
    shard = Shard(rows)
    g = dict.fromkeys(_NUMBERS, 0) | pair_numbers
    for found in answers.filter(pc.equal(answers.column("kind"), NUMBER)).column("numbers").to_pylist():
        g |= {_NUMBERS[x["part"]]: x["n"] for x in found or []}
    triples, (pairs, words) = shard.triples(), shard.with_marks()
    hashes = {f"{name}_hash": np.unique(x) for name, x in (("triple", triples), ("pair", pairs), ("word", words))}
    told = {kind: _answers(answers, kind) for kind in (TRIPLE_TOTALS, PAIR_TOTALS, PAIR_FOLLOWS, WORD_TOTALS)}
    columns = {"triples": _joined(told[TRIPLE_TOTALS], 0), "pairs": _joined(told[PAIR_FOLLOWS], 0), "count": _joined(told[WORD_TOTALS], 0), "follows": _joined(told[WORD_TOTALS], 5)}
    for i, name in enumerate(("once", "twice", "often", "more")):
        columns |= {f"pair_{name}": _joined(told[PAIR_TOTALS], i), f"word_{name}": _joined(told[WORD_TOTALS], i + 1)}
    model = Mapped(**hashes, **columns)
    del hashes, told, columns, answers
    triple, pair, word = (np.searchsorted(known, asked) for known, asked in ((model.triple_hash, triples), (model.pair_hash, pairs), (model.word_hash, words)))
    del triples, pairs, words
    two_before, before = (_shifted(x[:-1], shard.begins, x[-1]) for x in (pair, word))
    pair, word = pair[:-1], word[:-1]
    n, v = g["tokens"], g["distinct"]
    count = model.count[word]
    base = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
    d, e, h = (discounts(*(g[f"{x}{k}"] for k in (1, 2, 3, 4))) for x in "tpw")
    follows = model.follows[word]
    uniform = 1 / (v + 1)
    if g["pairs"]:
        rest = (h[1] * g["w1"] + h[2] * g["w2"] + h[3] * g["w3up"]) / g["pairs"]
        lower = np.maximum(follows - h[np.minimum(follows, 3)], 0) / g["pairs"] + rest * uniform
    else:
        lower = np.full(len(word), uniform)
    once, twice, often, more = (x[before] for x in (model.word_once, model.word_twice, model.word_often, model.word_more))
    lower = _level(model.pairs[pair], e, once + 2 * twice + more, e[1] * once + e[2] * twice + e[3] * often, lower)
    once, twice, often, more = (x[two_before] for x in (model.pair_once, model.pair_twice, model.pair_often, model.pair_more))
    chance = _level(model.triples[triple], d, once + 2 * twice + more, d[1] * once + d[2] * twice + d[3] * often, lower)
    total = lambda x: np.add.reduceat(x, shard.begins) if len(shard.begins) else x
    known = total((count > 0).astype(np.int64))
    size = np.diff(np.append(shard.begins, len(word)))
    column = rows.column("row").combine_chunks()
    column = column if not isinstance(column, pa.ChunkedArray) else pa.concat_arrays(column.chunks)
    return pa.Table.from_arrays(
        [pc.struct_field(column, "doc_id"), pc.invert(rows.column("train")), pa.array(size), pa.array(known), pa.array(np.full(len(size), n)), pa.array(total(base)), pa.array(total(np.log10(chance)))],
        schema=schema,
    )


def _summed(told: DataFrame) -> dict[str, int]:
    """The few numbers of a staged table; the shuffles that made it are not needed from here on."""
    found = told.filter(F.col("kind") == NUMBER).groupBy("part").agg(F.sum("n").alias("n")).collect()
    free_shuffles(told.sparkSession)
    return {_NUMBERS[r.part]: r.n for r in found}


def score(docs: DataFrame, train: Column) -> DataFrame:
    """Log10 probabilities of texts under the model of those texts for which train is true (null: false).

    docs: doc_id, text (null: empty); other columns only serve train. Tokens: runs of anything but ASCII white space, A-Z
    in lower case, then one end; two marks go before each text. Returns doc_id, held_out (not train), n_tokens, n_known
    (tokens seen in training), train_tokens, base_score (add-0.1 unigrams), score; one row per row. Without training texts
    all words are equally likely. Hashes of 64 bits stand for words, pairs and triples.
    """
    spark = docs.sparkSession
    n_bytes = text_bytes(docs)
    free_shuffles(spark)
    parts = partitions_for(spark, n_bytes, OWNER_BYTES)
    row = F.struct("doc_id", "text")
    rows = docs.select(row.alias("row"), F.coalesce(train, F.lit(False)).alias("train"))
    spread = F.xxhash64("row.doc_id", F.octet_length("row.text"), F.xxhash64("row.text"))
    shards = partitions_for(spark, n_bytes, SHARD_BYTES)
    dealt = rows.withColumn("part", F.pmod(spread, F.lit(shards)).cast("int")).groupBy("part")
    of_kind = lambda table, *kinds: table.filter(F.col("kind").isin(*kinds))
    asked = dealt.applyInArrow(lambda key, table: _ask_triples(key, table, parts), _SCHEMA)
    triples = staged(asked.repartitionById(parts, "part").mapInArrow(lambda b: _total_triples(b, parts), _SCHEMA), "lm-triples")
    del asked
    numbers = _summed(triples)
    totals = of_kind(triples, TRIPLE_TOTALS)
    asked = totals.groupBy("part").cogroup(dealt).applyInArrow(lambda key, a, b: _ask_pairs(key, a, b, parts), _SCHEMA)
    pairs = staged(asked.repartitionById(parts, "part").mapInArrow(lambda b: _total_pairs(b, parts), _SCHEMA), "lm-pairs")
    del asked
    numbers |= _summed(pairs)
    # From here on one plan, so that the texts are shuffled once for both of their passes.
    about_words = of_kind(pairs, PAIR_FOLLOWS).groupBy("part").cogroup(dealt).applyInArrow(lambda key, a, b: _ask_words(key, a, b, parts), _SCHEMA)
    words = about_words.repartitionById(parts, "part").mapInArrow(lambda b: _total_words(b, parts), _SCHEMA)
    kinds = "array<struct<part:int,n:bigint>>"
    none = F.lit(None).cast(kinds).alias("numbers")
    summed = of_kind(words, NUMBER).groupBy("part").agg(F.sum("n").alias("n"))
    summed = summed.agg(F.collect_list(F.struct("part", "n")).alias("numbers"))  # seven numbers
    told = spark.range(shards).crossJoin(F.broadcast(summed))
    told = told.select(F.col("id").cast("int").alias("part"), F.lit(NUMBER).cast("tinyint").alias("kind"), F.lit(None).cast("binary").alias("data"), "numbers")
    answers = totals.unionByName(of_kind(pairs, PAIR_TOTALS, PAIR_FOLLOWS)).unionByName(of_kind(words, WORD_TOTALS))
    answers = answers.select("part", "kind", "data", none).unionByName(told)
    kind = docs.schema["doc_id"].dataType
    types = [to_arrow_type(kind), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]
    out = pa.schema(list(zip(("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"), types, strict=True)))
    return answers.groupBy("part").cogroup(dealt).applyInArrow(
        lambda a, b: _score(a, b, numbers, out),
        f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
