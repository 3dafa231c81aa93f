"""Collocations: phrases whose words stand together more often than their parts would by chance, from exact phrase counts.

Counts are weighted acyclic automata. A batch of texts sorts its distinct phrases and builds an automaton whose path is a phrase
and whose weight the phrase's count, states with equal continuations shared. The automata are sent in pieces by the hash range
of the first words of their phrases; the task of a range unites what all batches send and adds up the weights. At the end each
range composes an automaton of the parts that candidates ask for with its automaton of counts.

A phrase is no more frequent than its parts, so rare words are left out first, then phrases with a rare pair of words.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from predial.llm.common import mix64, pack, partitions_for, ship, sorted_groups, staged, text_batches, text_bytes, unpack

BATCH_BYTES = 8 << 20
#: Text for each range of phrases.
RANGE_BYTES = 8 << 20
#: Words that choose a phrase's range; shorter phrases are chosen by all of theirs.
PREFIX = 3
SALTS = 32
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAPS = _BREAKS.copy()
_GAPS[[0x20, 0x09]] = True


class Counts:
    """A weighted acyclic automaton: phrases of integer labels with positive weights.

    State 0 has no arcs, the last state is the root. Arcs of state i are starts[i] to starts[i + 1], by ascending label; an
    arc's weight is that of the phrase that ends with it, 0 if there is none.
    """

    def __init__(self, starts: np.ndarray, labels: np.ndarray, weights: np.ndarray, targets: np.ndarray):
        self.starts, self.labels, self.weights, self.targets = starts, labels, weights, targets

    @classmethod
    def build(cls, phrases: np.ndarray, weights: np.ndarray) -> Counts:
        """From distinct phrases in ascending order, one a row, filled up with -1.

        From the last words to the first, the states of one depth are made together; states whose arcs agree in labels,
        weights and targets become one.
        """
        n, longest = phrases.shape
        used = phrases >= 0
        size = used.sum(axis=1)
        new = np.ones((n, longest), bool)
        if n > 1:
            new[1:] = np.logical_or.accumulate(phrases[1:] != phrases[:-1], axis=1)
        new &= used
        node = np.cumsum(new, axis=0) - 1
        state = np.zeros(int(new[:, -1].sum()) if longest else 0, np.int64)  # of the nodes of the present depth
        arcs: list[tuple[np.ndarray, ...]] = []
        sizes = [np.zeros(1, np.int64)]
        made = 1
        for d in range(longest - 1, -1, -1):
            rows = np.flatnonzero(new[:, d])
            label, target = phrases[rows, d], state
            weight = np.where(size[rows] == d + 1, weights[rows], 0)
            parent = node[rows, d - 1] if d else np.zeros(len(rows), np.int64)
            begins = sorted_groups(parent)
            counts = np.diff(np.append(begins, len(rows)))
            kept, place = _equal_states(label, weight, target, begins, counts)
            take = np.repeat(begins[kept] - np.concatenate(([0], np.cumsum(counts[kept])[:-1])), counts[kept]) + np.arange(counts[kept].sum())
            arcs.append((label[take], weight[take], target[take]))
            sizes.append(counts[kept])
            if d:
                state = np.zeros(int(new[:, d - 1].sum()), np.int64)
                state[parent[begins]] = made + place
            made += len(kept)
        if not n:
            sizes.append(np.zeros(1, np.int64))
        starts = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        columns = [np.concatenate(x) for x in zip(*arcs, strict=True)] if arcs else [np.zeros(0, np.int64)] * 3
        return cls(starts, *columns)

    def _next(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All arcs of the states, and which of the states each belongs to."""
        counts = self.starts[states + 1] - self.starts[states]
        of = np.repeat(np.arange(len(states)), counts)
        return np.repeat(self.starts[states] - np.cumsum(counts) + counts, counts) + np.arange(len(of)), of

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """The phrases in ascending order, filled up with -1, and their weights."""
        return self.compose(None)

    def compose(self, counts: Counts | None) -> tuple[np.ndarray, np.ndarray]:
        """This automaton's phrases with their weights in counts (0: it has no such phrase); without counts, with their own."""
        root = len(self.starts) - 2
        mine = np.array([root]) if len(self.labels) else np.zeros(0, np.int64)
        theirs = np.array([len(counts.starts) - 2]) if counts is not None else None
        key = None
        if counts is not None:
            known = np.unique(counts.labels)
            state = np.repeat(np.arange(len(counts.starts) - 1), np.diff(counts.starts))
            key = state * (len(known) + 1) + np.searchsorted(known, counts.labels)  # arcs are in this order
        path = np.zeros((len(mine), 0), np.int64)
        found, weights = [], []
        while len(mine):
            arc, of = self._next(mine)
            if not len(arc):
                break
            path = np.column_stack((path[of], self.labels[arc]))
            if counts is None:
                weight = self.weights[arc]
            else:
                at = np.searchsorted(known, self.labels[arc])
                asked = np.where(theirs[of] >= 0, theirs[of] * (len(known) + 1) + at, -1)
                place = np.searchsorted(key, asked)
                hit = np.zeros(len(asked), bool)
                inside = np.flatnonzero((place < len(key)) & (at < len(known)))
                hit[inside] = (key[place[inside]] == asked[inside]) & (known[at[inside]] == self.labels[arc[inside]])
                weight = np.zeros(len(asked), np.int64)
                weight[hit] = counts.weights[place[hit]]
                theirs = np.full(len(asked), -1)
                theirs[hit] = counts.targets[place[hit]]
            is_phrase = self.weights[arc] > 0
            found.append(path[is_phrase])
            weights.append(weight[is_phrase])
            mine = self.targets[arc]
        longest = max((x.shape[1] for x in found), default=0)
        filled = [np.pad(x, ((0, 0), (0, longest - x.shape[1])), constant_values=-1) for x in found]
        rows, total = (np.concatenate(filled), np.concatenate(weights)) if filled else (np.zeros((0, 0), np.int64), np.zeros(0, np.int64))
        order = _order(rows)
        return rows[order], total[order]

    def to_bytes(self) -> bytes:
        """Labels as differences within their states."""
        steps = np.diff(self.labels, prepend=0)
        first = self.starts[:-1][np.diff(self.starts) > 0]
        steps[first] = self.labels[first]
        return pack(np.diff(self.starts).astype(np.int32), steps, _narrow(self.weights), _narrow(self.targets))

    @classmethod
    def from_bytes(cls, data: bytes) -> Counts:
        sizes, steps, weights, targets = unpack(data)
        starts = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
        sums = np.cumsum(steps)
        before = np.concatenate(([0], sums))[starts[:-1]]
        return cls(starts, sums - np.repeat(before, sizes), weights.astype(np.int64), targets.astype(np.int64))


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _order(rows: np.ndarray) -> np.ndarray:
    return np.lexsort(rows.T[::-1]) if rows.shape[1] else np.arange(len(rows))


def _equal_states(label, weight, target, begins, counts) -> tuple[np.ndarray, np.ndarray]:
    """One of each group of states with equal arcs, and each state's place among those. Hashes propose, arcs decide."""
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = mix64(mix64(mix64(label.view(np.uint64)) + weight.astype(np.uint64)) + target.astype(np.uint64))
    hashed = np.add.reduceat(mixed, begins) + counts.astype(np.uint64)
    _, first, place = np.unique(hashed, return_index=True, return_inverse=True)
    same = first[place]
    fits = counts == counts[same]
    # Compare arc by arc those of equal number.
    of = np.repeat(np.arange(len(begins)), np.where(fits, counts, 0))
    step = np.arange(len(of)) - np.repeat(np.cumsum(np.where(fits, counts, 0)) - np.where(fits, counts, 0), np.where(fits, counts, 0))
    mine, other = begins[of] + step, begins[same[of]] + step
    differs = (label[mine] != label[other]) | (weight[mine] != weight[other]) | (target[mine] != target[other])
    fits[of[differs]] = False
    kept = np.flatnonzero(fits & (same == np.arange(len(begins))) | ~fits)
    number = np.full(len(begins), -1)
    number[kept] = np.arange(len(kept))
    return kept, number[np.where(fits, same, np.arange(len(begins)))]


def united(automata: list[Counts], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of all automata in ascending order with the sums of their weights."""
    found = [x.phrases() for x in automata]
    rows = [np.pad(p, ((0, 0), (0, longest - p.shape[1])), constant_values=-1) for p, _ in found]
    rows, weights = np.concatenate(rows), np.concatenate([w for _, w in found])
    order = _order(rows)
    rows, weights = rows[order], weights[order]
    begins = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))) if len(rows) else np.zeros(0, np.int64)
    return rows[begins], np.add.reduceat(weights, begins) if len(begins) else weights


def _range_of(phrases: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each phrase: by the hash of its first words."""
    hashed = np.zeros(len(phrases), np.uint64)
    for column in phrases.T[:PREFIX]:
        hashed = mix64(hashed + column.astype(np.int64).view(np.uint64))
    return ((hashed >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


_MESSAGE = pa.schema([("range", pa.int32()), ("sender", pa.int64()), ("data", pa.binary())])
_MESSAGE_SQL = "range int, sender long, data binary"


def _messages(sender: int, phrases: np.ndarray, weights: np.ndarray, ranges: int) -> pa.Table:
    """Automata of ascending phrases, one for each range that has some."""
    to = _range_of(phrases, ranges)
    order = np.argsort(to, kind="stable")
    begins = sorted_groups(to[order])
    rows = []
    for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(order)], strict=False):
        at = order[i:j]
        rows.append((int(to[at[0]]), sender, Counts.build(phrases[at], weights[at]).to_bytes()))
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MESSAGE, strict=True)], schema=_MESSAGE)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values, pa.int64()))


_BATCH = pa.schema([("batch", pa.int64()), ("words", pa.binary()), ("coded", pa.binary())])
_BATCH_SQL = "batch long, words binary, coded binary"


def _table_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _code_batches(batches):
    """One row for each batch of texts: its distinct words by language with their counts, and all words in order as places in
    that list, with a bit for those that begin a piece."""
    for i, table in enumerate(text_batches(batches, BATCH_BYTES)):
        texts = pc.ascii_lower(pc.fill_null(table.column("text").combine_chunks(), "").cast(pa.large_string()))
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        inside = ~_GAPS[raw]
        cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
        edge = np.empty(len(raw) + 1, bool)  # where a word may begin or end
        edge[0] = edge[-1] = True
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        edge[cut] = True
        edges = np.flatnonzero(edge)
        del edge
        word = inside[edges[:-1]] if len(raw) else np.zeros(0, bool)
        starts, ends = edges[:-1][word], edges[1:][word]
        text_of = np.searchsorted(at, starts, "right") - 1
        before = np.searchsorted(np.flatnonzero(_BREAKS[raw]), starts)
        first = np.ones(len(starts), bool)
        first[1:] = (before[1:] != before[:-1]) | (text_of[1:] != text_of[:-1])
        offsets = np.append(0, np.cumsum(ends - starts))
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[inside]))]
        ).dictionary_encode()
        del edges, inside, starts, ends, before, offsets
        langs = pc.fill_null(table.column("lang").combine_chunks().cast(pa.string()), "und").dictionary_encode()
        keys = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text_of]
        del text_of
        n_words = max(len(words.dictionary), 1)
        keys = keys * n_words + words.indices.to_numpy(zero_copy_only=False)
        keys, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
        found = pa.table({
            "lang": langs.dictionary.take(pa.array(keys // n_words)), "word": words.dictionary.take(pa.array(keys % n_words)).cast(pa.large_string()), "count": counts,
        })
        columns = [
            pa.array([TaskContext.get().partitionId() << 33 | i], pa.int64()),
            pa.array([_table_bytes(found)], pa.binary()),
            pa.array([pack(_narrow(place), np.packbits(first))], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=_BATCH)


def _word_messages(batches, ranges: int):
    """For each range of hashes the words of a batch that fall into it, with their places in the batch's list."""
    for batch in batches:
        for sender, data in zip(batch.column("batch").to_pylist(), batch.column("words").to_pylist(), strict=True):
            found = _table(data)
            hashed = np.fromiter(map(zlib.crc32, found.column("word").cast(pa.large_binary()).to_pylist()), np.int64, found.num_rows)
            to = hashed * ranges >> 32
            order = np.argsort(to, kind="stable")
            found = found.append_column("at", pa.array(np.arange(found.num_rows), pa.int32())).take(pa.array(order))
            begins = sorted_groups(to[order]).tolist()
            rows = [(int(to[order[i]]), sender, _table_bytes(found.slice(i, j - i))) for i, j in zip(begins, [*begins[1:], len(order)], strict=False)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MESSAGE, strict=True)], schema=_MESSAGE)


_WORDS = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64()), ("sender", pa.int64()), ("data", pa.binary())])
_WORDS_SQL = "id long, lang string, word string, f long, sender long, data binary"


def _unite_words(key, rows: pa.Table, minimum: int) -> pa.Table:
    """A range's frequent words with ids of their own, for each sender the places and ids of those that it has, and for each
    language all its words' occurrences in the range (a row without word)."""
    tables = [_table(x) for x in rows.column("data").to_pylist()]
    every = pa.concat_tables(tables).unify_dictionaries()
    every = every.set_column(0, "lang", every.column("lang").cast(pa.string()))
    sums = every.select(["lang", "word", "count"]).group_by(["lang", "word"]).aggregate([("count", "sum")])
    langs = sums.group_by("lang").aggregate([("count_sum", "sum")])
    often = sums.filter(pc.greater_equal(sums.column("count_sum"), minimum)).sort_by([("lang", "ascending"), ("word", "ascending")])
    ids = (key[0].as_py() << 40) + np.arange(often.num_rows)
    none = lambda n, kind: pa.nulls(n, kind)
    n, m = often.num_rows, langs.num_rows
    one = lambda *columns: pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, _WORDS, strict=True)], schema=_WORDS)
    out = [
        one(ids, often.column("lang").cast(pa.string()), often.column("word").cast(pa.string()), often.column("count_sum"), none(n, pa.int64()), none(n, pa.binary())),
        one(none(m, pa.int64()), langs.column("lang").cast(pa.string()), none(m, pa.string()), langs.column("count_sum_sum"), none(m, pa.int64()), none(m, pa.binary())),
    ]
    # A word has no tab, so that language and word are told apart.
    joined = lambda t: pc.binary_join_element_wise(t.column("lang").cast(pa.large_string()), t.column("word"), pa.scalar("\t", pa.large_string()))
    place = pc.fill_null(pc.index_in(joined(every), value_set=joined(often).combine_chunks()), -1).to_numpy()
    end = 0
    for sender, table in zip(rows.column("sender").to_pylist(), tables, strict=True):
        mine = place[end : end + table.num_rows]
        end += table.num_rows
        known = mine >= 0
        if known.any():
            data = pack(_narrow(table.column("at").to_numpy()[known]), ids[mine[known]])
            out.append(one([None], [None], [None], [None], [sender], [data]))
    return pa.concat_tables(out)


class _Batch:
    """A batch's words as labels that ascend with the ids of frequent words; -1 is a rare word."""

    def __init__(self, answers: pa.Table, rows: pa.Table):
        place, first = unpack(rows.column("coded")[0].as_py())
        told = [unpack(x) for x in answers.column("data").to_pylist() if x is not None]
        at, ids = (np.concatenate([np.zeros(0, np.int64), *(x[i].astype(np.int64) for x in told)]) for i in (0, 1))
        self.ids = np.sort(ids)
        label = np.full(int(place.max(initial=0)) + 1, -1)
        label[at] = np.searchsorted(self.ids, ids)
        self.words = label[place]
        self.first = np.unpackbits(first, count=len(place)).astype(bool) if len(place) else np.zeros(0, bool)

    def pairs(self) -> np.ndarray:
        """For each word the key of it and the next one; -1 where one is rare or the next begins a piece."""
        a, b = self.words[:-1], self.words[1:]
        return np.where((a >= 0) & (b >= 0) & ~self.first[1:], a << 32 | b, -1)


def _pair_messages(answers: pa.Table, rows: pa.Table, ranges: int) -> pa.Table:
    if not rows.num_rows:
        return _MESSAGE.empty_table()
    batch = _Batch(answers, rows)
    pairs = batch.pairs()
    keys, counts = np.unique(pairs[pairs >= 0], return_counts=True)
    phrases = batch.ids[np.column_stack((keys >> 32, keys & 0xFFFFFFFF))]
    return _messages(rows.column("batch")[0].as_py(), phrases, counts, ranges)


def _longer_messages(answers: pa.Table, rows: pa.Table, ranges: int, longest: int) -> pa.Table:
    if not rows.num_rows:
        return _MESSAGE.empty_table()
    batch = _Batch(answers, rows)
    told = [np.asarray(x.as_py(), np.int64).reshape(-1, 2) for x in answers.column("pairs") if x.is_valid]
    frequent = np.zeros(0, np.int64)
    if told:
        ids = np.searchsorted(batch.ids, np.concatenate(told))
        frequent = np.sort(ids[:, 0] << 32 | ids[:, 1])
    pairs = batch.pairs()
    at = np.searchsorted(frequent, pairs)
    good = np.zeros(len(pairs), bool)
    inside = at < len(frequent)
    good[inside] = frequent[at[inside]] == pairs[inside]
    # A phrase of one more word is one that is known with the next word.
    begins, known = np.flatnonzero(good), at[good]
    labels = np.column_stack((frequent >> 32, frequent & 0xFFFFFFFF))
    found, counts = [], []
    for size in range(3, longest + 1):
        more = begins + size - 2 < len(good)
        begins, known = begins[more], known[more]
        more = good[begins + size - 2]
        begins, known = begins[more], known[more]
        keys, known, many = np.unique(known << 32 | batch.words[begins + size - 1], return_inverse=True, return_counts=True)
        labels = np.column_stack((labels[keys >> 32], keys & 0xFFFFFFFF))
        found.append(np.pad(labels, ((0, 0), (0, longest - size)), constant_values=-1))
        counts.append(many)
    if not found:
        return _MESSAGE.empty_table()
    phrases, counts = np.concatenate(found), np.concatenate(counts)
    order = _order(phrases)
    phrases, counts = phrases[order], counts[order]
    return _messages(rows.column("batch")[0].as_py(), np.where(phrases < 0, -1, batch.ids[phrases]), counts, ranges)


_UNITED = pa.schema([("phrase", pa.list_(pa.int64())), ("f", pa.int64()), ("sender", pa.int64())])
_UNITED_SQL = "phrase array<long>, f long, sender long"


def _unite(rows: pa.Table, minimum: int, longest: int, answer: bool) -> pa.Table:
    """Frequent phrases of a range with their counts and, if answer, for each sender those that it has, one after the other."""
    automata = [Counts.from_bytes(x) for x in rows.column("data").to_pylist()]
    phrases, f = united(automata, longest)
    phrases, f = phrases[f >= minimum], f[f >= minimum]
    used = phrases >= 0
    parts = [pa.Table.from_arrays([_lists(phrases[used], np.cumsum(used.sum(axis=1))), pa.array(f), pa.nulls(len(f), pa.int64())], schema=_UNITED)]
    if answer and len(phrases):
        frequent = Counts.build(phrases, f)
        for sender, own in zip(rows.column("sender").to_pylist(), automata, strict=True):
            mine, weight = own.compose(frequent)
            mine = mine[weight > 0]
            if len(mine):
                parts.append(pa.Table.from_arrays([pa.array([mine.ravel()], _UNITED.field("phrase").type), pa.array([None], pa.int64()), pa.array([sender])], schema=_UNITED))
    return pa.concat_tables(parts)


def _matrix(column: pa.ChunkedArray, longest: int) -> np.ndarray:
    """Phrases of a list column, filled up with -1."""
    lists = column.combine_chunks()
    lists = lists if not isinstance(lists, pa.ChunkedArray) else pa.concat_arrays(lists.chunks)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(size), longest), -1)
    out[np.arange(longest) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _parts(phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every cut of every phrase of two words or more: the row, words before the cut, the first part, the rest."""
    longest = phrases.shape[1]
    size = (phrases >= 0).sum(axis=1)
    rows, cuts, left, right = [], [], [], []
    for k in range(1, longest):
        at = np.flatnonzero(size > k)
        a, b = np.full((len(at), longest), -1), np.full((len(at), longest), -1)
        a[:, :k], b[:, : longest - k] = phrases[at, :k], phrases[at, k:]
        for whole, x in ((rows, at), (cuts, np.full(len(at), k)), (left, a), (right, b)):
            whole.append(x)
    return tuple(map(np.concatenate, (rows, cuts, left, right)))


def _distinct(rows: np.ndarray) -> np.ndarray:
    rows = rows[_order(rows)]
    return rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))] if len(rows) else rows


def _ask_parts(key, rows: pa.Table, ranges: int, longest: int) -> pa.Table:
    """Automata of the distinct parts of a range's candidates, one for each range that knows them."""
    _, _, left, right = _parts(_matrix(rows.column("phrase"), longest))
    asked = _distinct(np.concatenate((left, right)))
    return _messages(key[0].as_py(), asked, np.ones(len(asked), np.int64), ranges)


def _automaton(rows: pa.Table, longest: int) -> Counts:
    phrases, f = _matrix(rows.column("phrase"), longest), rows.column("f").to_numpy()
    order = _order(phrases)
    return Counts.build(phrases[order], f[order])


def _answer_parts(asked: pa.Table, known: pa.Table, longest: int) -> pa.Table:
    counts = _automaton(known, longest)
    out = []
    for sender, data in zip(asked.column("sender").to_pylist(), asked.column("data").to_pylist(), strict=True):
        phrases, f = Counts.from_bytes(data).compose(counts)
        out.append((sender, sender, Counts.build(phrases, f).to_bytes()))
    columns = zip(*out, strict=True) if out else ([], [], [])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MESSAGE, strict=True)], schema=_MESSAGE)


_CUT = pa.schema([("phrase", pa.list_(pa.int64())), ("a", pa.int64()), ("k", pa.int32()), ("l", pa.int64()), ("r", pa.int64())])
_CUT_SQL = "phrase array<long>, a long, k int, l long, r long"


def _cuts(answers: pa.Table, rows: pa.Table, longest: int) -> pa.Table:
    """Every cut of a range's candidates with the counts of both parts."""
    phrases, f = united([Counts.from_bytes(x) for x in answers.column("data").to_pylist()], longest) if answers.num_rows else (np.zeros((0, longest), np.int64), np.zeros(0, np.int64))
    known = Counts.build(phrases, f)
    column = rows.column("phrase").combine_chunks()
    row, k, left, right = _parts(_matrix(rows.column("phrase"), longest))

    def weights(parts: np.ndarray) -> np.ndarray:
        order = _order(parts)
        begins = np.concatenate(([True], (parts[order][1:] != parts[order][:-1]).any(axis=1))) if len(parts) else np.zeros(0, bool)
        _, found = Counts.build(parts[order][begins], np.ones(int(begins.sum()), np.int64)).compose(known)
        out = np.empty(len(parts), np.int64)
        out[order] = found[np.cumsum(begins) - 1]
        return out

    a = rows.column("f").to_numpy()
    return pa.Table.from_arrays(
        [column.take(pa.array(row)), pa.array(a[row]), pa.array(k, pa.int32()), pa.array(weights(left)), pa.array(weights(right))], schema=_CUT
    )


def collocations(docs: DataFrame, minimum: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """The phrases of 2 to longest words that score highest in each language.

    docs: text (null: empty) and lang (null: `und`); other columns are ignored, repeated rows count. A-Z are lower-cased,
    texts cut at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words `[^\\x20\\x09]+`. n counts all words of a language,
    f(phrase) all its occurrences within pieces. A candidate has a = f >= minimum. Cut after its first k words it has
    l = f(first part), r = f(rest) and the score floor(1000 a n / (l r)); the lowest-scoring cut counts, of equal ones the one
    with least k. Candidates within a longer one that is as frequent are dropped. Returns lang, rank (from 1), phrase, a, l, r,
    n, score: no more than top rows for each language, by score and a from high to low, then by phrase in byte order. An empty
    table gives no rows. Counts are exact.
    """
    spark = docs.sparkSession
    ship(spark)
    ranges = partitions_for(spark, text_bytes(docs), RANGE_BYTES)
    batches = staged(docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(_code_batches, _BATCH_SQL), "phrases-batches")
    sent = batches.select("batch", "words").mapInArrow(lambda b: _word_messages(b, ranges), _MESSAGE_SQL)
    words = staged(sent.groupBy("range").applyInArrow(lambda key, rows: _unite_words(key, rows, minimum), _WORDS_SQL), "phrases-words")
    totals = words.filter("id is null and sender is null").groupBy("lang").agg(F.sum("f").alias("n"))
    known = words.filter("id is not null").select("id", "lang", "word", "f")
    own = words.filter("sender is not null").select(F.col("sender").alias("asker"), "data", F.lit(None).cast("array<long>").alias("pairs"))
    coded = batches.select("batch", "coded").groupBy("batch")
    sent = own.groupBy("asker").cogroup(coded).applyInArrow(lambda a, b: _pair_messages(a, b, ranges), _MESSAGE_SQL)
    pairs = staged(sent.groupBy("range").applyInArrow(lambda rows: _unite(rows, minimum, 2, True), _UNITED_SQL), "phrases-pairs")
    told = pairs.filter("sender is not null").select(F.col("sender").alias("asker"), F.lit(None).cast("binary").alias("data"), F.col("phrase").alias("pairs"))
    sent = own.unionByName(told).groupBy("asker").cogroup(coded).applyInArrow(lambda a, b: _longer_messages(a, b, ranges, longest), _MESSAGE_SQL)
    longer = sent.groupBy("range").applyInArrow(lambda rows: _unite(rows, minimum, longest, False), _UNITED_SQL)
    found = known.select(F.array("id").alias("phrase"), "f").unionByName(pairs.filter("sender is null").select("phrase", "f")).unionByName(longer.select("phrase", "f"))

    def with_range(batches):
        for batch in batches:
            to = _range_of(_matrix(pa.chunked_array([batch.column("phrase")]), longest), ranges)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *batch.columns], ["range", "phrase", "f"])

    found = staged(found.mapInArrow(with_range, "range int, phrase array<long>, f long"), "phrases-counts")
    candidates = found.filter(F.size("phrase") > 1)
    # A phrase within a longer one as frequent is within one that is a single word longer and as frequent.
    size = F.size("phrase")
    inner = candidates.filter(size > 2).select("f", F.explode(F.array(F.slice("phrase", F.lit(1), size - 1), F.slice("phrase", F.lit(2), size - 1))).alias("phrase"))
    candidates = candidates.join(inner.distinct(), ["phrase", "f"], "left_anti")
    candidates = staged(candidates.select(F.col("range").cast("long").alias("home"), F.col("phrase"), F.col("f")), "phrases-candidates")
    by_home = candidates.groupBy("home")
    asked = by_home.applyInArrow(lambda key, rows: _ask_parts(key, rows, ranges, longest), _MESSAGE_SQL)
    answers = asked.withColumnRenamed("range", "to").groupBy("to").cogroup(found.groupBy("range")).applyInArrow(lambda a, b: _answer_parts(a, b, longest), _MESSAGE_SQL)
    cuts = answers.groupBy("sender").cogroup(by_home).applyInArrow(lambda a, b: _cuts(a, b, longest), _CUT_SQL)
    first = known.select("id", "lang")
    cuts = cuts.join(first, F.element_at("phrase", 1) == F.col("id")).join(totals, "lang")
    scored = cuts.withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    spelled = lowest.select("lang", "phrase", "a", "n", "x.score", "x.l", "x.r", F.posexplode("phrase").alias("at", "id")).join(known.select("id", "word"), "id")
    spelled = spelled.groupBy("lang", "phrase", "a", "n", "score", "l", "r").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    spelled = spelled.withColumn("phrase", F.array_join(F.col("w.word"), " ")).drop("w")
    # The best of each of SALTS shares of a language, then the best of those.
    best = [F.desc("score"), F.desc("a"), "phrase"]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = spelled.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
