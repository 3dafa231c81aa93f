"""Repeated passages across documents, from enhanced suffix arrays over blocks that share an anchor.

Every window of `length` bytes holds an anchor: the smallest hash among its substrings of ANCHOR bytes. Equal windows have
equal anchors, so blocks of neighbouring windows with one anchor can be dealt by it, and all copies of a window meet in one
task. There, suffixes that start at windows are sorted; their common prefixes give an interval tree, scanned with a stack. An
interval whose suffixes are all preceded by the same byte is part of the longer one that begins there, and is passed over.

Removal takes its spans from these intervals. A block that several documents have whole is such an interval before any
sorting: identical suffixes up to the block's end; it is recognised by its hash, so that copies collapse before the shuffle.
For the maximal repeats of whole texts, intervals that reach the end of what has been compared go on with longer slices.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predial.llm.common import (
    discard, mix64, pack, partitions_for, powers, range_keys, runs, salted, sorted_groups, staged, text_batches, text_bytes, unpack, whole_ids,
)

LENGTH = 50
ANCHOR = 20
#: Windows in a block at most.
BLOCK = 64
_STEP = 1 << 19
#: Blocks of an anchor that are held in one task; those of one with more different ones pass through and are dealt by their
#: single windows instead.
HOT = 20_000
#: Blocks that are held before equal ones are collapsed.
HELD = 1 << 20
#: Bytes that maximal repeats are compared by in the first round, and at most; different slices of a group in one task.
FIRST_SLICE, LAST_SLICE, SLICES = 256, 1 << 16, 50_000
_G = np.uint64((1 << 48) - 1)
_LAST = np.int64(2**63 - 1)


def blocks(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Blocks of windows with one anchor in concatenated texts: begin, number of windows, anchor, hash of the bytes."""
    width, found = length - ANCHOR + 1, []
    for at in range(0, max(len(raw) - length + 1, 0), _STEP):
        part = raw[at : at + _STEP + length - 1]
        up, down = powers(len(part) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part + np.uint64(1)) * up[: len(part)])))
        grams = (sums[ANCHOR:] - sums[:-ANCHOR]) * down[: len(part) - ANCHOR + 1]
        grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
        span = 1
        while 2 * span <= width:
            grams = np.minimum(grams[:-span], grams[span:])
            span *= 2
        if span < width:
            rest = width - span
            grams = np.minimum(grams[:-rest], grams[rest:])
        n = len(grams)
        here = np.arange(at, at + n)
        r = slice(int(np.searchsorted(offsets, at, "right")) - 1, int(np.searchsorted(offsets, at + n, "left")))
        last = np.repeat(offsets[1:][r] - length, np.diff(np.clip(offsets[r.start : r.stop + 1], at, at + n)))
        valid = here <= last  # windows that end within their text
        new = np.concatenate(([True], grams[1:] != grams[:-1])) | np.concatenate(([True], ~valid[:-1]))
        new[offsets[(offsets >= at) & (offsets < at + n)] - at] = True
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        new |= (np.arange(n) - start) % BLOCK == 0
        first = np.flatnonzero(new & valid)
        stop = np.flatnonzero(np.append(new, True) | np.append(~valid, True))
        count = stop[np.searchsorted(stop, first, "right")] - first
        ends = first + count + length - 1
        whole = mix64((sums[ends] - sums[first]) * down[first] + count.astype(np.uint64))
        found.append((first + at, count, mix64(grams[first]), whole & _G))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def _deal(keys: np.ndarray, n: int) -> np.ndarray:
    """The part of n of each hash, in the hashes' order."""
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


#: Numbers that spread documents over parts, here and in Job.dealt().
_PRIME, _FACTOR = 2**31 - 1, 1540483477


def _doc_part(doc: np.ndarray, mark: np.ndarray, n: int) -> np.ndarray:
    return ((doc % _PRIME * _FACTOR + (mark & 0xFFFFFFFF) & 0xFFFFFFFF) * n >> 32).astype(np.int64)


_ROW = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("data", pa.binary())])
_SCHEMA = "part int, kind tinyint, data binary"


def _rows(parts: list[int], kind: int, data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([kind] * len(parts), pa.int8()), pa.array(data, pa.binary())], schema=_ROW)


def _split(part: np.ndarray, kind: int, *arrays: np.ndarray) -> pa.RecordBatch:
    """One packed row for each part that occurs; the arrays' rows are put in the parts' order, which is stable."""
    order = np.argsort(part, kind="stable")
    part, arrays = part[order], [a[order] for a in arrays]
    found = runs(part)
    return _rows([int(part[i]) for i, _ in found], kind, [pack(*(a[i:j] for a in arrays)) for i, j in found])


def _spans(doc: np.ndarray, mark: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of each (doc, mark), sorted, with overlapping and touching ones merged."""
    order = np.lexsort((begin, mark, doc))
    doc, mark, begin, end = doc[order], mark[order], begin[order], end[order]
    if not len(doc):
        return doc, mark, begin, end
    other = np.concatenate(([True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])))
    row = np.cumsum(other) - 1
    reach = np.maximum.accumulate(end + row * (1 << 40)) - row * (1 << 40)
    new = other | np.concatenate(([True], begin[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return doc[at], mark[at], begin[at], np.maximum.reduceat(end, at)


KEYED, SPANS, NEEDED, BLOCKS, OCCURS, STARTS = range(6)


def _found_blocks(batches, parts: int, length: int, maximal: bool):
    """Blocks of whole documents, dealt by anchor. Of equal blocks only the smallest document's are sent on. For removal, all
    windows in the others are known to be repeats already, which is sent as spans. For maximal repeats, all occurrences are
    sent apart, and with each block its number and the least and greatest byte before them (-1: a text's beginning)."""
    for table in text_batches(batches, 16 << 20):
        raw, offsets = _bytes_of(table.column("text").combine_chunks())
        doc, mark = (table.column(c).to_numpy().astype(np.int64) for c in ("doc", "mark"))
        begin, count, anchor, whole = blocks(raw, offsets, length)
        row = np.searchsorted(offsets, begin, "right") - 1
        left = np.where(begin > offsets[row], raw[np.maximum(begin - 1, 0)] if len(raw) else 0, 0).astype(np.int16) - (begin == offsets[row])
        begin = begin - offsets[row]
        order = np.lexsort((doc[row], whole, anchor))
        row, begin, count, anchor, whole, left = (x[order] for x in (row, begin, count, anchor, whole, left))
        more: list[np.ndarray] = []
        if len(row):
            at = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]))))
            n = np.diff(np.append(at, len(row)))
            if maximal:
                part = _deal(anchor, parts)
                for i, j in runs(part):
                    yield _rows([int(part[i])], OCCURS, [pack(np.diff(anchor[i:j], prepend=np.uint64(0)), whole[i:j], doc[row[i:j]], mark[row[i:j]], begin[i:j].astype(np.uint32), left[i:j])])
                more = [n, np.minimum.reduceat(left, at), np.maximum.reduceat(left, at)]
                row, begin, count, anchor, whole = (x[at] for x in (row, begin, count, anchor, whole))
            else:
                later = doc[row] > np.repeat(doc[row[at]], n)
                d = row[later]
                spans = _spans(doc[d], mark[d], begin[later], begin[later] + count[later] + length - 1)
                if len(spans[0]):
                    part = _deal(mix64(spans[0].view(np.uint64)), parts)  # any part will do: the next step passes them on
                    yield _split(part, SPANS, *spans)
                row, begin, count, anchor, whole = (x[~later] for x in (row, begin, count, anchor, whole))
        part = _deal(anchor, parts)
        for i, j in runs(part):
            rows, place = np.unique(row[i:j], return_inverse=True)
            by_doc = np.argsort(doc[rows], kind="stable")
            rank = np.empty(len(rows), np.int64)
            rank[by_doc] = np.arange(len(rows))
            data = pack(
                np.diff(anchor[i:j], prepend=np.uint64(0)), whole[i:j], rank[place].astype(np.uint32),
                begin[i:j].astype(np.uint32), count[i:j].astype(np.uint8),
                np.diff(doc[rows[by_doc]], prepend=np.int64(0)), mark[rows[by_doc]], *(x[i:j] for x in more),
            )
            yield _rows([int(part[i])], KEYED, [data])


#: The arrays of a block: anchor, hash, document and mark of the one that stands for equal ones, begin, windows; for maximal
#: repeats also the number of equal ones and the least and greatest byte before them.
def _merged(held: list[list[np.ndarray]], maximal: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Blocks in the order of anchor, hash and document, of equal ones the first; and for removal the others."""
    arrays = [np.concatenate(x) for x in zip(*held, strict=True)]
    order = np.lexsort((arrays[2], arrays[1], arrays[0]))
    arrays = [x[order] for x in arrays]
    anchor, whole, doc = arrays[:3]
    at = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]))))
    if maximal:
        n, low, high = (f.reduceat(x, at) for f, x in zip((np.add, np.minimum, np.maximum), arrays[6:], strict=True))
        return [*(x[at] for x in arrays[:6]), n, low, high], []
    later = doc > np.repeat(doc[at], np.diff(np.append(at, len(doc))))
    return [x[~later] for x in arrays], [x[later] for x in arrays]


def _compare_blocks(batches, parts: int, doc_parts: int, length: int, maximal: bool):
    """Blocks with one anchor. For removal, equal ones of later documents become spans; where different blocks of several
    documents remain, they are needed in full. For maximal repeats, different blocks are needed, and a block that is the only
    one of its anchor is the start of a repeat if it occurs behind different bytes.

    An anchor with over HOT different blocks is not held: its blocks pass through, to be compared window by window."""
    held: list[list[np.ndarray]] = []
    hot, size = np.zeros(0, np.uint64), 0

    def needed(found: list[np.ndarray], is_hot: bool):
        anchor, whole, doc, mark, begin, count, *more = found
        if len(anchor):
            more = [whole, *more] if maximal else more
            yield _split(_doc_part(doc, mark, doc_parts), NEEDED, doc, mark, begin, count.astype(np.uint8), anchor, np.full(len(anchor), is_hot), *more)

    def spans(later: list[np.ndarray]):
        if later and len(later[0]):
            _, _, doc, mark, begin, count = later
            out = _spans(doc, mark, begin, begin + count + length - 1)
            yield _split(_doc_part(out[0], out[1], doc_parts), SPANS, *out)

    for batch in batches:
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
            got = unpack(data.as_py())
            if kind == SPANS:
                yield _split(_doc_part(got[0], got[1], doc_parts), SPANS, *got)
                continue
            if kind == OCCURS:
                continue
            steps, whole, place, begin, count, docs, marks, *more = got
            docs = np.cumsum(docs)
            found = [np.cumsum(steps), whole, docs[place], marks[place], begin.astype(np.int64), count.astype(np.int64), *more]
            passing = np.isin(found[0], hot)
            if passing.any():
                yield from needed([x[passing] for x in found], True)
                found = [x[~passing] for x in found]
            held.append(found)
            size += len(found[0])
        if size > HELD:
            found, later = _merged(held, maximal)
            yield from spans(later)
            at = sorted_groups(found[0])
            many = np.diff(np.append(at, len(found[0]))) > HOT
            hot = np.union1d(hot, found[0][at[many]])
            passing = np.isin(found[0], hot)
            yield from needed([x[passing] for x in found], True)
            held = [[x[~passing] for x in found]]
            size = len(held[0][0]) // 2  # what is different stays, so that it is not sorted again and again
    if not held:
        return
    found, later = _merged(held, maximal)
    held.clear()
    yield from spans(later)
    if not len(found[0]):
        return
    anchor, doc = found[0], found[2]
    at = sorted_groups(anchor)
    n = np.diff(np.append(at, len(anchor)))
    several = n > 1 if maximal else np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)
    is_hot = np.repeat(n > HOT, n)
    several = np.repeat(several, n)
    for h in (False, True):
        yield from needed([x[several & (is_hot == h)] for x in found], h)
    if maximal:
        # A block that passed through has an entry of its own for each task that sent it; see _starts().
        low, high = found[7], found[8]
        alone = ~several & (found[6] > 1) & ((low != high) | (low < 0))
        if alone.any():
            a, w = anchor[alone], found[1][alone]
            yield _split(_deal(a, parts), STARTS, mix64(a ^ mix64(w)), a, w, np.zeros(len(a), np.uint8), np.full(len(a), -2, np.int16))


def _gather(table: pa.Table, kind: int, n: int) -> list[np.ndarray]:
    rows = table.filter(pc.equal(table.column("kind"), kind)).column("data").to_pylist()
    got = [unpack(x) for x in rows]
    kinds = (np.int64, np.int64, np.int64, np.int64 if n == 4 else np.uint8, np.uint64, bool, np.uint64, np.int64, np.int16, np.int16)[:n]
    return [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.zeros(0, k) for k in kinds]


def _rows_of(texts: pa.Table, doc: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an entry of (doc, mark) and a row of texts with the same key, however often rows repeat."""
    d, m = (texts.column(c).to_numpy().astype(np.int64) for c in ("doc", "mark"))
    order = np.lexsort((m, d))
    known = np.zeros(len(d), [("d", "<i8"), ("m", "<i8")])
    known["d"], known["m"] = d[order], m[order]
    asked = np.zeros(len(doc), known.dtype)
    asked["d"], asked["m"] = doc, mark
    a, b = np.searchsorted(known, asked, "left"), np.searchsorted(known, asked, "right")
    n = b - a
    ends = np.cumsum(n)
    return np.repeat(np.arange(len(doc)), n), order[np.repeat(a - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def _texts_of(rows: pa.Table) -> pa.Array:
    column = rows.column("row").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pc.struct_field(column, "text")


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All the numbers of the ranges, one range behind the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _fetch_blocks(needed: pa.Table, texts: pa.Table, parts: int, length: int, maximal: bool):
    """The bytes of needed blocks, and the byte before each, dealt by anchor; blocks of hot anchors as single windows, dealt by
    their bytes, of which for removal only the smallest document's is sent on and the others become spans."""
    found = _gather(needed, NEEDED, 10 if maximal else 6)
    raw, offsets = _bytes_of(_texts_of(texts))
    # Of rows that are equal in doc and mark, one is enough.
    entry, row = _rows_of(texts, found[0], found[1])
    first = np.concatenate(([True], entry[1:] != entry[:-1])) if len(entry) else np.zeros(0, bool)
    entry, row = entry[first], row[first]
    doc, mark, begin, count, anchor, hot, *more = (x[entry] for x in found)
    count = count.astype(np.int64)
    times = np.where(hot, count, 1)
    pick = np.repeat(np.arange(len(doc)), times)
    nth = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
    block_anchor = anchor[pick]
    doc, mark, anchor, hot, row, *more = (x[pick] for x in (doc, mark, anchor, hot, row, *more))
    begin, count = begin[pick] + np.where(hot, nth, 0), np.where(hot, 1, count[pick])
    source = offsets[row] + begin
    for at in np.flatnonzero(hot).tolist():
        digest = hashlib.blake2b(raw[source[at] : source[at] + length].tobytes(), digest_size=8).digest()
        anchor[at] = np.frombuffer(digest, np.uint64)[0]
    before = np.where(begin > 0, raw[np.maximum(source - 1, 0)] if len(raw) else 0, 0).astype(np.int16) - (begin == 0)
    out = []
    if maximal:
        # Which block a window is of, and its place there; what comes before a block's first window is known of all its copies.
        n, low, high = more[1:]
        inner = np.where(hot, nth, 0) > 0
        more = [block_anchor, more[0], np.where(hot, nth, 0).astype(np.uint8), n, np.where(inner, before, low), np.where(inner, before, high)]
    elif hot.any():
        h = np.flatnonzero(hot)
        h = h[np.lexsort((doc[h], anchor[h]))]
        at = sorted_groups(anchor[h])
        later = h[doc[h] > np.repeat(doc[h[at]], np.diff(np.append(at, len(h))))]
        spans = _spans(doc[later], mark[later], begin[later], begin[later] + length)
        if len(spans[0]):
            out.append(_split(_deal(mix64(spans[0].view(np.uint64)), parts), SPANS, *spans))
        keep = np.ones(len(doc), bool)
        keep[later] = False
        doc, mark, anchor, begin, count, source, before = (x[keep] for x in (doc, mark, anchor, begin, count, source, before))
    part = _deal(anchor, parts)
    order = np.lexsort((anchor, part))
    for i, j in runs(part[order]):
        o = order[i:j]
        size = count[o] + length - 1
        data = pack(
            np.diff(anchor[o], prepend=np.uint64(0)), doc[o], mark[o], begin[o].astype(np.uint32), count[o].astype(np.uint8),
            before[o].astype(np.int16), raw[_ranges(source[o], size)], *(x[o] for x in more),
        )
        out.append(_rows([int(part[o[0]])], BLOCKS, [data]))
    return pa.Table.from_batches(out, _ROW)


def suffix_array(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, anchor: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes raw[start:end] (at most depth bytes each) within equal anchors, and the common prefix of each
    with the one before it (0 across anchors)."""
    padded = np.concatenate((raw, np.zeros(depth + 8, np.uint8)))
    size = np.minimum(ends - starts, depth)
    columns = []
    for at in range(0, depth, 8):
        word = np.zeros(len(starts), np.uint64)
        for i in range(8):
            byte = padded[starts + at + i].astype(np.uint64)
            word = word << np.uint64(8) | np.where(size > at + i, byte, np.uint64(0))
        columns.append(word)
    order = np.lexsort((size, *columns[::-1], anchor))
    common, open_ = np.zeros(len(order), np.int64), np.ones(max(len(order) - 1, 0), bool)
    for column in columns:
        x = column[order]
        differ = x[1:] ^ x[:-1]
        same = np.zeros(len(differ), np.int64)
        for i in range(8):
            same += (differ >> np.uint64(56 - 8 * i)) == 0
        common[1:] += np.where(open_, same, 0)
        open_ &= differ == 0
    if len(order):
        common[1:] = np.minimum(common[1:], np.minimum(size[order][1:], size[order][:-1]))
        common[1:][anchor[order][1:] != anchor[order][:-1]] = 0
    return order, common


def intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """All intervals [a, b) of the suffix array whose suffixes share a prefix of at least `least` bytes that none of a larger
    interval share: (a, b, length), by one scan with a stack."""
    found, stack = [], []
    ends = np.flatnonzero(np.append(common[1:], -1) < least) + 1 if len(common) else []
    begin = 0
    for end in ends:
        if end - begin > 1:  # a run whose neighbours share least bytes; the tree above it
            stack = [(int(common[begin + 1]), begin)]
            for i in range(begin + 2, end):
                length, left = int(common[i]), i - 1
                while stack and stack[-1][0] > length:
                    top, left = stack.pop()
                    found.append((left, i, top))
                if not stack or stack[-1][0] < length:
                    stack.append((length, left))
            while stack:
                top, left = stack.pop()
                found.append((left, int(end), top))
        begin = int(end)
    return found


class Windows:
    """The windows of blocks that meet in a task: those that occur in several blocks of the same anchor, and those picked
    by `also`, in the order of their suffixes; common: the common prefix of each with the one before."""

    def __init__(self, held: list[list[np.ndarray]], length: int, also=None):
        anchor, doc, mark, begin, count, before, raw, *more = (np.concatenate(x) for x in zip(*held, strict=True))
        count, begin = count.astype(np.int64), begin.astype(np.int64)
        size = count + length - 1
        at = np.cumsum(size) - size
        block = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
        start = at[block] + nth
        keys = mix64(range_keys(raw, start, start + length) ^ anchor[block])
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        twin = np.zeros(len(k), bool)
        if len(k) > 1:
            twin[1:] = k[1:] == k[:-1]
            twin[:-1] |= k[1:] == k[:-1]
        picked = np.zeros(len(k), bool)
        picked[order[twin]] = True
        if also is not None:
            picked |= also(block, nth, *more)
        pick = np.flatnonzero(picked)
        block, nth, start = block[pick], nth[pick], start[pick]
        order, self.common = suffix_array(raw, start, (at + size)[block], anchor[block], BLOCK + length - 1)
        self.block, self.nth, self.start = block[order], nth[order], start[order]
        self.doc, self.mark, self.begin = doc[self.block], mark[self.block], begin[self.block] + self.nth
        self.left = np.where(self.nth > 0, raw[np.maximum(self.start - 1, 0)] if len(raw) else 0, before[self.block]).astype(np.int64)
        self.raw, self.more = raw, more


def _held(batches):
    held, passed = [], []
    for batch in batches:
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
            got = unpack(data.as_py())
            if kind == SPANS:
                passed.append(got)
            else:
                held.append([np.cumsum(got[0]), *got[1:]])
    return held, passed


def _compare_windows(batches, doc_parts: int, length: int):
    """Spans of the intervals of suffixes: what a document has of a smaller one."""
    held, passed = _held(batches)
    for got in passed:
        yield _split(_doc_part(got[0], got[1], doc_parts), SPANS, *got)
    if not held:
        return
    w = Windows(held, length)
    # An interval that only continues others is preceded by one byte, within its blocks: those others cover it.
    changes = np.concatenate(([0], np.cumsum(w.left[1:] != w.left[:-1]))) if len(w.left) else np.zeros(0, np.int64)
    firsts = np.concatenate(([0], np.cumsum(w.nth == 0)))
    reach = np.zeros(len(w.doc), np.int64)
    for a, b, size in intervals(w.common, length):
        if changes[b - 1] > changes[a] or firsts[b] > firsts[a]:
            docs = w.doc[a:b]
            reach[a:b] = np.maximum(reach[a:b], np.where(docs > docs.min(), size, 0))
    later = reach > 0
    spans = _spans(w.doc[later], w.mark[later], w.begin[later], w.begin[later] + reach[later])
    if len(spans[0]):
        yield _split(_doc_part(spans[0], spans[1], doc_parts), SPANS, *spans)


def _starts(batches, parts: int, length: int):
    """Windows that begin maximal repeats: those that occur behind different bytes, or at a text's beginning. Each is told by
    its block and its place there, so that all occurrences can be found."""
    held, _ = _held(batches)
    if not held:
        return
    # Alone, a block's first window begins a repeat if what comes before the block's copies differs.
    w = Windows(held, length, lambda block, nth, a, h, place, n, low, high: (nth == 0) & (n[block] > 1) & ((low[block] != high[block]) | (low[block] < 0)))
    if not len(w.doc):
        return
    anchor, whole, place, n, low, high = w.more
    low, high = (np.where(w.nth > 0, w.left, x[w.block]) for x in (low, high))
    at = sorted_groups(np.cumsum(w.common < length))
    size = np.diff(np.append(at, len(w.doc)))
    total, least, most = np.add.reduceat(n[w.block], at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
    good = np.repeat((total > 1) & ((least != most) | (least < 0)), size)
    group = np.repeat(range_hashes(w.raw, w.start[at], length), size)[good]
    a, h, nth = anchor[w.block][good], whole[w.block][good], (place[w.block] + w.nth)[good]
    left = np.where(nth > 0, w.left[good], -2).astype(np.int16)  # -2: each copy's own
    yield _split(_deal(a, parts), STARTS, group, a, h, nth.astype(np.uint8), left)


def range_hashes(raw: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of byte ranges in any order."""
    return np.array([int.from_bytes(hashlib.blake2b(raw[i : i + length].tobytes(), digest_size=8).digest(), "little") for i in start.tolist()], np.uint64)


def _occurrences(starts: pa.Table, occurs: pa.Table) -> pa.Table:
    """All occurrences of the windows that begin maximal repeats: group, doc, mark, begin, left."""
    kinds = (np.uint64, np.uint64, np.uint64, np.uint8, np.int16)
    got = [unpack(x) for x in starts.column("data").to_pylist()]
    group, anchor, whole, nth, left = [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.zeros(0, k) for k in kinds]
    key = np.rec.fromarrays([anchor, whole, nth, group], names="a,h,n,g")
    _, first = np.unique(key, return_index=True)
    group, anchor, whole, nth, left = (x[first] for x in (group, anchor, whole, nth, left))
    asked = np.rec.fromarrays([anchor, whole], names="a,h")
    out = [[], [], [], [], []]
    for data in occurs.column("data").to_pylist():
        steps, hashes, doc, mark, begin, before = unpack(data)
        known = np.rec.fromarrays([np.cumsum(steps), hashes], names="a,h")  # sorted
        i, j = np.searchsorted(known, asked, "left"), np.searchsorted(known, asked, "right")
        n = j - i
        ends = np.cumsum(n)
        of = np.repeat(np.arange(len(asked)), n)
        at = np.repeat(i - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        values = (group[of].view(np.int64), doc[at], mark[at], begin[at].astype(np.int64) + nth[of], np.where(left[of] == -2, before[at], left[of]).astype(np.int32))
        for column, x in zip(out, values, strict=True):
            column.append(x)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    return pa.Table.from_arrays([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, types, strict=True)], ["group", "doc", "mark", "begin", "left"])


_MEMBER = "group long, doc long, mark long, begin long, left int"


def _slices(members: pa.Table, texts: pa.Table, depth: int, size: int) -> pa.Table:
    """members with what their texts go on with: size bytes from depth bytes behind their beginning on."""
    raw, offsets = _bytes_of(_texts_of(texts))
    entry, row = _rows_of(texts, *(members.column(c).to_numpy() for c in ("doc", "mark")))
    first = np.concatenate(([True], entry[1:] != entry[:-1])) if len(entry) else np.zeros(0, bool)
    entry, row = entry[first], row[first]
    members = members.select(["group", "doc", "mark", "begin", "left"]).take(pa.array(entry))
    a = np.minimum(offsets[row] + members.column("begin").to_numpy() + depth, offsets[row + 1])
    b = np.minimum(a + size, offsets[row + 1])
    return members.append_column("slice", pa.array([raw[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()))


_NODE = "group long, slice binary, repeat long, length long, next long"


def _group_tree(table: pa.Table, depth: int, size: int, least: int) -> pa.Table:
    """The intervals of one group's slices, whose texts agree in depth bytes before: a row for each slice of each interval that
    is a maximal repeat (repeat, length), and one for each slice that goes on in a group of its own (next)."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("slice", "n", "low", "high")), strict=True))
    group = table.column("group")[0].as_py()
    n, low, high = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
    common = np.zeros(len(rows), np.int64)
    for i in range(1, len(rows)):
        x, y = (np.frombuffer(rows[k][0], np.uint8) for k in (i - 1, i))
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[:m] != y[:m])
        common[i] = differ[0] if len(differ) else m
    out, serial = [], 0

    def name() -> int:
        nonlocal serial
        serial += 1
        return int.from_bytes(hashlib.blake2b(f"{group}|{depth}|{serial}".encode(), digest_size=8).digest(), "little", signed=True)

    def diverse(a: int, b: int) -> bool:
        return low[a:b].min() != high[a:b].max() or low[a:b].min() < 0

    for a, b, shared in intervals(common, max(least - depth, 0)):
        if diverse(a, b):
            repeat = name()
            out += [(rows[i][0], repeat, depth + shared, None) for i in range(a, b)]
    edges = np.append(common, 0)
    for i, (piece, *_) in enumerate(rows):
        if n[i] > 1 and diverse(i, i + 1):
            if len(piece) == size:
                out.append((piece, None, None, name()))
            elif len(piece) > max(edges[i] if i else -1, edges[i + 1] if i + 1 < len(rows) else -1) and depth + len(piece) >= least:
                out.append((piece, name(), depth + len(piece), None))  # copies that end with their texts
    piece, repeat, length, following = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.Table.from_arrays(
        [pa.array([group] * len(out), pa.int64()), pa.array(piece, pa.binary()), *(pa.array(x, pa.int64()) for x in (repeat, length, following))], ["group", "slice", "repeat", "length", "next"]
    )


def _tree_maker(depth: int, size: int, least: int):
    return lambda table: _group_tree(table, depth, size, least)


class Job:
    """The documents with their keys, and the sizes of the parts that they and the blocks are dealt into."""

    def __init__(self, docs: DataFrame, length: int, maximal: bool = False):
        self.length, self.maximal = length, maximal
        n_bytes = text_bytes(whole_ids(docs))
        self.parts = partitions_for(docs.sparkSession, n_bytes, 20 << 20)
        self.doc_parts = partitions_for(docs.sparkSession, n_bytes, 8 << 20)
        doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_LAST)))
        self.texts = docs.select(F.struct("*").alias("row"), doc.alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))

    def keyed(self) -> DataFrame:
        parts, length, maximal = self.parts, self.length, self.maximal
        return self.texts.select("doc", "mark", "row.text").mapInArrow(lambda b: _found_blocks(b, parts, length, maximal), _SCHEMA)

    def compared(self, keyed: DataFrame) -> DataFrame:
        """Spans or starts that equal blocks give, and the blocks that are needed in full; written once, read twice."""
        parts, doc_parts, length, maximal = self.parts, self.doc_parts, self.length, self.maximal
        found = keyed.repartitionById(parts, "part").mapInArrow(lambda b: _compare_blocks(b, parts, doc_parts, length, maximal), _SCHEMA)
        return staged(found, "repeat-blocks")

    def dealt(self):
        """The documents in groups by the part that their spans and needs are dealt to; see _doc_part()."""
        return self.texts.withColumn("part", self._part()).groupBy("part")

    def _part(self):
        mixed = (F.pmod("doc", F.lit(_PRIME)) * F.lit(_FACTOR) + F.col("mark").bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftright(mixed * F.lit(self.doc_parts), 32).cast("int")

    def fetched(self, compared: DataFrame) -> DataFrame:
        """The bytes of needed blocks, dealt by anchor."""
        parts, length, maximal = self.parts, self.length, self.maximal
        needed = compared.filter(F.col("kind") == NEEDED).groupBy("part")
        found = needed.cogroup(self.dealt()).applyInArrow(lambda a, b: _fetch_blocks(a, b, parts, length, maximal), _SCHEMA)
        return found.repartitionById(parts, "part")

    def spans(self) -> DataFrame:
        compared = self.compared(self.keyed())
        doc_parts, length = self.doc_parts, self.length
        inner = self.fetched(compared).mapInArrow(lambda b: _compare_windows(b, doc_parts, length), _SCHEMA)
        return compared.filter(F.col("kind") == SPANS).unionByName(inner)

    def members(self) -> DataFrame:
        """All occurrences of the windows that begin maximal repeats; those of equal windows share a group."""
        parts, length = self.parts, self.length
        keyed = staged(self.keyed(), "repeat-keys")
        compared = self.compared(keyed)
        inner = self.fetched(compared).mapInArrow(lambda b: _starts(b, parts, length), _SCHEMA)
        starts = compared.filter(F.col("kind") == STARTS).unionByName(inner)
        found = starts.groupBy("part").cogroup(keyed.filter(F.col("kind") == OCCURS).groupBy("part")).applyInArrow(_occurrences, _MEMBER)
        out = staged(found.distinct(), "repeat-members")
        discard(keyed, compared)
        return out

    def sliced(self, members: DataFrame, depth: int, size: int) -> DataFrame:
        dealt = members.withColumn("part", self._part()).groupBy("part").cogroup(self.dealt())
        return dealt.applyInArrow(lambda a, b: _slices(a, b, depth, size), f"{_MEMBER}, slice binary")


def _cut(spans: pa.Table, texts: pa.Table):
    """For each row of texts, its bytes and the sorted spans to take out of them."""
    raw, offsets = _bytes_of(_texts_of(texts))
    doc, mark, begin, end = _spans(*_gather(spans, SPANS, 4))
    entry, row = _rows_of(texts, doc, mark)
    order = np.argsort(row, kind="stable")
    entry, row = entry[order], row[order]
    bounds = np.searchsorted(row, np.arange(texts.num_rows + 1))
    for i in range(texts.num_rows):
        of = entry[bounds[i] : bounds[i + 1]]
        yield raw[offsets[i] : offsets[i + 1]], begin[of], end[of]


def _without(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    keep = np.ones(len(raw), bool)
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        keep[a:b] = False
    return raw[keep]


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """What removal of repeated bytes does to each document.

    docs: doc_id (an integer type, others raise; null: behind all others), text (null: empty) and any other columns. A byte goes if a string of length
    bytes that covers it also starts in a document with a smaller doc_id; rows with equal ids don't take from each other.
    Texts shorter than length keep all. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    job = Job(docs.select("doc_id", "text"), length)

    def report(spans: pa.Table, texts: pa.Table) -> pa.Table:
        rows = []
        for raw, begin, end in _cut(spans, texts):
            rows.append((len(raw), int((end - begin).sum()), len(begin), hashlib.sha256(_without(raw, begin, end).tobytes()).hexdigest()))
        ids = pc.struct_field(texts.column("row").combine_chunks(), "doc_id")
        n, removed, count, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.Table.from_arrays(
            [ids, *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(sha, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    found = job.spans().groupBy("part").cogroup(job.dealt())
    return found.applyInArrow(report, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, all columns, with repeated passages cut out of text; see removal_report().

    Cuts shrink to whole characters. n_chars, where there is such a column, is set to the new length; a null text without
    anything to remove stays null.
    """
    job, schema, names = Job(docs, length), docs.schema, docs.columns

    def cut(spans: pa.Table, texts: pa.Table) -> pa.Table:
        new, size = [], []
        old = _texts_of(texts).to_pylist()
        for text, (raw, begin, end) in zip(old, _cut(spans, texts), strict=True):
            if len(begin):
                follows = (raw & 0xC0) == 0x80  # bytes within a character
                starts = np.append(np.flatnonzero(~follows), len(raw))
                begin = starts[np.searchsorted(starts, begin, "left")]
                end = starts[np.searchsorted(starts, end, "right") - 1]
                text = _without(raw, begin, end).tobytes().decode()
            new.append(text)
            size.append(len(text or ""))
        row = texts.column("row").combine_chunks()
        columns = [pc.struct_field(row, [i]) for i in range(len(names))]
        columns[names.index("text")] = pa.array(new, pa.string())
        if "n_chars" in names:
            at = names.index("n_chars")
            columns[at] = pa.array(size, pa.int64()).cast(columns[at].type)
        return pa.Table.from_arrays(columns, names)

    found = job.spans().groupBy("part").cogroup(job.dealt())
    return found.applyInArrow(cut, schema)


def maximal_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Maximal repeats of at least length bytes, each with all its occurrences.

    docs: doc_id (an integer type; may be null or repeat), text (null: empty); other columns are ignored. A maximal repeat is
    a string that occurs at least twice, in one text or in several, and of which no longer one on either side occurs as often:
    its occurrences are not all preceded by the same byte, nor all followed by one; a text's beginning and end differ from all
    bytes. Rows that are equal in doc_id and text count once. Returns repeat_id, length, n_occurrences, doc_id, start (in
    bytes), one row per occurrence.

    Windows that begin repeats are found block by block. Their texts are then compared in slices that double: groups of
    equal slices go on as groups of their own, until none agree. A group with over SLICES different slices goes on by two
    bytes, which makes up to 65,536 groups of it; equal slices collapse before they meet.
    """
    job = Job(docs.select("doc_id", "text"), length, True)
    members, depth, size, found = job.members(), 0, FIRST_SLICE, []
    while not members.isEmpty():
        sliced = staged(job.sliced(members, depth, size), "repeat-slices")
        hot = sliced.select("group", "slice").distinct().groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") > SLICES).select("group")
        if not hot.isEmpty():
            # All groups take the short step then, so that every group of a round has the same depth.
            size = 2
            short = staged(sliced.withColumn("slice", F.substring("slice", 1, size)), "repeat-slices")
            discard(sliced)
            sliced = short
        kinds = sliced.groupBy("group", "slice").agg(F.count("*").alias("n"), F.min("left").alias("low"), F.max("left").alias("high"))
        nodes = kinds.groupBy("group").applyInArrow(_tree_maker(depth, size, length), _NODE)
        nodes = staged(nodes, "repeat-nodes")
        ended = nodes.filter("repeat is not null").join(sliced, ["group", "slice"]).select("repeat", "length", "doc", F.col("begin").alias("start"))
        found.append(staged(ended, "repeat-found"))
        going = salted(sliced, nodes.filter("next is not null").select("group", "slice", "next"), ["group", "slice"], F.struct("doc", "mark", "begin"))
        before, members = members, staged(going.select(F.col("next").alias("group"), "doc", "mark", "begin", "left"), "repeat-members")
        discard(before, sliced, nodes)
        depth, size = depth + size, min(max(2 * size, FIRST_SLICE), LAST_SLICE)
    spark = docs.sparkSession
    out = spark.createDataFrame([], "repeat long, length long, doc long, start long")
    for part in found:
        out = out.unionByName(part)
    counts = out.groupBy("repeat").agg(F.count("*").alias("n_occurrences"))
    doc_id = F.when(F.col("doc") != int(_LAST), F.col("doc")).alias("doc_id")
    named = out.join(counts, "repeat")
    return named.select(F.lower(F.hex("repeat")).alias("repeat_id"), "length", "n_occurrences", doc_id, "start")
