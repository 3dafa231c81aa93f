"""Packing of token pieces into windows by multiway differencing."""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from predial.llm.common import SPACES, Words, fresh, staged, text_batches

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 2
#: Tokens that are packed together in one task; windows never mix such groups.
GROUP_TOKENS = 1_500_000
#: What is left of a document behind its last full window is cut to at most so many ids: small pieces balance well.
TAIL = 1024


#: Three equal characters in a row, where the order of equal merges could matter.
_repeated = re.compile(r"(.)\1\1").search
_plain = re.compile(r"[^\W\d_]+[.,]?").fullmatch


class ChunkIds:
    """Ids of chunks of lower-case text that hold no white space, by the hash of the chunk."""

    LIMIT = 3_000_000

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words_only(path)
        self.forget()

    def forget(self) -> None:
        self.places: dict[int, int] = {}
        self.starts, self.counts, self.ids = (np.zeros(1 << 16, x) for x in (np.int64, np.int64, "<u4"))
        self.used = 0

    def words_only(self, path: str) -> None:
        """The same merges for tiktoken, which is quicker on single words: the byte 255, never in a text, ends a word."""
        with open(path) as file:
            model = json.load(file)["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown_as = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        plain = lambda x: bytes(shown_as[c] for c in x.removesuffix("</w>")) + b"\xff" * x.endswith("</w>")
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        names = [*shown_as, *(f"{c}</w>" for c in shown_as), *("".join(x) for x in merges)]
        ranks = {plain(x): i for i, x in reversed([*enumerate(names)])}
        piece = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
        self.piece = piece._core_bpe.encode_single_piece
        #: Ids of ranks, then each id itself.
        self.ids_of = np.array([*(model["vocab"].get(x, -1) for x in names), *range(max(model["vocab"].values()) + 1)], "<u4")
        self.itself = len(names)
        self.mark = {x: [self.itself + i for i in self.tokenizer.encode(x, add_special_tokens=False).ids] for x in ".,"}

    def encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and each chunk's count: letters with or without a last stop or comma by themselves, others by the
        library."""
        hard = [x for x in chunks if not _plain(x) or _repeated(x)]
        by_library = dict(zip(hard, self.tokenizer.encode_batch_fast(hard, add_special_tokens=False), strict=True))
        flat: list[int] = []
        ends, piece, mark = [0], self.piece, self.mark
        for x in chunks:
            if x in by_library:
                flat += [self.itself + i for i in by_library[x].ids]
            elif x[-1] in mark:
                flat += piece(x[:-1].encode() + b"\xff")
                flat += mark[x[-1]]
            else:
                flat += piece(x.encode() + b"\xff")
            ends.append(len(flat))
        return self.ids_of[np.array(flat, np.int64)], np.diff(ends)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def places_of(self, keys: np.ndarray, chunks: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """The place of each key's ids; chunks gives the text of keys not known yet. Keys are distinct."""
        if len(self.places) + len(keys) > self.LIMIT:
            self.forget()
        found = list(map(self.places.get, keys.tolist()))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            flat, counts = self.encode_new(chunks(np.array(new)))
            first, ends = len(self.places), self.used + np.cumsum(counts)
            while first + len(new) > len(self.starts):
                self.starts, self.counts = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.counts))
            while ends[-1] > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            self.starts[first : first + len(new)], self.counts[first : first + len(new)] = ends - counts, counts
            self.ids[self.used : ends[-1]] = flat
            self.used = int(ends[-1])
            self.places.update(zip(keys[new].tolist(), range(first, first + len(new)), strict=True))
            for n, i in enumerate(new, first):
                found[i] = n
        return np.array(found, np.int64)


_known: dict[str, ChunkIds] = {}


def chunk_ids(vocabulary: str) -> ChunkIds:
    if vocabulary not in _known:
        _known[vocabulary] = ChunkIds(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
    return _known[vocabulary]


#: A character whose normal form, case or width as white space may depend on its neighbours or on the library.
SPECIAL = "[\\x{1c}-\\x{1f}\\x{80}-\\x{a0}\\x{100}-\\x{10ffff}]"


def encode_all(texts: pa.Array, vocabulary: str = VOCABULARY) -> list[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit numbers; a null text has none.

    White space only separates pieces for this tokenizer, so distinct chunks between it are encoded once. Texts with
    characters for which that may not hold are encoded whole.
    """
    known = chunk_ids(vocabulary)
    texts = pc.fill_null(texts, "")
    special = pc.match_substring_regex(texts, SPECIAL)
    found = Words(pc.utf8_lower(pc.if_else(special, "", texts)), SPACES)
    codes, keys = pd.factorize(found.keys)
    first = np.zeros(len(keys), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    place = known.places_of(keys, lambda new: found.words(first[new]))[codes]
    counts = known.counts[place]
    ends = np.concatenate(([0], np.cumsum(counts)))
    ids = known.ids[np.repeat(known.starts[place] - ends[:-1], counts) + np.arange(ends[-1])]
    bounds = ends[found.bounds()]
    out = [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
        out[i] = known.encode(texts[i].as_py())
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, tail: int = TAIL) -> DataFrame:
    """Cut each document's ids (with a last END_ID) every capacity ids, and the rest every tail ids.

    docs: doc_id, text; a null text is empty, so its only id is END_ID. Rows with equal or null doc_id stay documents of
    their own. Returns doc_id, start, length, ids_crc32, doc_tokens, one row per piece.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches):
        for table in text_batches(batches, 2 << 20):
            ids = table.column("doc_id").combine_chunks()
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for i, raw in enumerate(encode_all(table.column("text").combine_chunks(), vocabulary)):
                raw += end
                n = len(raw) // 4
                full = n // capacity * capacity
                for at in (*range(0, full, capacity), *range(full, n, tail)):
                    piece = raw[4 * at : 4 * (at + (capacity if at < full else tail))]
                    rows.append(i)
                    starts.append(at)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(n)
            yield from pa.Table.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            ).to_batches()

    kept = docs.select("doc_id", "text")
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest differencing over k windows: the window of each item and the windows' sums.

    A partial partition holds k sums; the two with the widest spread are merged again and again, the largest sums of one
    with the smallest of the other. Windows are linked lists of items so that a merge costs O(k log k).
    """
    n = len(sizes)
    follows = np.full(n, -1, np.int64)
    # A partition is (sums, first item, last item) of its windows in use, in descending order of sums; others are empty.
    heap = [(-int(s), i, (np.array([s]), np.array([i]), np.array([i]))) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        _, _, (sa, fa, la) = heapq.heappop(heap)
        _, _, (sb, fb, lb) = heapq.heappop(heap)
        alone = k - len(sa)  # windows of the first that are empty
        if len(sb) <= alone:
            sums, first, last = np.concatenate((sa, sb)), np.concatenate((fa, fb)), np.concatenate((la, lb))
        else:
            m = len(sb) - alone  # the smallest of the second join the smallest-but-used of the first, crosswise
            into = np.arange(len(sa) - 1, len(sa) - 1 - m, -1)
            sums, first, last = sa.copy(), fa, la.copy()
            follows[la[into]] = fb[alone:]
            sums[into] += sb[alone:]
            last[into] = lb[alone:]
            sums, first, last = np.concatenate((sums, sb[:alone])), np.concatenate((first, fb[:alone])), np.concatenate((last, lb[:alone]))
        order = np.argsort(-sums, kind="stable")
        sums, first, last = sums[order], first[order], last[order]
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == k else 0)
        heapq.heappush(heap, (-spread, count, (sums, first, last)))
        count += 1
    window = np.zeros(n, np.int64)
    sums, first, _ = heap[0][2]
    for w, at in enumerate(first.tolist()):
        while at >= 0:
            window[at] = w
            at = follows[at]
    return window, sums


def least_windows(sizes: np.ndarray, capacity: int) -> int:
    """No packing needs fewer windows: items over half a window are alone with what fits beside them."""
    up = np.sort(sizes)
    sums = np.concatenate(([0], np.cumsum(up)))
    middle = int(np.searchsorted(up, capacity // 2, "right"))
    alone = len(up) - middle
    best = max(1, -(-int(sums[-1]) // capacity), alone)
    for least in np.unique(up[:middle]).tolist():
        # Items over capacity - least share with none that are counted; the other large ones leave their rest to those.
        large = int(np.searchsorted(up, capacity - least, "right"))
        small = int(np.searchsorted(up, least, "left"))
        rest = (large - middle) * capacity - int(sums[large] - sums[middle])
        best = max(best, alone + max(0, -(-(int(sums[middle] - sums[small]) - rest) // capacity)))
    return best


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item. While a window exceeds capacity, the count of windows rises by doubling steps; then it is
    halved back to the smallest count found that fits."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    low = least_windows(sizes, capacity) - 1
    step, window = 1, None
    while window is None:
        found, sums = differencing(sizes, low + step)
        if sums.max() <= capacity:
            window = found
        else:
            low, step = low + step, 2 * step
    high = low + step
    while high - low > 1:
        k = (low + high) // 2
        found, sums = differencing(sizes, k)
        if sums.max() <= capacity:
            high, window = k, found
        else:
            low = k
    return window


def pack(cut: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Give every piece a window (sequence_id) and a place in it (offset).

    cut: doc_id, start, length (1 to capacity; others and nulls raise) and any other columns, which stay; columns that are
    called sequence_id or offset are replaced. Pieces are dealt by a hash into groups of about group_tokens; a full piece is
    a window by itself, the others are packed within their group, so a group's last window is all that the grouping can
    waste. Rows may repeat. An empty table gives an empty result.
    """
    cut = cut.drop("sequence_id", "offset")
    if cut.isEmpty():
        return cut.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    total, rows, fit = cut.agg(F.sum("length"), F.count("*"), F.count_if(F.col("length").between(1, capacity))).first()
    if fit < rows:
        raise ValueError(f"{rows - fit} pieces are not of 1 to {capacity} ids")
    groups = max(1, round((total or 0) / group_tokens), round(rows / 20_000))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"

    def place(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
        lengths = part["length"].to_numpy(np.int64)
        full = int((lengths >= capacity).sum())
        window = np.concatenate((np.arange(full), full + pack_sizes(lengths[full:], capacity)))
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(lengths[order])
        begins = np.concatenate(([True], np.diff(window[order]) > 0))
        base = np.maximum.accumulate(np.where(begins, ends - lengths[order], 0))
        offset = np.zeros(len(part), np.int64)
        offset[order] = ends - lengths[order] - base
        return part.assign(sequence_id=window * groups + int(key[0]), offset=offset).drop(columns=group)

    group = fresh("group", [*cut.columns, "sequence_id", "offset"])
    # Rows that are equal in these are spread by their position in their partition.
    keys = [c for c in ("doc_id", "start", "ids_crc32", "doc_tokens") if c in cut.columns]
    spread = F.pmod(F.xxhash64(*keys, F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    return cut.withColumn(group, spread).groupBy(group).applyInPandas(place, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Tokenize, cut and pack whole documents; see pieces() and pack()."""
    return pack(staged(pieces(docs, capacity, vocabulary), "pieces"), capacity, group_tokens)
