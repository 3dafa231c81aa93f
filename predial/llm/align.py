"""Alignment of two tokenizers' tokens: spans in bytes, groups between common ends, links between overlapping tokens.

A is a byte-level BPE of the tokenizers library, which reads the text behind a space; B is a sentencepiece model with byte
fallback, which puts that space there itself. The libraries' own spans (character offsets of A, spans in B's protos) are coarse
cuts: tokens that are part of a character, and B's fallback bytes, share or lack a span. Those are refined by the tokens'
decoded bytes.

Texts are cut into segments before each space behind a character that is not white space. Neither tokenizer has a token across
such a place (A's pattern ends a match there; no piece of B has a space behind another character, which is checked when it is
loaded), so segments are encoded by themselves, each distinct one once in a batch of texts.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from predial.llm.common import pack, ship, staged, text_batches, unpack

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text in one batch, whose distinct segments are encoded once.
BATCH_BYTES = 12 << 20
#: Characters of distinct segments that are encoded at a time; a longer segment is encoded alone.
CHUNK_CHARS = 1 << 17
#: Segments that are linked and spelled at a time.
SLICE = 1 << 14
_CUT = re.compile(r"(?<=\S) (?=.)", re.S)
_WHITE = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
_B_BITS = 20


def segments(text: str) -> list[str]:
    """The text's parts, each without the space that it is read behind."""
    if not text or text[0] == " " or text[-1] == " " or any(w in text for w in _WHITE):
        return _CUT.split(text) if text else []
    return text.split(" ")


def _byte_level() -> dict[str, int]:
    """Byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes follow from U+0100 on in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, byte_level: str, pieces: str):
        # Spark runs one task for each core; the library's own threads would only compete.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(_path(byte_level))
        self.a.encode_special_tokens = True
        alphabet = _byte_level()
        special = self.a.get_added_tokens_decoder()
        self.a_bytes = [b"" if i in special else bytes(map(alphabet.__getitem__, self.a.id_to_token(i))) for i in range(self.a.get_vocab_size())]
        self.b = sentencepiece.SentencePieceProcessor(model_file=_path(pieces))
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.b.serialized_model_proto())
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else p.piece.replace("▁", " ").encode() for p in model.pieces]
        spec = model.normalizer_spec
        if not spec.add_dummy_prefix or spec.remove_extra_whitespaces or spec.precompiled_charsmap or any(" " in x.lstrip(b" ").decode(errors="ignore") for x in self.b_bytes):
            raise ValueError(f"{pieces}: pieces across words, or a normalisation that changes texts")
        # Ids as texts with what goes before them: A's first id of a segment, of a group, others; B's first id of a group, others.
        ids = (list(map(str, range(len(x)))) for x in (self.a_bytes, self.b_bytes))
        self.words = [mark + i for marks, texts in zip(("\n;,", "|,"), ids, strict=True) for mark in marks for i in texts]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))


def _path(name: str) -> str:
    return name if "/" in name else public_tokenizers.path(name)


_pairs: dict[tuple[str, str], Pair] = {}


def pair(byte_level: str, pieces: str) -> Pair:
    """Loaded once in each Python process."""
    if (byte_level, pieces) not in _pairs:
        _pairs[byte_level, pieces] = Pair(byte_level, pieces)
    return _pairs[byte_level, pieces]


def refine(begins: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where tokens end, in bytes, from their coarse spans and the sizes of their decoded bytes, which make up the whole text.

    A coarse span of the token's own size is its place. Tokens that share a character's span, or have none, are laid end to
    end behind the token before them. A span that contradicts the decoded bytes raises.
    """
    exact = ends - begins == sizes
    laid = np.cumsum(sizes)
    if (laid[exact] != ends[exact]).any():
        raise ValueError("spans and decoded bytes disagree")
    return np.where(exact, ends, laid)


class Segments:
    """Segments laid end to end, with both tokenizers' ids and token ends in bytes.

    ends: where each segment ends; valid: whether both tokenizers give back its bytes. Invalid segments have no tokens.
    """

    def __init__(self, own: Pair, parts: list[str]):
        self.valid = np.ones(len(parts), bool)
        sizes = np.fromiter((len(p.encode()) + 1 for p in parts), np.int64, len(parts))
        found, at = [], 0
        for i, j in _chunks(parts):
            coded = self._code(own, parts[i:j])
            if coded is None and j > i + 1:
                raise ValueError(f"tokens change the text of a segment behind {parts[i][:60]!r}")
            if coded is None:
                self.valid[i], sizes[i] = False, 0
                continue
            a_ids, a_ends, b_ids, b_ends = coded
            found.append((a_ids, a_ends + at, b_ids, b_ends + at))
            at += a_ends[-1]
        self.ends = np.cumsum(sizes)
        self.a_ids, self.a_ends, self.b_ids, self.b_ends = map(np.concatenate, zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4

    @classmethod
    def stored(cls, own: Pair, a_ids: np.ndarray, b_ids: np.ndarray, sizes: np.ndarray) -> Segments:
        """The same again from the ids and the segments' sizes in bytes."""
        out = cls.__new__(cls)
        out.a_ids, out.b_ids = a_ids.astype(np.int64), b_ids.astype(np.int64)
        out.a_ends, out.b_ends = np.cumsum(own.a_sizes[out.a_ids]), np.cumsum(own.b_sizes[out.b_ids])
        out.ends = np.cumsum(sizes.astype(np.int64))
        out.valid = sizes > 0
        return out

    @staticmethod
    def _code(own: Pair, parts: list[str]) -> tuple[np.ndarray, ...] | None:
        # Segments one behind the other are a text with just these segments, so one call encodes them all.
        text = " ".join(parts)
        raw = (" " + text).encode() if parts else b""
        # A: character offsets.
        found = own.a.encode(raw.decode(), add_special_tokens=False)
        a_ids = np.array(found.ids, np.int64)
        offsets = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(a_ids)).reshape(-1, 2)
        # B: spans of the proto, in bytes of the text without the space before it.
        pieces = own.b.encode(text, return_type="proto").pieces
        spans = np.array([(p.id, p.begin, p.end) for p in pieces], np.int64).reshape(-1, 3)
        b_ids = spans[:, 0]
        if b"".join(map(own.a_bytes.__getitem__, found.ids)) != raw or b"".join(map(own.b_bytes.__getitem__, b_ids.tolist())) != raw:
            return None
        data = np.frombuffer(raw, np.uint8)
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        offsets, begins, ends = at[offsets], spans[:, 1] + 1, spans[:, 2] + 1
        begins[:1] = 0  # the first piece has that space
        return a_ids, refine(offsets[:, 0], offsets[:, 1], own.a_sizes[a_ids]), b_ids, refine(begins, ends, own.b_sizes[b_ids])

    def per_segment(self, ends: np.ndarray) -> np.ndarray:
        """How many of the ascending ends each segment has."""
        return np.diff(np.searchsorted(ends, self.ends, "right"), prepend=0)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all linked id pairs, and how many links each segment has. Just one link lies between two neighbouring token
        ends of either tokenizer."""
        ends = np.sort(np.concatenate((self.a_ends, np.setdiff1d(self.b_ends, self.a_ends, assume_unique=True))), kind="stable")
        a, b = np.searchsorted(self.a_ends, ends), np.searchsorted(self.b_ends, ends)
        return self.a_ids[a] << _B_BITS | self.b_ids[b], self.per_segment(ends)

    def common_ends(self) -> np.ndarray:
        return np.intersect1d(self.a_ends, self.b_ends, assume_unique=True)

    def texts(self, own: Pair) -> list[str]:
        """Each segment's groups as `a1,a2|b1;a3|b2,b3`."""
        cuts = self.common_ends()
        starts = lambda at: np.concatenate(([True], at[1:] != at[:-1])) if len(at) else at.astype(bool)
        group_a, group_b = np.searchsorted(cuts, self.a_ends), np.searchsorted(cuts, self.b_ends)
        kind_a = np.where(starts(group_a), 1, 2)
        kind_a[starts(np.searchsorted(self.ends, self.a_ends))] = 0
        kind_b = np.where(starts(group_b), 0, 1)
        n_a, n_b = len(own.a_bytes), len(own.b_bytes)
        words = np.concatenate((kind_a * n_a + self.a_ids, 3 * n_a + kind_b * n_b + self.b_ids))
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        found = iter("".join(map(own.words.__getitem__, words[order].tolist())).split("\n")[1:])
        return [next(found) if ok else "" for ok in self.valid.tolist()]

    def slices(self):
        """The same in ranges of SLICE segments, each laid out from 0."""
        for i in range(0, len(self.ends), SLICE):
            begin, ends = self.ends[i - 1] if i else 0, self.ends[i : i + SLICE]
            out = Segments.__new__(Segments)
            out.valid, out.ends = self.valid[i : i + SLICE], ends - begin
            for side in "ab":
                where = getattr(self, f"{side}_ends")
                a, b = np.searchsorted(where, (begin, ends[-1]), "right")
                setattr(out, f"{side}_ids", getattr(self, f"{side}_ids")[a:b])
                setattr(out, f"{side}_ends", where[a:b] - begin)
            yield i, out


def _chunks(parts: list[str]):
    """Ranges of parts that are encoded together. A part that ends in white space would not be cut off again where it is
    followed by another, and one with U+2581 may be invalid: those stand alone."""
    begin = size = 0
    for i, p in enumerate(parts):
        alone = p[-1].isspace() or "▁" in p
        if i > begin and (alone or size + len(p) > CHUNK_CHARS):
            yield begin, i
            begin, size = i, 0
        size += len(p)
        if alone:
            yield i, i + 1
            begin, size = i + 1, 0
    if begin < len(parts):
        yield begin, len(parts)


def spans(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """doc_id with a_ids, a_ends, b_ids, b_ends (arrays): both tokenizers' ids and where each token ends, in bytes of the text
    behind a space. Null and empty texts, and those that a tokenizer changes, have empty arrays. One row per row."""
    kind = docs.schema["doc_id"].dataType
    names = ("a_ids", "a_ends", "b_ids", "b_ends")
    ship(docs.sparkSession)

    def run(batches):
        own = pair(byte_level, pieces)
        for table in text_batches(batches, 1 << 20):
            columns: list[list] = [[] for _ in names]
            for text in table.column("text").to_pylist():
                found = Segments(own, segments(text or ""))
                whole = found.valid.all()
                for column, x in zip(columns, (found.a_ids, found.a_ends, found.b_ids, found.b_ends), strict=True):
                    column.append(x if whole else x[:0])
            values = [pa.array(c, pa.list_(pa.int64())) for c in columns]
            yield from pa.Table.from_arrays([table.column("doc_id").combine_chunks(), *values], ["doc_id", *names]).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, " + ", ".join(f"{n} array<long>" for n in names))


def _code_batches(batches, byte_level: str, pieces: str, schema: pa.Schema):
    """One row for each batch of texts: its documents as sequences of distinct segments, those segments' ids, and the batch's
    distinct linked id pairs with their number of links."""
    own = pair(byte_level, pieces)
    for i, table in enumerate(text_batches(batches, BATCH_BYTES)):
        index: defaultdict[str, int] = defaultdict()
        index.default_factory = index.__len__
        found = [np.fromiter(map(index.__getitem__, segments(text or "")), np.int32) for text in table.column("text").to_pylist()]
        coded = Segments(own, list(index))
        del index
        found = [x if coded.valid[x].all() else x[:0] for x in found]
        sequence = np.concatenate(found)
        often = np.bincount(sequence, minlength=len(coded.valid))
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for begin, part in coded.slices():
            more, many = part.links()
            keys, at = np.unique(np.concatenate((keys, more)), return_inverse=True)
            counts = np.concatenate((counts, np.repeat(often[begin : begin + SLICE], many)))
            counts = np.bincount(at, counts, len(keys)).astype(np.int64)
        sizes = np.diff(coded.ends, prepend=0)
        narrow = [x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (np.array(list(map(len, found))), sequence, coded.a_ids, coded.b_ids, sizes)]
        values = [[TaskContext.get().partitionId() << 33 | i], [table.column("doc_id").to_pylist()], [pack(*narrow)], [keys], [counts]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


_COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _describe(answers: pa.Table, rows: pa.Table, byte_level: str, pieces: str, schema: pa.Schema) -> pa.Table:
    """One row for each text of a batch, given the corpus-wide counts of its pairs."""
    own = pair(byte_level, pieces)
    lengths, sequence, *coded = unpack(rows.column("coded")[0].as_py())
    found = Segments.stored(own, *coded)
    keys = answers.column("pair").to_numpy()
    order = np.argsort(keys)
    keys, count, best = keys[order], answers.column("count").to_numpy()[order], answers.column("best").to_numpy()[order].astype(np.int64)
    numbers, groups = [np.zeros((0, len(_COLUMNS)), np.int64)], []
    for _, part in found.slices():
        links, many = part.links()
        asked, ends = np.searchsorted(keys, links), np.append(0, np.cumsum(many))
        summed = lambda x, asked=asked, ends=ends: np.diff(np.concatenate(([0], np.cumsum(x[asked])))[ends])
        numbers.append(np.stack((*map(part.per_segment, (part.a_ends, part.b_ends, part.common_ends())), many, summed(best), summed(count)), axis=1))
        groups += part.texts(own)
    numbers = np.concatenate(numbers)
    ids = rows.column("doc_ids").combine_chunks().flatten()
    upto = np.append(0, np.cumsum(lengths.astype(np.int64))).tolist()
    tables = [schema.empty_table()]
    for i in range(0, len(lengths), 256):
        spans_ = list(zip(upto[i : i + 256], upto[i + 1 : i + 257], strict=False))
        out = np.stack([numbers[sequence[a:b]].sum(axis=0) for a, b in spans_])
        texts = [";".join(map(groups.__getitem__, sequence[a:b].tolist())) for a, b in spans_]
        tables.append(pa.Table.from_arrays([ids[i : i + 256], *(pa.array(out[:, j]) for j in range(len(_COLUMNS))), pa.array(texts, pa.string())], schema=schema))
    return pa.concat_tables(tables)


def alignments(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """How both tokenizers' tokens of each text go together, and how usual those links are in the whole corpus.

    docs: doc_id, text; other columns are ignored. Returns, one row per row: doc_id, n_a and n_b (tokens), n_groups (between
    common token ends), n_links (overlapping tokens of A and B), n_best (links whose pair of ids is, corpus-wide, the most
    frequent one of its B id, ties included), count_sum (corpus-wide counts of the pairs, over links), groups (decimal ids,
    `a1,a2|b1;a3|b2,b3`). Null and empty texts, and those that a tokenizer does not give back (with U+2581, which B takes for a
    space), have no tokens: zeros and an empty groups. Repeated rows, and rows with equal or null doc_id, count each by itself.

    Texts are encoded once, in batches as they are read; a batch's ids are written in one row with its distinct pairs. Those
    are summed by pair, and each batch is answered with the sums of just the pairs that it has. Texts are never shuffled.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    row = pa.schema([("batch", pa.int64()), ("doc_ids", pa.list_(id_type)), ("coded", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
    coded = docs.select("doc_id", "text").mapInArrow(
        lambda batches: _code_batches(batches, byte_level, pieces, row),
        f"batch long, doc_ids array<{kind.simpleString()}>, coded binary, pairs array<long>, counts array<long>",
    )
    coded = staged(coded, "aligned")
    linked = coded.select(F.col("batch").alias("asker"), F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("asker", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    # A pair has at most one row for each batch.
    counted = linked.select("asker", "pair", F.sum("n").over(Window.partitionBy("pair")).alias("count"))
    b_id = F.col("pair").bitwiseAND((1 << _B_BITS) - 1)
    best = counted.groupBy(b_id.alias("b")).agg(F.max("count").alias("most"))  # no more rows than B has pieces
    answers = counted.join(F.broadcast(best), b_id == F.col("b")).select("asker", "pair", "count", (F.col("count") == F.col("most")).alias("best"))
    out = pa.schema([("doc_id", id_type), *((c, pa.int64()) for c in _COLUMNS), ("groups", pa.string())])
    return (
        answers.groupBy("asker")
        .cogroup(coded.select("batch", "doc_ids", "coded").groupBy("batch"))
        .applyInArrow(
            lambda a, b: _describe(a, b, byte_level, pieces, out),
            f"doc_id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in _COLUMNS) + ", groups string",
        )
    )
