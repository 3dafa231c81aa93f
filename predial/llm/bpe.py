"""Byte-level BPE encoding and decoding through a sentencepiece BPE model that is written directly from a vocabulary of ranks.

Each byte is mapped to one character, so that the model's symbols are bytes; a token's piece is its mapped bytes and its score
its negative rank, so that the pair of lowest rank, of equal ones the leftmost, is merged first. Normalisation is the identity.
Texts are cut into pre-tokens by the vocabulary's pattern and each is encoded by itself; ids are decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
from array import array
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from predial.llm.common import fresh, ship, text_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The name of the piece for unknown symbols, which no mapped byte can form.
UNKNOWN = "⁇"
#: Pre-tokens of at most CACHED_CHARS are kept with their ids, CACHE at a time, in each Python worker.
CACHE, CACHED_CHARS = 1 << 18, 48
#: Text in one batch.
BATCH_BYTES = 4 << 20
_OTHER = ""


def byte_characters() -> list[str]:
    """One character for each byte: visible ASCII stands for itself, the rest begins at U+0100."""
    return [chr(b) if 0x21 <= b <= 0x7E else chr(0x100 + b) for b in range(256)]


_TO_CHARACTER = dict(enumerate(byte_characters()))
_TO_BYTE = {ord(c): b for b, c in _TO_CHARACTER.items()}


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARACTER)


def unmapped(piece: str) -> bytes:
    return piece.translate(_TO_BYTE).encode("latin-1")


def read_ranks(vocabulary: str) -> dict[bytes, int]:
    """Tokens and ranks of a file by name or path; ranks are 0, 1, 2 and so on."""
    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError(f"{vocabulary}: ranks are not 0 to {len(ranks) - 1}")
    return ranks


def model_of(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model: ids are ranks, and one more for unknown symbols, which do not occur."""
    model = sentencepiece_model_pb2.ModelProto()
    kind = sentencepiece_model_pb2.ModelProto.SentencePiece
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece=mapped(token), score=-rank, type=kind.NORMAL)
    model.pieces.add(piece=UNKNOWN, score=0, type=kind.UNKNOWN)
    trainer = model.trainer_spec
    trainer.model_type = sentencepiece_model_pb2.TrainerSpec.BPE
    trainer.vocab_size = len(model.pieces)
    trainer.unk_piece, trainer.unk_id = UNKNOWN, len(ranks)
    trainer.bos_id = trainer.eos_id = trainer.pad_id = -1
    spec = model.normalizer_spec
    spec.name = "identity"
    spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: str):
        self.ranks = read_ranks(vocabulary)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_of(self.ranks))
        self.bytes = [unmapped(self.model.id_to_piece(i)) for i in range(len(self.ranks))]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.late = regex.compile("[՘-\U0010ffff]")
        self.shadow: dict[int, str] | None = None
        self.known: dict[str, bytes] = {}

    def pre_tokens(self, text: str) -> list[str]:
        """All matches of the pattern, with the tiktoken library's classes of characters.

        The regex module knows letters and numbers of a later Unicode version, which are neither to tiktoken; a stand-in
        that is neither takes their place while the text is cut.
        """
        if self.late.search(text):
            if self.shadow is None:
                self.shadow = dict.fromkeys(_unknown_to_tiktoken(), _OTHER)
            shadow = text.translate(self.shadow)
            if shadow != text:
                return [text[m.start() : m.end()] for m in self.pattern.finditer(shadow)]
        return self.pattern.findall(text)

    def _learn(self, found: list[str], known: dict[str, bytes]) -> None:
        for word, ids in zip(found, self.model.encode([mapped(w.encode()) for w in found], num_threads=1), strict=True):
            # A token that merges do not reach is taken whole, as by tiktoken.
            whole = self.ranks.get(word.encode()) if len(ids) > 1 else None
            known[word] = array("i", ids if whole is None else [whole]).tobytes()

    def encode(self, text: str) -> np.ndarray:
        cut = self.pre_tokens(text)
        missing = [w for w in set(cut) if w not in self.known]
        known = self.known
        if missing:
            if len(self.known) > CACHE:
                self.known.clear()
                missing = list(set(cut))
            self._learn([w for w in missing if len(w) <= CACHED_CHARS], self.known)
            long = [w for w in missing if len(w) > CACHED_CHARS]
            if long:
                known = dict(self.known)
                self._learn(long, known)
        return np.frombuffer(b"".join(map(known.__getitem__, cut)), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.bytes):
            raise ValueError(f"ids are 0 to {len(self.bytes) - 1}")
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def _unknown_to_tiktoken() -> list[int]:
    """Letters and numbers of the regex module that tiktoken takes for other characters.

    Asked of tiktoken itself: with a vocabulary in which each of them is a token after "!", only one that falls into the
    class of "!" comes out as one token.
    """
    found = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, chain(range(0x558, 0xD800), range(0xE000, 0x110000)))))
    ranks = {bytes([i]): i for i in range(256)}
    for c in found:
        raw = c.encode()
        for k in range(2, len(raw) + 1):
            ranks.setdefault(raw[:k], len(ranks))
    for c in found:
        ranks.setdefault(b"!" + c.encode(), len(ranks))
    asked = tiktoken.Encoding("classes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [ord(c) for c in found if len(asked.encode_ordinary("!" + c)) == 1]


_codecs: dict[str, Codec] = {}


def codec(vocabulary: str) -> Codec:
    """The vocabulary's codec, made once in each Python process."""
    if vocabulary not in _codecs:
        _codecs[vocabulary] = Codec(vocabulary)
    return _codecs[vocabulary]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """docs with a column of each whole text's ids (array<int>), without special tokens; their strings are plain text.

    docs: text and any other columns, which stay, doc_id among them. A null or empty text has no ids; rows with equal or null
    doc_id are documents of their own. A column already called ids raises.
    """
    if fresh(ids, docs.columns) != ids:
        raise ValueError(f"there is a column {ids} already")

    ship(docs.sparkSession)

    def run(batches):
        own = codec(vocabulary)
        for table in text_batches(batches, BATCH_BYTES):
            found = _lists([own.encode(t.as_py() or "") for t in table.column("text")])
            yield from table.append_column(ids, found).to_batches()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, ids: str = "ids", data: str = "data") -> DataFrame:
    """encoded with a column of the bytes that its ids stand for (binary). Null ids give null; an id outside the vocabulary
    raises; ids that are no whole characters still have their bytes. Other columns stay; one already called data raises."""
    if fresh(data, encoded.columns) != data:
        raise ValueError(f"there is a column {data} already")

    ship(encoded.sparkSession)

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            found = [None if not x.is_valid else own.decode(x.values.to_numpy(zero_copy_only=False)) for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, data])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(data, T.BinaryType())]))
