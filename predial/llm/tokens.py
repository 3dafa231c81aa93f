"""Token counts per section: whole documents are encoded once and token character spans are joined to sections."""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from predial.llm.common import text_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Who gets a token that covers characters of several sections.
RULES = ("first", "largest")

_encoders: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def encoder(vocabulary: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder of a vocabulary file and the byte length of each id."""
    if vocabulary not in _encoders:
        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _encoders[vocabulary] = own, lengths
    return _encoders[vocabulary]


def token_spans(text: str, vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with the start and end of each token in characters; a token inside one character covers that character."""
    own, lengths = encoder(vocabulary)
    ids = own.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    if text.isascii():
        return ids, starts, ends
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return ids, char[starts], char[ends - 1] + 1


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sections that end behind each line feed; they cover the text without gaps. An empty text has one empty section."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(raw == 10) + 1
    if not len(ends) or ends[-1] != len(raw):
        ends = np.append(ends, len(raw))
    return np.concatenate(([0], ends[:-1])), ends


def attribute(
    starts: np.ndarray, ends: np.ndarray, section_starts: np.ndarray, section_ends: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those of them that also touch another section.

    Sections are sorted and don't overlap; gaps are allowed. "first": a token belongs to the first section that it
    touches. "largest": to the one with most of its characters, of equal ones to the first. Tokens that touch no
    section are not counted.
    """
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_starts, ends, "left") - 1
    touching = first <= last
    owner = first.copy()
    crossing = touching & (first < last)
    if rule == "largest":
        for i in np.flatnonzero(crossing).tolist():
            s = slice(first[i], last[i] + 1)
            shared = np.minimum(section_ends[s], ends[i]) - np.maximum(section_starts[s], starts[i])
            owner[i] = first[i] + int(np.argmax(shared))
    elif rule != "first":
        raise ValueError(f"rule is one of {RULES}")
    n = len(section_starts)
    return np.bincount(owner[touching], minlength=n), np.bincount(owner[crossing], minlength=n)


def token_counts(
    docs: DataFrame,
    sections: str | None = None,
    rule: str = "largest",
    vocabulary: str = VOCABULARY,
    split: Callable[[str], tuple[np.ndarray, np.ndarray]] = line_sections,
) -> DataFrame:
    """Tokens of each section of each document.

    docs: doc_id, text and, if sections is given, a column of that name with an array of (start, end) structs in
    characters, sorted and without overlaps, which raise (fields of the text); otherwise split(text) makes the sections. A null text
    counts as empty; an empty text has one empty section without tokens; a null section array is empty, and so are
    arrays of sections beyond the text. Rows with equal or null doc_id are documents of their own. Other columns are
    ignored. Returns doc_id, section (from 0), section_start, section_end, n_tokens, n_crossing (tokens of n_tokens that
    touch another section as well), doc_tokens (of the whole document).
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    kept = docs.select("doc_id", "text", *([sections] if sections else []))

    def count(batches):
        for table in text_batches(batches):
            columns: list[list] = [[] for _ in range(6)]
            rows = []
            marks = table.column(sections).to_pylist() if sections else None
            ids = table.column("doc_id").combine_chunks()
            for i, text in enumerate(table.column("text").to_pylist()):
                text = text or ""
                tokens, starts, ends = token_spans(text, vocabulary)
                if marks is None:
                    a, b = split(text)
                else:
                    pairs = np.array([(x["start"], x["end"]) for x in marks[i] or []], np.int64).reshape(-1, 2)
                    a, b = pairs[:, 0], pairs[:, 1]
                    if (b < a).any() or (a[1:] < b[:-1]).any():
                        raise ValueError("sections overlap or are not sorted")
                n, crossing = attribute(starts, ends, a, b, rule)
                rows.append(np.full(len(a), i))
                for column, values in zip(
                    columns, (np.arange(len(a)), a, b, n, crossing, np.full(len(a), len(tokens))), strict=True
                ):
                    column.append(values)
            picked = ids.take(pa.array(np.concatenate(rows)))
            values = [pa.array(np.concatenate(c).astype(np.int64)) for c in columns]
            yield from pa.Table.from_arrays(
                [picked, *values],
                ["doc_id", "section", "section_start", "section_end", "n_tokens", "n_crossing", "doc_tokens"],
            ).to_batches()

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(
        count,
        f"doc_id {kind}, section long, section_start long, section_end long, n_tokens long, n_crossing long, doc_tokens long",
    )
