"""Dense surface features of texts, computed for whole batches at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from predial.llm.common import NOT_ALNUM, SPACES, Words, mix64

NAMES = (
    "log_bytes", "letters", "capitals", "digits", "spaces", "exclamation", "bars", "symbols", "stops", "other_punctuation",
    "control", "words_per_byte", "word_length", "shouted_words", "marked_words", "inner_symbols", "repeated_words",
    "distinct_words", "distinct_lines", "lines_per_word", "leading_capitals",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT, _SPACE = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(" \t\r\n")
_LETTER = _class("abcdefghijklmnopqrstuvwxyz") | _UPPER
_LETTER[128:] = True
_CONTROL = np.arange(256) < 32
_CONTROL[[9, 10, 13]] = False
_PUNCTUATION = ~(_LETTER | _DIGIT | _SPACE | _CONTROL)
_SYMBOL, _STOP = _class("#$%&*@^~=<>_\\{}[]"), _class(".,;:")


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    seen = np.sort(mix64(keys + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(22) | doc.astype(np.uint64) << np.uint64(42))
    new = np.concatenate(([True], seen[1:] != seen[:-1])) if len(seen) else np.zeros(0, bool)
    return np.bincount((seen[new] >> np.uint64(42)).astype(np.int64), minlength=n).astype(float)


def surface(texts: pa.Array) -> tuple[np.ndarray, Words]:
    """One row of NAMES per text, all zero for a null or empty text, and the lower-case words of the texts."""
    chunks = Words(texts, SPACES)
    raw, at, n = chunks.raw, chunks.offsets, len(chunks.offsets) - 1
    size = np.maximum(np.diff(at), 1).astype(float)
    rate = lambda kind: _sums(kind[raw], at) / size
    bounds = chunks.bounds()
    count = np.maximum(np.diff(bounds), 1).astype(float)
    per_word = lambda flags: _sums(flags, bounds) / count
    upper, letter = (np.concatenate(([0], np.cumsum(x[raw]))) for x in (_UPPER, _LETTER))
    marks = np.concatenate(([0], np.cumsum(_PUNCTUATION[raw] & ~_STOP[raw])))
    a, b = chunks.starts, chunks.ends
    uppers, letters = upper[b] - upper[a], letter[b] - letter[a]
    inner = np.where(b - a > 2, marks[np.maximum(b - 1, a)] - marks[np.minimum(a + 1, b)], 0) > 0
    repeated = np.concatenate(([False], (chunks.keys[1:] == chunks.keys[:-1]) & (chunks.doc[1:] == chunks.doc[:-1]))) if len(a) else np.zeros(0, bool)
    newline = np.zeros(256, bool)
    newline[10] = True
    lines = Words(texts, newline)
    n_lines = np.bincount(lines.doc, minlength=n).astype(float)
    out = np.column_stack([
        np.log1p(np.diff(at)), rate(_LETTER), rate(_UPPER), rate(_DIGIT), rate(_SPACE), rate(_class("!")), rate(_class("|")),
        rate(_SYMBOL), rate(_STOP), rate(_PUNCTUATION & ~_SYMBOL & ~_STOP & ~_class("!|")), rate(_CONTROL),
        np.diff(bounds) / size, _sums(b - a, bounds) / count, per_word((uppers == letters) & (letters > 1)),
        per_word(marks[b] > marks[a]), per_word(inner), per_word(repeated),
        _distinct(chunks.keys, chunks.doc, n) / count, _distinct(lines.keys, lines.doc, n) / np.maximum(n_lines, 1),
        n_lines / count, per_word(_UPPER[raw[a]]),
    ])
    out[np.diff(at) == 0] = 0
    return out, Words(pc.utf8_lower(texts), NOT_ALNUM)
