"""Statistics of whole texts, vectorised over the bytes of a batch.

Words are runs of bytes that are no ASCII white space; lines end at a newline. Spans of text
are told apart by 64-bit polynomial hashes taken from one prefix sum over the batch's bytes.
A text needs about sixty times its own size in memory while it is measured.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Classes of bytes. Bytes beyond ASCII are letters' parts in most texts.
CLASSES = {
    "space": b" \t\n\x0b\x0c\r", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789",
    "stop": b".,;:!?", "quote": b"'\"()-", "symbol": b"#*$%&|<>{}[]=/\\_~^@+`", "control": bytes([*range(9), *range(14, 32), 127]),
    "other": bytes(range(128, 256)),
}
NAMES = [
    *[f"share_{c}" for c in CLASSES], "log_chars", "log_words", "word_length", "word_spread", "longest_word", "log_lines",
    "words_per_line", "entropy", "odd_ends", "upper_words", "no_letter_words", "short_words", "distinct_words", "top_word",
    "repeated_windows", "distinct_lines", "pair_repeats",
]
_KIND = np.zeros(256, np.uint8)
for _number, _bytes in enumerate(CLASSES.values()):
    _KIND[list(_bytes)] = _number
_SPACE, _UPPER, _LOWER, _DIGIT, _STOP, _QUOTE, _SYMBOL, _CONTROL, _OTHER = range(len(CLASSES))
_FACTOR = 0x9E3779B97F4A7C15
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The factor's powers and their inverses, modulo 2**64, at least `n` of each."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, factor in enumerate((_FACTOR, pow(_FACTOR, -1, 1 << 64))):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(30))) * _MIX[0]
    return (keys ^ (keys >> np.uint64(27))) * _MIX[1]


def _kinds(keys: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: distinct keys, the count of the commonest, and keys that repeat."""
    _, first, count = np.unique(_mixed(keys + doc.astype(np.uint64) * _MIX[2]), return_index=True, return_counts=True)
    owner, top = doc[first], np.zeros(docs, np.int64)
    np.maximum.at(top, owner, count)
    again = count > 1
    return np.bincount(owner, minlength=docs), top, np.bincount(owner[again], count[again], minlength=docs)


def _shares(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)


def statistics(texts: pa.Array) -> np.ndarray:
    """Rows x `NAMES` for an array of binary texts; nulls are empty."""
    texts = texts.fill_null(b"").cast(pa.large_binary())
    docs = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + docs + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(docs, dtype=np.int64), sizes)
    table = np.bincount(doc * 256 + data, minlength=docs * 256).reshape(docs, 256)
    by_class = np.stack([table[:, _KIND == k].sum(1) for k in range(len(CLASSES))], 1)
    share = _shares(table.ravel(), np.repeat(sizes, 256)).reshape(docs, 256)
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    chars = sizes - table[:, 0x80:0xC0].sum(1)

    kind = _KIND[data]
    # A byte is inside a word unless it is white space; marks of documents cut words.
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    inside = kind != _SPACE
    before = np.append(False, inside[:-1]) if len(data) else inside
    after = np.append(inside[1:], False) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | fresh[:-1]))
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    owner, length = doc[starts] if len(starts) else np.zeros(0, np.int64), (ends - starts).astype(np.float64)
    words = np.bincount(owner, minlength=docs)
    upper, lower, other = (np.append(0, np.cumsum(kind == k)) for k in (_UPPER, _LOWER, _OTHER))
    many = lambda flags: _shares(np.bincount(owner[flags], minlength=docs), words)
    uppers, lowers = upper[ends] - upper[starts], lower[ends] - lower[starts]
    ending = kind[ends - 1]
    mean = _shares(np.bincount(owner, length, docs), words)
    spread = np.sqrt(np.maximum(0, _shares(np.bincount(owner, length * length, docs), words) - mean * mean))
    longest = np.zeros(docs)
    np.maximum.at(longest, owner, length)

    power, inverse = _powers(len(data) + 1)
    sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], dtype=np.uint64))
    spans = lambda a, b: _mixed((sums[b] - sums[a]) * inverse[a])
    word = spans(starts, ends)
    distinct, top, _ = _kinds(word, owner, docs)
    repeats = []
    for width in (3, 2):
        at = np.flatnonzero(owner[width - 1:] == owner[:len(owner) - width + 1]) if len(owner) >= width else np.zeros(0, np.int64)
        keys = sum((word[at + i] * _MIX[i] for i in range(width)), np.zeros(len(at), np.uint64))
        repeats.append(_shares(_kinds(keys, owner[at], docs)[2], np.bincount(owner[at], minlength=docs)))

    # Lines with something in them; an end of text ends a line, too.
    breaks = data == 10
    cuts = np.unique(np.concatenate([np.flatnonzero(breaks) + 1, offsets]))
    line_start, line_end = cuts[:-1], cuts[1:]
    line_end = line_end - breaks[line_end - 1] if len(cuts) > 1 else line_end
    full = line_end > line_start
    line_start, line_end = line_start[full], line_end[full]
    line_doc = doc[line_start] if len(line_start) else np.zeros(0, np.int64)
    lines = np.bincount(line_doc, minlength=docs)
    lines_distinct = _kinds(spans(line_start, line_end), line_doc, docs)[0]

    columns = [*[_shares(by_class[:, k], sizes) for k in range(len(CLASSES))], np.log1p(chars), np.log1p(words), mean, spread,
               np.log1p(longest), np.log1p(lines), _shares(words, lines), entropy,
               many((ending == _SYMBOL) | (ending == _CONTROL)), many((uppers > 0) & (lowers == 0)),
               many((uppers + lowers + other[ends] - other[starts]) == 0), many(length <= 3),
               _shares(distinct, words), _shares(top, words), repeats[0], _shares(lines_distinct, lines), repeats[1]]
    return np.stack(columns, 1)
