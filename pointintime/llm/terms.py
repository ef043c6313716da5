"""Words of texts in stretches of bounded size, and which of them are distinct, exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import PIECE, lowered, pieces, prefix, span_hash, words

_NO_LETTER = np.zeros(256, bool)
_NO_LETTER[0:65] = _NO_LETTER[91:97] = _NO_LETTER[123:128] = True
#: For words of letters and whatever is not ASCII.
LETTERED = lowered(_NO_LETTER)


def word_stretches(column: pa.Array, to: np.ndarray, limit: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Row, normalised bytes, start and end of the words of a column of texts (null: none), some rows at a time. A long text comes
    in stretches that end between words; the last value is False for all of these but its last one."""
    for first, _, data, offsets in pieces(column, limit):
        if len(offsets) > 2 or len(data) <= 2 * limit:
            norm, start, end, doc = words(data, offsets, to)
            yield first + doc, norm, start, end, True
            continue
        at = 0
        while at < len(data):
            stop = at + limit
            while stop < len(data):
                blank = np.flatnonzero(to[data[stop : stop + limit]] == 32)
                if len(blank):
                    stop += int(blank[0])
                    break
                stop += limit
            stop = min(stop, len(data))
            norm, start, end, doc = words(data[at:stop], np.array([0, stop - at]), to)
            yield first + doc, norm, start, end, stop == len(data)
            at = stop


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as an Arrow array of strings."""
    at, offsets = gather(start, end)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at])))


def gather(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all bytes of the spans one after another, and where each span begins among them."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    return np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], end - start), offsets


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``first``, a span of each different content, and ``which``: for every span, the number of its content in ``first``.

    Contents are told by a 64-bit hash, and every span's bytes are then compared with those of the one that stands for it;
    those that differ (two contents of one hash) are told apart by their bytes.
    """
    _, first, which = np.unique(span_hash(prefix(data), start, end), return_index=True, return_inverse=True)
    rep = first[which]
    other = np.flatnonzero((end - start) != (end - start)[rep])
    same = np.ones(len(start), bool)
    same[other] = False
    at, offsets = gather(start[same], end[same])
    twin, _ = gather(start[rep[same]], end[rep[same]])
    unequal = data[at] != data[twin]
    if unequal.any():
        same[np.flatnonzero(same)[np.unique(np.searchsorted(offsets, np.flatnonzero(unequal), "right") - 1)]] = False
    if not same.all():
        more: dict[bytes, int] = {}
        firsts = list(first)
        for k in np.flatnonzero(~same):
            word = data[start[k] : end[k]].tobytes()
            if word not in more:
                more[word] = len(firsts)
                firsts.append(k)
            which[k] = more[word]
        first = np.array(firsts)
    return first, which
