"""Words of many texts at once: byte-level tokenising without a Python object per word.

A word is a run of bytes outside `[\\x20\\x09-\\x0D]`, with A-Z lower-cased. Equal words get one code by their bytes (Arrow's
dictionary encoding), so two words are never taken for one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
IS_WHITE = np.zeros(256, dtype=bool)
IS_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are taken at once, about.
CHUNK = 1 << 20


class Words:
    """Of some texts: where words begin and end in them, words per text, the code of every word, and the distinct words by code (kinds in Arrow)."""

    def __init__(self, column: pa.Array):
        bounds = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
        data = column.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
        bounds = bounds - bounds[0]
        black = ~IS_WHITE[raw]
        apart = np.zeros(len(raw) + 1, dtype=bool)  # a word can't go on over these places
        apart[bounds] = True
        first, last = black.copy(), black.copy()
        first[1:] &= ~black[:-1] | apart[1:-1]
        last[:-1] &= ~black[1:] | apart[1:-1]
        self.starts, self.ends = starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.per_text = np.diff(np.searchsorted(starts, bounds))
        offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
        self.tokens = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(LOWERED[raw[black]])])
        encoded = self.tokens.dictionary_encode()
        self.codes, self.kinds = encoded.indices.to_numpy(), encoded.dictionary

    @cached_property
    def distinct(self) -> list[bytes]:
        """Cut out of one buffer: Arrow would make a scalar object of each."""
        data = self.kinds.buffers()[2]
        bounds = np.frombuffer(self.kinds.buffers()[1], dtype=np.int32, count=len(self.kinds) + 1).tolist() if len(self.kinds) else []
        raw = data.to_pybytes() if data is not None else b""
        return [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def picked(self, mask: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The words under the mask as a binary array, and how many each text has."""
        text = np.repeat(np.arange(len(self.per_text)), self.per_text)
        return self.tokens.filter(pa.array(mask)), np.bincount(text[mask], minlength=len(self.per_text))


def chunks(column: pa.Array) -> Iterator[pa.Array]:
    """A binary column in slices of about CHUNK bytes; a longer text is a slice of its own."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.binary()) if column.type != pa.binary() else column
    sizes = np.cumsum([0 if x is None else x for x in pc.binary_length(column).to_pylist()])
    begin, done = 0, 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(sizes, done + CHUNK, "right")))
        yield column.slice(begin, end - begin)
        begin, done = end, int(sizes[end - 1])
