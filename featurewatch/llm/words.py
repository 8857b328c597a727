"""Words of a piece of text as arrays: where they start, their document, and the distinct ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from featurewatch.llm.arrow_text import binary_parts


class Words:
    """Maximal runs of bytes for which ``inside`` (256 flags) holds, never across documents."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        raw, offsets = raw[offsets[0]:offsets[-1]], offsets - offsets[0]
        self.n_docs = len(offsets) - 1
        flags = inside[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[offsets] = True
        edge = flags[1:] & flags[:-1] & ~cut[1:-1]
        self.start = np.flatnonzero(flags & ~np.r_[False, edge][:len(raw)])
        self.end = np.flatnonzero(flags & ~np.r_[edge, False][:len(raw)]) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.bounds = np.searchsorted(self.start, offsets)            # first word of each document
        size = self.end - self.start
        at = np.r_[0, np.cumsum(size)].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(raw[flags].tobytes())])
        coded = words.dictionary_encode()
        self.code = coded.indices.to_numpy()
        ends, own = binary_parts(coded.dictionary)
        own, ends = own.tobytes(), ends.tolist()
        self.distinct = [own[a:b] for a, b in zip(ends, ends[1:], strict=False)]
