"""The k best rows of each query in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Best:
    """The k best so far of each query among what passed its bound; the bound rises as they are found. Rows beyond `most` and the k of each are cut."""

    def __init__(self, bounds: np.ndarray, k: int, most: int):
        self.bounds, self.k, self.most, self.parts, self.rows = bounds.copy(), k, most, [], 0

    def add(self, q: np.ndarray, docs: pa.Array, scores: np.ndarray) -> None:
        if not len(q):
            return
        self.parts.append(pa.table({"q": pa.array(q, pa.int64()), "score": pa.array(scores, pa.float64()), "doc": docs}))
        self.rows += len(q)
        if self.rows > self.most + len(self.bounds) * self.k:
            self.cut()

    def cut(self) -> pa.Table | None:
        if not self.parts:
            return None
        held = pa.concat_tables(self.parts).sort_by([("q", "ascending"), ("score", "descending"), ("doc", "ascending")])
        q = held.column("q").to_numpy()
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        kth = np.flatnonzero(place == self.k - 1)
        self.bounds[q[kth]] = np.maximum(self.bounds[q[kth]], held.column("score").to_numpy()[kth])
        held = held.filter(pa.array(place < self.k))
        self.parts, self.rows = [held], held.num_rows
        return held
