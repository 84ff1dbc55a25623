"""Best matches between two bounded blocks of vectors, inside one task.

Approximate values come from a float32 matrix product; every pair that could
still be among the best k within its error bound is then recomputed in double,
so the result is exact and equal vectors always tie, whatever block they are in.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

METRICS = ("l2", "cosine")

# A tile of approximate values is 4 MiB, and a chunk of exact vectors 4 MiB at 64 floats: a task holds a few of each.
_TILE_LEFT = 256
_TILE_RIGHT = 4096
_PAIR_FLOATS = 1 << 19
_UNIT_ROUNDOFF = 2.0**-24


def vector_matrix(column) -> np.ndarray:
    """A list column of equally long vectors as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0), dtype=np.float32)
    lengths = pc.min_max(pc.list_value_length(column))
    dim, longest = lengths["min"].as_py(), lengths["max"].as_py()
    values = column.flatten()
    if column.null_count or values.null_count or dim != longest:
        raise ValueError("vectors must be present, complete and of one dimension")
    return values.to_numpy(zero_copy_only=False).reshape(len(column), dim)


def positions(groups) -> np.ndarray:
    """1-based position of each row within its run of equal group values."""
    place = np.arange(len(groups), dtype=np.int32)
    starts = np.ones(len(groups), dtype=bool)
    starts[1:] = groups[1:] != groups[:-1]
    first = np.maximum.accumulate(np.where(starts, place, 0).astype(np.int32))
    return place - first + 1


def keep_best(left, key, right, k) -> np.ndarray:
    """Positions of the k smallest (key, right) of each left index."""
    order = np.lexsort((right, key, left))
    return order[positions(left[order]) <= k]


def first_of_equal(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows that can be among the best k: of equal vectors, those with the k smallest ids."""
    if len(ids) <= k:
        return np.arange(len(ids))
    weights = np.random.default_rng(0).normal(size=vectors.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        mark = vectors @ weights
    if len(np.unique(mark)) > len(mark) - k:  # no vector occurs more than k times
        return np.arange(len(ids))
    _, group = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, group.ravel()))
    return np.sort(order[positions(group.ravel()[order]) <= k])


class BestMatches:
    """Running k best right-hand items of each left-hand vector.

    Ranks ascending by ``key``: the squared distance, or minus the cosine.
    Ties go to the smaller right id.
    """

    def __init__(self, left: np.ndarray, k: int, metric: str = "l2"):
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        self.metric = metric
        self.k = k
        self.left = left
        self.left_norm = np.concatenate([np.zeros(0)] + [
            np.sqrt(np.square(left[s:s + _TILE_RIGHT], dtype=np.float64).sum(axis=1)) for s in range(0, len(left), _TILE_RIGHT)])
        self._limit = np.full(len(left), np.inf)
        # Of each left vector its best so far, as many as there are: the columns grow up to k.
        self._count = np.zeros(len(left), dtype=np.int64)
        self._key = np.zeros((len(left), 0), dtype=np.float64)
        self._id = np.zeros((len(left), 0), dtype=np.int64)

    def _block(self, exact, norm):
        if self.metric == "cosine":
            exact = exact / np.where(norm > 0, norm, 1.0)[:, None]
        with np.errstate(over="ignore"):
            return exact.astype(np.float32)

    def update(self, right: np.ndarray, right_ids: np.ndarray, rows: np.ndarray | None = None):
        """Offer right-hand items to all left vectors, or to those in ``rows``, each named once."""
        if len(right) == 0 or len(self.left) == 0:
            return
        if right.shape[1] != self.left.shape[1]:
            raise ValueError("queries and items differ in dimension")
        if rows is None:
            rows = np.arange(len(self.left))
        for r in range(0, len(right), _TILE_RIGHT):
            exact = np.ascontiguousarray(right[r:r + _TILE_RIGHT], dtype=np.float64)
            ids = right_ids[r:r + _TILE_RIGHT]
            keep = first_of_equal(exact, ids, self.k)
            exact, ids = exact[keep], ids[keep]
            norm = np.sqrt(np.square(exact).sum(axis=1))
            block = self._block(exact, norm)
            for s in range(0, len(rows), _TILE_LEFT):
                tile = rows[s:s + _TILE_LEFT]
                self._merge(tile, *self._tile(tile, exact, norm, block, ids))

    def _merge(self, rows, near, key, ids):
        """Keep the best k of what the left vectors ``rows`` had and these candidates (``near`` is a place in ``rows``)."""
        if len(near) == 0:
            return
        place, column = np.nonzero(np.arange(self._key.shape[1])[None, :] < self._count[rows][:, None])
        held = rows[place]
        near = np.concatenate((place, near))
        key = np.concatenate((self._key[held, column], key))
        ids = np.concatenate((self._id[held, column], ids))
        best = keep_best(near, key, ids, self.k)
        near, key, ids = near[best], key[best], ids[best]
        column = positions(near) - 1
        wide = int(column.max()) + 1
        if wide > self._key.shape[1]:
            grown = ((0, 0), (0, wide - self._key.shape[1]))
            self._key, self._id = np.pad(self._key, grown), np.pad(self._id, grown)
        self._key[rows[near], column] = key
        self._id[rows[near], column] = ids
        self._count[rows] = np.bincount(near, minlength=len(rows))
        last = column == self.k - 1
        self._limit[rows[near[last]]] = key[last]

    def _tile(self, rows, exact, norm, block, ids):
        dim = exact.shape[1]
        unit = 4 * (dim + 8) * _UNIT_ROUNDOFF
        left = self._block(self.left[rows].astype(np.float64), self.left_norm[rows])
        with np.errstate(over="ignore", invalid="ignore"):
            if self.metric == "l2":
                left_sq, right_sq = np.square(self.left_norm[rows]), np.square(norm)
                slack = unit * (left_sq + right_sq.max())
                # Without the part that all values of a row share, which its limits lack too.
                shared, wide = left_sq, float(left_sq.max() + right_sq.max())
                approx = left @ block.T
                if 1e-25 < wide < 1e25:  # in single precision, as exact as the product is
                    approx *= np.float32(-2.0)
                    approx += right_sq.astype(np.float32)
                else:
                    approx = right_sq - 2.0 * approx.astype(np.float64)
            else:
                shared, slack = 0.0, np.full(len(rows), unit)
                approx = left @ block.T
                np.negative(approx, out=approx)
            limit = self._limit[rows]
            open_rows = ~np.isfinite(limit)
            if len(ids) > self.k and open_rows.any():
                of = approx if open_rows.all() else approx[open_rows]
                kth = np.partition(of, self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)
                limit[open_rows] = kth + (shared + slack)[open_rows]
            most = (limit + slack - shared).astype(approx.dtype)
            most = np.nextafter(most, approx.dtype.type(np.inf))
            # Written as "not greater", so values lost to overflow stay candidates.
            flat = np.flatnonzero(~(approx > most[:, None]))
        row, col = flat // approx.shape[1], flat % approx.shape[1]
        return row, self._exact(rows[row], col, exact, norm), ids[col]

    def _exact(self, left, col, right, right_norm):
        key = np.empty(len(left), dtype=np.float64)
        chunk = max(1, _PAIR_FLOATS // max(1, right.shape[1]))
        for s in range(0, len(left), chunk):
            a, b = left[s:s + chunk], col[s:s + chunk]
            if self.metric == "l2":
                key[s:s + chunk] = np.square(right[b] - self.left[a]).sum(axis=1)
            else:
                lengths = self.left_norm[a] * right_norm[b]
                dots = (right[b] * self.left[a]).sum(axis=1)
                positive = lengths > 0
                similarity = np.where(positive, dots / np.where(positive, lengths, 1.0), 0.0)
                key[s:s + chunk] = -similarity
        return key

    @property
    def _found(self):
        """Left index, key and right id of all that is held, by left index, best first."""
        left, column = np.nonzero(np.arange(self._key.shape[1])[None, :] < self._count[:, None])
        return left, self._key[left, column], self._id[left, column]

    def result(self):
        """Left index, value (distance or similarity), right id; best first."""
        left, key, right = self._found
        return left, (key if self.metric == "l2" else 0.0 - key), right
