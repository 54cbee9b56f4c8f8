"""numpy forms of the metrics, over blocks of vectors, and the conversion of Arrow list columns to matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TINY = 1e-30


def matrix(column: pa.ChunkedArray | pa.Array, dim: int, dtype=np.float32) -> np.ndarray:
    """Rows of an Arrow list column, all of which have dim elements without nulls, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in the precision of x; rows of length 0 stay zero."""
    n = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    return (x / np.where(n < TINY**0.5, 1.0, n)[:, None]).astype(x.dtype)


def _cos(a, b):
    d = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
    return 1.0 if d < TINY else 1.0 - (a * b).sum() / d


SCALAR = {"cosine": _cos, "unit_cosine": lambda a, b: 1.0 - (a * b).sum(), "sqeuclidean": lambda a, b: ((a - b) ** 2).sum(), "euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum())}


def known(metric) -> None:
    """Raise unless a metric has a numpy form: a name in SCALAR, or an object with a kernel (see vectors.CustomMetric)."""
    if metric not in SCALAR if isinstance(metric, str) else not callable(getattr(metric, "kernel", None)):
        raise ValueError(f"no numpy form of metric {metric!r}; known: {', '.join(SCALAR)}, or a CustomMetric")


def block(name, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of every row of q to every row of x by matrix product, good to about 1e-13 in double precision."""
    known(name)
    if not isinstance(name, str):
        return np.asarray(name.kernel(q, x), np.float64)
    g = q @ x.T
    if name == "unit_cosine":
        return 1.0 - g
    qq, xx = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", x, x)
    if name == "cosine":
        d = np.sqrt(qq)[:, None] * np.sqrt(xx)[None, :]
        return np.where(d < TINY, 1.0, 1.0 - g / np.where(d < TINY, 1.0, d))
    s = np.maximum(qq[:, None] + xx[None, :] - 2.0 * g, 0.0)
    return np.sqrt(s) if name == "euclidean" else s


def rowwise(name, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distance of row i of q to row i of x. Equal rows give bit-equal distances, so ties are real ties."""
    known(name)
    if not isinstance(name, str):
        return np.array([name.kernel(q[i : i + 1], x[i : i + 1])[0, 0] for i in range(len(q))], np.float64)
    if name in ("sqeuclidean", "euclidean"):
        s = ((q - x) ** 2).sum(axis=1)
        return np.sqrt(s) if name == "euclidean" else s
    g = (q * x).sum(axis=1)
    if name == "unit_cosine":
        return 1.0 - g
    d = np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1))
    return np.where(d < TINY, 1.0, 1.0 - g / np.where(d < TINY, 1.0, d))


def usable_rows(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask of usable rows of an Arrow list column, matrix of those rows): dim elements, none null, NaN or infinite, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    good = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False) == dim
    x = column.filter(pa.array(good)).flatten().cast(pa.float32()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    good[np.nonzero(good)[0][~fine]] = False
    return good, x[fine]


def pack(x: np.ndarray) -> list[bytes]:
    """Rows of single precision as bytes: half precision where that loses nothing, else single."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    small = (half.astype(np.float32) == x).all(axis=1)
    return [half[i].tobytes() if small[i] else x[i].tobytes() for i in range(len(x))]


def unpack(rows: list[bytes], dim: int, dtype=np.float64) -> np.ndarray:
    """The matrix of rows packed by pack."""
    out = np.empty((len(rows), dim), dtype)
    small = np.array([len(v) == 2 * dim for v in rows], bool)
    for mask, kind in ((small, np.float16), (~small, np.float32)):
        at = np.nonzero(mask)[0]
        if len(at):
            out[at] = np.frombuffer(b"".join([rows[i] for i in at]), kind).reshape(-1, dim)
    return out


def unpack_column(column: pa.ChunkedArray | pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    """The matrix of an Arrow binary column, without nulls, of rows packed by pack."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not pa.types.is_binary(column.type):
        return unpack(column.to_pylist(), dim, dtype)
    out = np.empty((len(column), dim), dtype)
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for n, kind in ((2 * dim, np.float16), (4 * dim, np.float32)):
        at = np.nonzero(size == n)[0]
        if len(at):
            part = column if len(at) == len(column) else column.take(pa.array(at))
            begin = np.frombuffer(part.buffers()[1], np.int32)[part.offset]
            out[at] = np.frombuffer(part.buffers()[2], kind, len(at) * dim, int(begin)).reshape(-1, dim)
    return out
