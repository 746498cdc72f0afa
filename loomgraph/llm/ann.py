"""Nearest neighbours with randomly rotated one-bit codes.

*Index.* Every vector is taken relative to the mean of all, rotated by a random
orthogonal matrix of fixed seed, and kept as the packed signs of its coordinates
with two scalars: its distance to the mean and how well the signs represent its
direction. ``encode_all`` does that once for every row.

*Search.* A query's rotated coordinates are rounded to ``PLANES`` bits; from and-ed
bit planes and population counts follows its inner product with the signs, and
from that an unbiased estimate of the distance, with a bound of ``BOUND`` standard
deviations, to which the rounding is added at its worst. The exact distances of
the vectors with the best estimates set a limit; only vectors whose lower bound
isn't above it are computed exactly.

The queries, a stated set, meet all vectors in blocks: vectors are dealt to
groups of bounded size by a hash of their row, queries likewise, and every pair of
groups is one task's work, which returns k rows for each query; those of all
groups are merged. Nothing is broadcast, nothing pairwise leaves a task. A
vector travels with its code once for each group of queries: on vectors without
clusters a sixth of all pass the bound, so fetching those for each query apart
would move far more.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without id; rows that repeat an id are
vectors of their own, as candidates and as queries, and only a query's own row is
left out; only vectors of equal length are compared; ties go to the smaller id;
other columns play no part; empty tables give empty tables.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise
from .memory import tidy
from .rows import number

#: Bytes of the vectors of a group, and of the queries of a group, at the mean.
GROUP_BYTES = 16 << 20
#: The error bound in standard deviations.
BOUND = 3.0
#: Bits that a query's coordinates are rounded to.
PLANES = 8
#: Times k vectors with the best estimates set the limit.
FIRST = 4
SEED = 17


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def words_of(dim: int) -> int:
    """Words of 64 bits in a code."""
    return -(-dim // 64)


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    wide = np.zeros((len(bits), 64 * words_of(bits.shape[1])), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated residuals, their lengths, and the inner products of direction and signs."""
    y = (x - centre) @ turn.T
    size = np.linalg.norm(y, axis=1)
    ideal = np.abs(y).sum(axis=1) / (np.maximum(size, 1e-300) * math.sqrt(x.shape[1]))
    return pack(y > 0), size, np.where(size > 0, ideal, 1.0)


def estimates(codes: np.ndarray, size: np.ndarray, ideal: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated squared distances to one query, and what they may be too large by. y: the query's rotated residual."""
    dim = len(y)
    low = float(y.min())
    step = (float(y.max()) - low) / (2**PLANES - 1) or 1.0
    whole = np.clip(np.rint((y - low) / step), 0, 2**PLANES - 1).astype(np.int64)
    planes = pack((whole[None, :] >> np.arange(PLANES)[:, None]) & 1 > 0)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    # the rounded coordinates where the sign is set, summed up
    dot = np.zeros(len(codes), np.int64)
    for j in range(PLANES):
        dot += np.bitwise_count(codes & planes[j]).sum(axis=1, dtype=np.int64) << j
    rounded = low + step * whole
    product = (2 * (low * ones + step * dot) - rounded.sum()) / math.sqrt(dim)
    off = np.abs(y - rounded).sum() / math.sqrt(dim)
    length = float(np.linalg.norm(y))
    spread = np.sqrt(np.maximum(1 - ideal**2, 0)) / ideal / math.sqrt(max(dim - 1, 1))
    middle = length**2 + size**2 - 2 * product / ideal * size
    error = 2 * size * (BOUND * length * spread + off / ideal)
    return middle, error + 1e-9 * (1 + length**2 + size**2)  # of rounding


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added in order."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        d = x[:, k] - q[k]
        total += d * d
    return np.sqrt(total)


def search_block(ids: np.ndarray, rows: np.ndarray, x: np.ndarray, codes: np.ndarray, size: np.ndarray, ideal: np.ndarray, queries: list[tuple[int, int, np.ndarray]], centre: np.ndarray, k: int) -> tuple[list, int]:
    """queries: id, row, vector. (query's id, its row, id, distance) of each query's k nearest in this block, and how many distances were computed."""
    turn = rotation(x.shape[1])
    found, reranked = [], 0
    for query_id, query_row, q in queries:
        others = rows != query_row
        if not others.any():
            continue
        middle, error = estimates(codes, size, ideal, (q - centre) @ turn.T)
        middle[~others] = np.inf
        first = np.argpartition(middle, FIRST * k)[: FIRST * k] if len(x) > FIRST * k else np.arange(len(x))
        first = first[others[first]]
        known = distances(x[first], q)
        limit = np.partition(known, k - 1)[k - 1] ** 2 * (1 + 1e-12) if len(known) >= k else np.inf
        some = np.flatnonzero((middle - error <= limit) & others)
        some = np.setdiff1d(some, first, assume_unique=True)
        d = np.concatenate([known, distances(x[some], q)])
        all_ = np.concatenate([first, some])
        reranked += len(all_)
        best = np.lexsort((rows[all_], ids[all_], d))[:k]
        found += [(query_id, query_row, int(ids[all_[b]]), float(d[b])) for b in best]
    return found, reranked


def sound(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """row, id, x, dim of the rows that take part, written once."""
    v = vectors.select(number().alias("row"), F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    good = F.col("id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))) & F.exists("x", lambda c: c != 0)
    return materialise(vectors.sparkSession, v.where(good).withColumn("dim", F.size("x")), "vectors")


def centres(v: DataFrame) -> dict[int, np.ndarray]:
    """The mean of the vectors of each length: a row for each length and coordinate."""

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, x in _by_length(b.column(0)):
                total[dim] = total.get(dim, 0) + np.append(x[1].sum(axis=0), len(x[1]))
        for dim, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim + 1, dim, np.int32)), pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array(t)], names=["dim", "at", "s"])

    out: dict[int, np.ndarray] = {}
    for r in v.select("x").mapInArrow(tidy(sums), "dim int, at int, s double").groupBy("dim", "at").agg(F.sum("s").alias("s")).collect():
        out.setdefault(r.dim, np.zeros(r.dim + 1))[r.at] = r.s
    return {d: t[:-1] / t[-1] for d, t in out.items()}


def _by_length(column: pa.Array):
    """(dim, (places, matrix)) of a list column without nulls."""
    dims = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() :]
    starts = np.cumsum(dims) - dims
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, (at, flat[starts[at][:, None] + np.arange(dim)])


def encode_all(v: DataFrame, mean: dict[int, np.ndarray]) -> DataFrame:
    """The index: v with code, size and ideal of each row, written once."""

    def run(batches):
        turns = {}
        for b in batches:
            n = b.num_rows
            code, size, ideal = np.empty(n, object), np.zeros(n), np.zeros(n)
            for dim, (at, x) in _by_length(b.column(2)):
                turns[dim] = turns[dim] if dim in turns else rotation(dim)
                c, size[at], ideal[at] = encode(x, mean[dim], turns[dim])
                for k, own in zip(at.tolist(), c, strict=True):
                    code[k] = own.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(code), pa.binary()), pa.array(size), pa.array(ideal)], names=[*b.schema.names, "code", "size", "ideal"])

    return materialise(v.sparkSession, v.mapInArrow(tidy(run), "row long, id long, x array<double>, dim int, code binary, size double, ideal double"), "codes")


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank, ``key``, score: the k nearest others of each row whose id is divisible by ``every``."""
    v = sound(vectors, key, vector)
    mean = centres(v)
    index = encode_all(v, mean)
    discard(v)
    sizes = {r.dim: (r.n, r.q) for r in index.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).collect()}
    groups = {d: max(1, -(-n * d * 8 // group_bytes)) for d, (n, _) in sizes.items()} or {0: 1}
    query_groups = {d: max(1, -(-q * d * 8 // group_bytes)) for d, (_, q) in sizes.items()} or {0: 1}

    def count_of(by: dict[int, int]):
        return F.element_at(F.create_map(*[F.lit(x) for pair in by.items() for x in pair]), F.col("dim"))

    place = lambda by: F.pmod(F.xxhash64("row"), count_of(by)).cast("int")
    copies = lambda by: F.explode(F.sequence(F.lit(0), count_of(by) - 1))
    data = index.select("dim", place(groups).alias("g"), copies(query_groups).alias("h"), "row", "id", "x", "code", "size", "ideal")
    asked = index.where(F.col("id") % every == 0).select("dim", copies(groups).alias("g"), place(query_groups).alias("h"), "row", "id", "x")

    def compare(key_of, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        if len(left) and len(right):
            x, dim = np.stack(left["x"].to_numpy()), int(key_of[0])
            codes = np.frombuffer(b"".join(left["code"]), np.uint64).reshape(len(x), -1)
            queries = list(zip(right["id"].tolist(), right["row"].tolist(), map(np.asarray, right["x"]), strict=True))
            found, _ = search_block(left["id"].to_numpy(), left["row"].to_numpy(), x, codes, left["size"].to_numpy(), left["ideal"].to_numpy(), queries, mean[dim], k)
        return pd.DataFrame(found, columns=["query_id", "query_row", "id", "score"]).astype({"query_id": "int64", "query_row": "int64", "id": "int64", "score": "float64"})

    by = ["dim", "g", "h"]
    found = data.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(compare, "query_id long, query_row long, id long, score double")
    # the k best of all groups: an aggregate that sorts k rows for each group of vectors
    best = found.groupBy("query_id", "query_row").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "id"))), 1, k).alias("best"))
    out = best.select("query_id", F.posexplode("best").alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias(key), F.col("b.score").alias("score"))


def nearest_sql(every: int = 100, k: int = 10) -> str:
    return f"""
    WITH e AS (SELECT row_number() OVER () AS r, vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    v AS (SELECT * FROM e
        WHERE id IS NOT NULL AND len(x) > 0 AND list_bool_and(list_transform(x, lambda c: c IS NOT NULL AND isfinite(c)))
            AND list_bool_or(list_transform(x, lambda c: c <> 0))),
    q AS (SELECT * FROM v WHERE id % {every} = 0),
    p AS (SELECT q.r AS query_row, q.id AS query_id, v.id AS vec_id, list_sum(list_transform(list_zip(v.x, q.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS s
        FROM q JOIN v ON q.r <> v.r AND len(q.x) = len(v.x)),
    n AS (SELECT query_id, vec_id, sqrt(s) AS score, row_number() OVER (PARTITION BY query_row ORDER BY sqrt(s), vec_id) AS rank FROM p)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM n WHERE rank <= {k}"""
