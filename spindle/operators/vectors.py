"""Exact cosine search for a batch of query vectors, with predicates on the rows' fields."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries and rows that one group of the search holds, about.
QUERY_BLOCK, ROW_SLICE = 8192, 16384
#: Pairs of a query and a row that are looked at together, and pairs whose exact scores are.
CELLS, CHUNK = 1 << 21, 1 << 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine within [0, 1]; 0 for vectors that are empty, of different length or without length."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    fit = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.when(fit, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / (na * nb)))).otherwise(0.0)


def predicate(clause: dict | None, fields: dict[str, str]) -> Column:
    """A Column for a nested clause of $and, $or and, on fields, a value or $eq, $ne, $in.

    fields: their names and types. A missing field is null: equal only to null, different from any
    value, in no list. Operators that aren't known hold.
    """
    if not clause:
        return F.lit(True)
    parts = []
    for key, want in clause.items():
        if key in ("$and", "$or"):
            join = (lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b)
            parts.append(reduce(join, [predicate(c, fields) for c in want], F.lit(key == "$and")))
            continue
        field = F.col(key) if key in fields else F.lit(None)
        for op, value in want.items() if isinstance(want, dict) else (("$eq", want),):
            if op == "$eq":
                parts.append(field.eqNullSafe(F.lit(value)))
            elif op == "$ne":
                parts.append(~field.eqNullSafe(F.lit(value)))
            elif op == "$in":
                parts.append(F.coalesce(field.isin(*value), F.lit(False)) if value else F.lit(False))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def clause_of(options: dict[str, object]) -> dict | None:
    """Optional filters as one clause: none, a bare one or an $and."""
    given = [{k: v if not isinstance(v, (list, tuple)) else {"$in": list(v)}} for k, v in options.items() if v is not None]
    return None if not given else given[0] if len(given) == 1 else {"$and": given}


def top_k(queries: DataFrame, rows: DataFrame, k: int, where: Column | None = None, block: int = QUERY_BLOCK, part: int = ROW_SLICE) -> DataFrame:
    """query_id, vec_id, score and rank of the k nearest rows of each query; equal scores go by vec_id.

    queries: (query_id, query), one row each. Both sides are counted and dealt by their ids, queries to
    blocks of about block and rows to slices of about part; each pair of a block and a slice is one
    group of a shuffle, so a task's memory doesn't grow with the tables, and nothing is broadcast. A group gives its own k
    best of a query; those of all slices are ranked.
    """
    rows = rows if where is None else rows.where(where)
    blocks, slices = (max(1, -(-df.count() // most)) for df, most in ((queries, block), (rows, part)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = rows.select("vec_id", "embedding", dealt("vec_id", slices).alias("_slice"), every(blocks).alias("_block"))
    asked = queries.select("query_id", "query", dealt("query_id", blocks).alias("_block"), every(slices).alias("_slice"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left["vec_id"], null_placement="at_start"))
        q, r, score = _best(_Vectors(right["query"]), _Vectors(left["embedding"]), max(1, k))
        return pa.table({"query_id": right["query_id"].take(pa.array(q)), "vec_id": left["vec_id"].take(pa.array(r)), "score": score})

    types = dict(queries.dtypes) | dict(rows.dtypes)
    found = own.groupBy("_slice", "_block").cogroup(asked.groupBy("_slice", "_block")).applyInArrow(run, f"query_id {types['query_id']}, vec_id {types['vec_id']}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= max(1, k))


class _Vectors:
    """Vectors of a column by length: doubles, their sums of squares, added up in order, and unit vectors in short floats.

    Those that are null or empty, hold a null or have no length are in none of groups and score 0.
    """

    def __init__(self, column: pa.ChunkedArray):
        lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        self.n = len(lists)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
        first, whole = np.cumsum(sizes) - sizes, sizes > 0
        if flat.null_count:
            whole[np.repeat(np.arange(self.n), sizes)[flat.is_null().to_numpy(zero_copy_only=False)]] = False
        self.groups = {}
        for d in np.unique(sizes[whole]).tolist():
            at = np.flatnonzero(whole & (sizes == d))
            by_place = np.ascontiguousarray(values[first[at] + np.arange(d)[:, None]])
            square = _in_order(by_place, by_place)
            at, by_place, square = (x[..., ~(square <= 0)] for x in (at, by_place, square))
            with np.errstate(all="ignore"):
                unit = np.nan_to_num((by_place / np.sqrt(square)).T.astype(np.float32), nan=0.0, posinf=0.0, neginf=0.0)
            if len(at):
                self.groups[d] = at, by_place, square, unit


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products over the first axis, in its order: the same for a pair wherever it lies, which products of matrices are not."""
    out = np.zeros(a.shape[1])
    with np.errstate(all="ignore"):
        for x, y in zip(a, b, strict=True):
            out += x * y
    return out


def _exact(a: np.ndarray, aa: np.ndarray, b: np.ndarray, bb: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        length = np.sqrt(aa * bb)
        length = np.where((length > 0) & (length < np.inf), length, np.sqrt(aa) * np.sqrt(bb))
        out = _in_order(a, b) / length
    return np.where(np.isnan(out), 1.0, np.clip(out, 0.0, 1.0))  # as least and greatest have it


def _best(queries: _Vectors, rows: _Vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and rows, and scores, of the k best rows of each query; of equal ones the first rows.

    A product of unit vectors tells which rows may be among them, within what short floats miss; their scores are computed one by one.
    """
    n, out = rows.n, []
    if not n or not queries.n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    unfit = np.ones(queries.n, bool)
    for d, (at, by_place, square, unit) in queries.groups.items():
        if d not in rows.groups:
            continue
        unfit[at] = False
        row_at, row_by_place, row_square, row_unit = rows.groups[d]
        place = np.full(n, -1)
        place[row_at] = np.arange(len(row_at))
        odd = row_at[~np.isfinite(row_square)]
        miss = (d + 4) * 2.5e-7
        step = max(1, CELLS // n)
        for low in range(0, len(at), step):
            near = unit[low : low + step] @ row_unit.T
            if len(row_at) < n:
                whole = np.zeros((len(near), n), np.float32)
                whole[:, row_at] = near
                near = whole
            np.maximum(near, 0, out=near)
            near[:, odd] = -1
            bound = _bound(near, k) - miss
            bound[~np.isfinite(square[low : low + step])] = -1
            may = near >= bound[:, None]
            may[:, odd] = True
            q, r = np.nonzero(may)
            own, p = q + low, place[r]
            score = np.zeros(len(q))
            fit = np.flatnonzero(p >= 0)
            for a in range(0, len(fit), CHUNK):
                f = fit[a : a + CHUNK]
                score[f] = _exact(by_place[:, own[f]], square[own[f]], row_by_place[:, p[f]], row_square[p[f]])
            order = np.lexsort((r, -score, q))
            q, r, score, own = q[order], r[order], score[order], own[order]
            kept = np.arange(len(q)) - np.searchsorted(q, q) < k
            out.append((at[own[kept]], r[kept], score[kept]))
    none, few = np.flatnonzero(unfit), min(k, n)
    out.append((np.repeat(none, few), np.tile(np.arange(few), len(none)), np.zeros(len(none) * few)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bound(near: np.ndarray, k: int) -> np.ndarray:
    """A value that k entries of each line reach: the k-th of the greatest of its pieces, or of all where there are few."""
    n = near.shape[1]
    size = n // (8 * k)
    if size >= 4:
        near = near[:, : n // size * size].reshape(len(near), -1, size).max(axis=2)
    n = near.shape[1]
    return np.partition(near, n - k, axis=1)[:, n - k] if n > k else np.full(len(near), -1.0, np.float32)


def search(queries: DataFrame, rows: DataFrame, *, k: int = 10, multiplier: int = 3, most: int = 50, threshold: float = 0.0, where: Column | None = None, residual: Column | None = None) -> DataFrame:
    """Filtered search: the nearest min(most, k * multiplier) rows under where, of them the first k
    above threshold under residual, which is looked at after the first cut and may leave fewer."""
    found = top_k(queries, rows, min(most, max(k, k * multiplier)), where).where(F.col("score") >= threshold)
    if residual is not None:
        found = found.join(rows.where(residual).select("vec_id"), "vec_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")
