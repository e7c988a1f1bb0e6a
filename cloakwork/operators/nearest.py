"""Vectors nearest to a stated set of queries, and the rank of a query's own: exact, all pairs of a label.

Vectors and queries of a label are dealt to parts of bounded size by a hash of their ids, and each pair of parts is a group: what a task
holds has a bound, and a label with most of the rows is many tasks' work. In a group products are summed one dimension after the other for
many pairs at once, in the order of the dimensions, so that equal vectors have equal similarities wherever they lie; a group hands on a
few rows a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors, or queries, of a part on average; queries that are compared at once.
PART, ABREAST = 4096, 16

Told = Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def _sized(lists: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By number of dimensions the rows, their numbers (dimensions x rows) and norms; null rows and those that hold a null are left out."""
    column = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    numbers, empty = flat.to_numpy(zero_copy_only=False).astype(np.float64), flat.is_null().to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    out = {}
    for d in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        at = starts[rows][:, None] + np.arange(d)
        whole = ~empty[at].any(axis=1)
        rows, m = rows[whole], np.ascontiguousarray(numbers[at[whole]].T)
        squares = np.zeros(len(rows))
        for x in m:
            squares += x * x
        out[d] = rows, m, np.sqrt(squares)
    return out


def cosines(vectors: pa.ChunkedArray, queries: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of queries, a few at a time, and their similarities (queries x vectors) as they rank: infinity for what isn't a number, which SQL
    ranks first, and minus infinity where there is none (a null, or another number of dimensions), which comes last."""
    held, asked = _sized(vectors), _sized(queries)
    rest = np.setdiff1d(np.arange(len(queries)), np.concatenate([rows for rows, *_ in asked.values()] or [np.array([], int)]))
    for d, (rows, m, norms) in (*asked.items(), (-1, (rest, None, None))):
        among, v, v_norms = held.get(d, (None, None, None))
        for i in range(0, len(rows), ABREAST):
            out = np.full((len(rows[i : i + ABREAST]), len(vectors)), -np.inf)
            if among is not None:
                dots, product = np.zeros((len(out), len(among))), np.empty((len(out), len(among)))
                for x, y in zip(v, m[:, i : i + ABREAST]):
                    dots += np.multiply(x, y[:, None], out=product)
                with np.errstate(all="ignore"):
                    dots /= v_norms * norms[i : i + ABREAST, None]
                out[:, among] = np.where(np.isnan(dots), np.inf, dots)
            yield rows[i : i + ABREAST], out


def compared(vectors: DataFrame, queries: DataFrame, told: Told, schema: str, asked: DataFrame | None = None, part: int = PART) -> DataFrame:
    """query_id, label and what told says of each pair of parts, columns of schema: told(vectors, queries, rows of queries, their similarities,
    other), where other is False for a query and itself, gives arrays by name, with the rows of queries that they are of as 'row'.
    vectors (vec_id, label, embedding, ...), queries (query_id, label, q, ...); asked: a table that has the queries, where it is cheaper to count."""
    parts = lambda df, name: df.groupBy("label").agg(F.ceil(F.count("*") / part).alias(name))
    sizes = parts(vectors, "_nv").join(parts(queries if asked is None else asked, "_nq"), "label")

    def dealt(df: DataFrame, key: str, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_other) - 1))
        # columns anew, since both sides may be of one table
        anew = [F.col(c).alias(c) for c in df.columns]
        return df.where(F.col(key).isNotNull()).join(sizes, "label").select(*anew, F.pmod(F.xxhash64(key), n_own).alias(own), every.alias(other))

    names = [c.split()[0] for c in schema.split(", ")]

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asking = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        found = [told(left, right, rows, near, ids != asking[rows, None]) for rows, near in (cosines(left["embedding"], right["q"]) if len(left) else ())]
        all_of = lambda c: np.concatenate([f[c] for f in found]) if found else np.array([], int)
        row = pa.array(all_of("row"), pa.int64())
        return pa.table([right["query_id"].take(row), right["label"].take(row), *(pa.array(all_of(c), from_pandas=True) for c in names)], ["query_id", "label", *names])

    keys = ["label", "_v", "_q"]
    of = {f.name: f.dataType.simpleString() for f in queries.schema}
    v, q = dealt(vectors, "vec_id", "_v", "_nv", "_q", "_nq"), dealt(queries, "query_id", "_q", "_nq", "_v", "_nv")
    return v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(both, f"query_id {of['query_id']}, label {of['label']}, {schema}")


def best(vectors: DataFrame, queries: DataFrame, k: int, part: int = PART) -> DataFrame:
    """query_id, label, vec_id, similarity (as in cosines) of at least the k best of each query, ties by id: the k best of each part."""

    def told(left: pa.Table, right: pa.Table, rows: np.ndarray, near: np.ndarray, other: np.ndarray) -> dict:
        ids, n = left["vec_id"].to_numpy(), near.shape[1]
        near = np.where(other, near, -np.inf)
        least = n - min(n, k + int((~other).sum(axis=1).max()))
        i, j = np.nonzero((near >= np.partition(near, least, axis=1)[:, least, None]) & other)
        order = np.lexsort((ids[j], -near[i, j], i))
        i, j = i[order], j[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j = i[kept], j[kept]
        return {"row": rows[i], "vec_id": ids[j], "similarity": near[i, j]}

    return compared(vectors, queries, told, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, similarity double", part=part)


def own_ranks(vectors: DataFrame, queries: DataFrame, part: int = PART) -> DataFrame:
    """query_id, label, top (the best similarity of any vector, as in cosines) and rank: that of the best vector that is the query's own (a column
    own of vectors), among all other vectors of its label, ties by id. Queries without an own vector are left out."""

    def first(left: pa.Table, right: pa.Table, rows: np.ndarray, near: np.ndarray, other: np.ndarray) -> dict:
        ids, any_ = left["vec_id"].to_numpy(), other.any(axis=1)
        own = other & left["own"].fill_null(False).to_numpy()
        own_near = np.where(own, near, -np.inf).max(axis=1)
        at = own & (near == own_near[:, None])
        own_id = np.where(at, ids, np.iinfo(ids.dtype).max).min(axis=1)
        return {"row": rows[any_], "top": np.where(other, near, -np.inf).max(axis=1)[any_], "own_near": np.where(own.any(axis=1), own_near, np.nan)[any_], "own_id": own_id[any_]}

    def ahead(left: pa.Table, right: pa.Table, rows: np.ndarray, near: np.ndarray, other: np.ndarray) -> dict:
        ids = left["vec_id"].to_numpy()
        own_near, own_id = (right[c].to_numpy()[rows, None] for c in ("own_near", "own_id"))
        return {"row": rows, "ahead": (other & ((near > own_near) | ((near == own_near) & (ids <= own_id)))).sum(axis=1)}

    key = ["query_id", "label"]
    told = compared(vectors, queries, first, "top double, own_near double, own_id long", part=part)
    # an own vector of no similarity comes last, and one of none isn't there
    own = F.min(F.when(F.col("own_near").isNotNull(), F.struct((-F.col("own_near")).alias("far"), "own_id")))
    owned = told.groupBy(*key).agg(F.max("top").alias("top"), own.alias("own")).where("own is not null")
    placed = queries.join(owned, key).select(*key, "q", "top", (-F.col("own.far")).alias("own_near"), F.col("own.own_id").alias("own_id"))
    ranks = compared(vectors, placed, ahead, "ahead long", queries, part).groupBy(*key).agg(F.sum("ahead").alias("rank"))
    return owned.select(*key, "top").join(ranks, key)


def similarity(near: Column) -> Column:
    """A similarity as it is told: null where there is none, and not a number where it isn't one."""
    return F.when(near == float("inf"), float("nan")).when(near != float("-inf"), near)
