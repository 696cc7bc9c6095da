"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one word of each of several full-dimensional codebooks, fitted one on the
residuals of the other; beam search picks the words. With the norm of the sum stored, the cosine with a query needs one
table lookup a codebook. The best by that score are then scored again with the original vectors, and with them every row that
can still be among the nearest: the distance of the sum from the vector, which is stored too, bounds what the score hides.

The index is a table (id, codes, norm, miss, vector) in the order of the input's partitions. Queries come in blocks of bounded
size; every task scores a block against its own rows and passes on the few best of each query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import kept


@dataclass(frozen=True)
class Settings:
    """books codebooks of words words; beam: partial sums that encoding follows. sample: vectors that the codebooks are
    fitted on, drawn by a hash of the id. rerank: candidates of each slice and query that are scored exactly first. block:
    queries that are sent out together."""

    books: int = 8
    words: int = 64
    beam: int = 8
    sample: int = 8192
    rounds: int = 8
    rerank: int = 64
    block: int = 8192


def usable(vector: str = "vector"):
    """Vectors that take part: not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that the largest component of each is from 0.5 to under 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if x.size else x


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_codebooks(x: np.ndarray, s: Settings) -> np.ndarray:
    """books x words x dims: k-means on what the codebooks before leave over."""
    rng, rest, books = np.random.default_rng(1), x.astype(np.float32).copy(), []
    for _ in range(s.books):
        centres = rest[rng.choice(len(rest), s.words, replace=len(rest) < s.words)].copy()
        for _ in range(s.rounds):
            near = np.argmin((centres * centres).sum(axis=1) - 2 * rest @ centres.T, axis=1)
            n = np.bincount(near, minlength=s.words)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, rest)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        near = np.argmin((centres * centres).sum(axis=1) - 2 * rest @ centres.T, axis=1)
        rest = rest - centres[near]
        books.append(centres)
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """The words of each vector, by beam search over the codebooks."""
    m, k, _ = books.shape
    out = np.empty((len(x), m), np.uint8 if k <= 256 else np.uint16)
    cross = np.einsum("akd,bld->abkl", books, books)
    square = np.einsum("akd,akd->ak", books, books)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024].astype(np.float32)
        dots = np.einsum("nd,akd->ank", part, books, optimize=True)
        codes, cost = np.zeros((len(part), 1, 0), np.int64), np.zeros((len(part), 1), np.float32)
        for a in range(m):
            step = (square[a] - 2 * dots[a])[:, None, :] + cost[:, :, None]
            for b in range(a):
                step += 2 * cross[a, b].T[codes[:, :, b]]
            flat = step.reshape(len(part), -1)
            n = min(beam if a < m - 1 else 1, flat.shape[1])
            best = np.argpartition(flat, n - 1, axis=1)[:, :n]
            cost = np.take_along_axis(flat, best, axis=1)
            codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], axis=1), (best % k)[:, :, None]], axis=2)
        out[at : at + 1024] = codes[:, 0]
    return out


def _matrix(column, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dims)


def build_index(rows: DataFrame, dims: int, s: Settings) -> tuple[DataFrame, np.ndarray]:
    """The index of rows (id, vector) of dims components, and the codebooks."""
    total = rows.count()
    draw = (F.xxhash64("id", F.lit(3)).bitwiseAND(F.lit((1 << 32) - 1)) / float(1 << 32)) < min(1.0, s.sample / max(1, total))
    # an id that fills much of the table is one row of the sample
    sample = rows.where(draw).groupBy("id").agg(F.min("vector").alias("vector")).select("vector").toArrow()
    x = _matrix(sample.column("vector"), dims)
    if not len(x):
        x = _matrix(rows.select("vector").limit(s.words).toArrow().column("vector"), dims)
    books = fit_codebooks(unit(x), s)
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def index(batches):
        books = shared.value
        for batch in batches:
            x = unit(_matrix(batch.column(1), dims))
            codes = encode(x, books, s.beam)
            total = books[np.arange(len(books)), codes.astype(np.int64)].sum(axis=1)
            norm = np.sqrt((total * total).sum(axis=1))
            miss = np.sqrt(((x - total) ** 2).sum(axis=1))
            flat = pa.array(codes.astype(np.int16).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(books)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(norm.astype(np.float32)), pa.array(miss.astype(np.float32)), batch.column(1)], ["id", "codes", "norm", "miss", "vector"])

    return kept(rows.mapInArrow(index, f"id bigint, codes array<smallint>, norm float, miss float, vector {rows.schema['vector'].dataType.simpleString()}")), books


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b in double precision; components are added in order. Rows are scaled by powers of two
    first, which changes no digit, so that squares of very large or small components do not overflow or vanish."""
    a, b = scaled(a), scaled(b)
    dot, x, y = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for d in range(a.shape[1]):
        dot += a[:, d] * b[:, d]
        x += a[:, d] * a[:, d]
        y += b[:, d] * b[:, d]
    return dot / (np.sqrt(x) * np.sqrt(y))


def _best_of_task(q_ids, q, books, k: int, s: Settings):
    """A function of the batches of an index that gives each query's k best rows of the task.

    The best by approximate score are scored exactly first. A cosine is at most the product with the sum of words plus
    the sum's distance from the unit vector, so then all rows that may still reach the k-th exact score are scored too:
    by products in double precision, and where these come within rounding of the k-th score, by cosine()."""

    def search(batches):
        asked = unit(q)
        tables = np.einsum("qd,akd->aqk", asked.astype(np.float32), books, optimize=True)
        slack = 2.0**-22 * (q.shape[1] + len(books)) * (1 + np.sqrt((books * books).sum(axis=2)).max(axis=1).sum())
        near_by = 8 * (q.shape[1] + 8) * np.finfo(np.float64).eps
        best = {at: (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)) for at in range(0, len(q), 128)}

        def add(first, floor, row, col, ids, vectors):
            """Puts the pairs among the best of their block and brings floor, the k-th score of each query, up to date."""
            real = ids[col] != q_ids[first + row]
            row, col = row[real], col[real]
            for at in range(0, len(row), 65536):
                r, c = row[at : at + 65536], col[at : at + 65536]
                exact = cosine(q[first + r], vectors[c])
                best[first] = _top(*(np.concatenate(x) for x in zip(best[first], (first + r, ids[c], exact))), k)
            full = np.bincount(best[first][0] - first, minlength=len(floor)) == k
            lowest = np.full(len(floor), np.inf)
            np.minimum.at(lowest, best[first][0] - first, best[first][2])
            floor[full] = lowest[full]

        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                ids, vectors = part.column("id").to_numpy(), _matrix(part.column("vector"), q.shape[1])
                # of equal vectors the k + 1 smallest ids can be among the k nearest of any query
                order = np.lexsort((ids, *vectors.T[::-1]))
                same = np.r_[False, (vectors[order][1:] == vectors[order][:-1]).all(axis=1)]
                new = np.flatnonzero(~same)
                rank = np.arange(len(order)) - np.repeat(new, np.diff(np.r_[new, len(order)]))
                pick = np.sort(order[rank <= k])
                ids, vectors = ids[pick], vectors[pick]
                units, single = unit(vectors), len(np.unique(ids)) == len(ids)
                codes = np.asarray(part.column("codes").flatten()).reshape(-1, len(books))[pick].astype(np.int64)
                norm = np.maximum(part.column("norm").to_numpy()[pick], 1e-12)
                miss = part.column("miss").to_numpy()[pick] + np.float32(slack)
                n = min(s.rerank, len(ids))
                for first in best:
                    score = tables[0, first : first + 128][:, codes[:, 0]]
                    for a in range(1, len(books)):
                        score = score + tables[a, first : first + 128][:, codes[:, a]]
                    own = q_ids[first : first + 128]
                    floor = np.full(len(own), -np.inf)
                    near = np.argpartition(-score / norm, n - 1, axis=1)[:, :n]
                    add(first, floor, np.repeat(np.arange(len(own)), n), near.ravel(), ids, vectors)
                    may = score + miss >= floor[:, None] - near_by
                    rest = np.flatnonzero(may.any(axis=0))
                    for piece in np.split(rest, range(1024, len(rest), 1024)):
                        exact = asked[first : first + 128] @ units[piece].T
                        least = floor
                        if single and len(piece) > k + 1:
                            # one of the k + 1 best may be the query itself
                            least = np.maximum(floor, np.partition(exact, len(piece) - k - 1, axis=1)[:, len(piece) - k - 1])
                        row, col = np.nonzero(may[:, piece] & (exact >= least[:, None] - near_by))
                        add(first, floor, row, piece[col], ids, vectors)
        row, ids, score = (np.concatenate(x) for x in zip(*best.values()))
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[row], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

    return search


def _top(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """Each row's k best; an id counts once, with its best score."""
    order = np.lexsort((-score, ids, row))
    row, ids, score = row[order], ids[order], score[order]
    once = np.r_[True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])] if len(row) else np.empty(0, bool)
    row, ids, score = row[once], ids[once], score[once]
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(new, np.diff(np.r_[new, len(row)]))
    return row[rank < k], ids[rank < k], score[rank < k]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k nearest rows of vectors by cosine, its own id left out: (query_id, rank, vec_id, score).

    score is the cosine of the original vectors in double precision; ties go to the smaller id. With fewer than k
    candidates all are given. Vectors that are null, zero, or have null or non-finite components take no part, nor do
    rows without an id or with another number of components than most rows. Of rows that repeat an id, candidates with
    the same id count once, with their best score. No usable rows, no results. Other columns are not looked at.
    """
    s = settings

    def usual(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
        return rows.where(F.col("id").isNotNull() & usable())

    rows, asked = usual(vectors), usual(queries)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    common = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = common["dims"]
    rows, asked = rows.where(F.size("vector") == dims), asked.where(F.size("vector") == dims)
    index, books = build_index(rows, dims, s)
    count = asked.count()
    blocks = max(1, -(-count // s.block))
    parts = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(blocks)) == b).dropDuplicates(["id"]).toArrow()
        if not block.num_rows:
            continue
        search = _best_of_task(block.column("id").to_numpy(), _matrix(block.column("vector"), dims), books, k, s)
        found = index.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
        parts.append(found if blocks == 1 else kept(found))
    if not parts:
        return vectors.sparkSession.createDataFrame([], schema)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
