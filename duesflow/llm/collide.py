"""Approximate nearest neighbours by counting collisions of single projections.

Vectors are projected on ``projections`` random lines; every block of vectors keeps one
sorted array per line. A query opens a window around its own projection on every line and
counts in how many windows a vector lies. Windows grow with the radius searched (virtual
rehashing: the same arrays serve every radius). A vector within the radius lies in a window
with a known probability, so a count below the threshold rules it out, up to a stated chance;
the others are verified by their exact score.

Largest inner products become smallest distances by one more coordinate sqrt(M - |x|^2), M
the largest squared length; a query has 0 there.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duesflow.llm.util import stored_table

BLOCK = 4096  # below 2^16, so that places fit into 16 bits


def _lines(dim: int, projections: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim + 1, projections))


class Block:
    """The vectors of a block, with one sorted array per line and each vector's place in it."""

    def __init__(self, x: np.ndarray, extra: np.ndarray, lines: np.ndarray):
        self.x, self.lines = x, lines
        values = (np.concatenate([x, extra[:, None]], axis=1) @ lines).T
        order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, order, axis=1)
        self.places = np.empty(order.shape, np.uint16)
        np.put_along_axis(self.places, order, np.arange(len(x), dtype=np.uint16)[None, :], axis=1)

    def windows(self, centres: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of places, per line and query, of the windows of ``half`` around ``centres``."""
        low = np.array([row.searchsorted(c - half, "left") for row, c in zip(self.sorted, centres, strict=True)])
        high = np.array([row.searchsorted(c + half, "right") for row, c in zip(self.sorted, centres, strict=True)])
        return low.astype(np.uint16), (high - low).astype(np.uint16)

    def counts(self, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """In how many of one query's windows each vector lies: places before a window wrap round to large numbers."""
        inside = (self.places - low[:, None]) < size[:, None]
        return inside.view(np.uint8).sum(axis=0, dtype=np.uint8 if len(low) < 256 else np.uint32)

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Inner products summed from the first component to the last, so that equal vectors score alike."""
        return (self.x[rows] * query).cumsum(axis=1)[:, -1]


def threshold(projections: int, width: float, miss: float) -> int:
    """Least count that a vector at the searched radius fails to reach with probability ``miss`` (normal approximation)."""
    meets = 2 * NormalDist().cdf(width / 2) - 1
    return max(1, math.floor(projections * meets + NormalDist().inv_cdf(miss) * math.sqrt(projections * meets * (1 - meets))))


def nearest_by_collisions(vectors: DataFrame, *, k: int = 20, every: int = 20, id_column: str = "vec_id",
                          vector_column: str = "embedding", projections: int = 128, width: float = 2.4, miss: float = 0.02,
                          growth: float = 1.1, seed: int = 12, queries_at_once: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` largest inner products found, nearest first.

    Queries are the rows whose id is divisible by ``every``, candidates all rows of the same
    length but those with the query's id; every row is indexed. Two searches: in the first,
    each block widens a query's windows by ``growth`` until its share of 2k candidates passes the
    threshold; the k-th best score of all blocks bounds the distance to the k-th neighbour.
    The second counts once at that radius, verifies all that pass and keeps those that reach the bound. So a true neighbour is
    missed with a chance of about ``miss`` at most. Ties go to smaller ids.

    Vectors that are NULL, zero, of no length, or hold NULL or non-finite components, and rows
    without an id, take no part. Rows that repeat an id are candidates each; a query that
    repeats counts once, by its smallest vector. Fewer than ``k`` candidates give fewer rows, an
    empty table none; other columns are ignored. Vectors of different lengths are solved
    apart, one after the other. Blocks hold ``BLOCK`` vectors whatever they are, so copies
    and hot ids spread like others. Runs jobs; checked vectors are written to the shared folder.
    """
    plain = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                x = np.asarray(v, dtype=np.float64)
                with np.errstate(over="ignore"):
                    norm = float(x @ x)
                if np.isfinite(x).all() and x.any() and math.isfinite(norm):
                    out.append((i, len(x), norm, x.tobytes()))
            ids, dims, norms, data = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()),
                                              pa.array(data, pa.binary())], names=["id", "dim", "norm", "x"])

    whole = stored_table(plain.mapInArrow(check, "id long, dim int, norm double, x binary"))
    answers = None
    for dim, longest, n in whole.groupBy("dim").agg(F.max("norm"), F.count(F.lit(1))).orderBy("dim").collect():
        rows = whole.where(F.col("dim") == dim).select("id", "norm", "x")
        found = _solve(rows, dim, longest, n, k, every, projections, width, miss, growth, seed, queries_at_once)
        answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        answers = whole.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.col("norm").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _solve(rows: DataFrame, dim: int, longest: float, n: int, k: int, every: int, projections: int, width: float, miss: float,
           growth: float, seed: int, at_once: int) -> DataFrame:
    spark = rows.sparkSession
    least = threshold(projections, width, miss)

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([part << 32 | number], pa.int64()), "size": pa.array([piece.num_rows], pa.int32()),
                    "ids": pa.array([np.asarray(piece.column(0)).tobytes()], pa.binary()),
                    "norms": pa.array([np.asarray(piece.column(1)).tobytes()], pa.binary()),
                    "x": pa.array([b"".join(piece.column(2).to_pylist())], pa.binary())})
                number += 1

    # Spread first, so that blocks are full however small the files are.
    spread = rows.repartition(max(1, math.ceil(n / (4 * BLOCK))))
    blocks = stored_table(spread.mapInArrow(pack, "block long, size int, ids binary, norms binary, x binary"))
    first = W.partitionBy("id").orderBy("x")
    queries = (rows.where(F.col("id") % every == 0).withColumn("_turn", F.row_number().over(first)).where("_turn = 1")
               .select("id", "norm", "x"))

    def meet(queries: DataFrame) -> DataFrame:
        """Every block with every pack of queries once: both are dealt to the rows and columns of a grid of tasks."""
        side = math.ceil(math.sqrt(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
        parts = max(1, math.ceil(n / every / at_once))
        packs = (queries.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("_pack"))
                 .agg(F.collect_list(F.struct("id", "norm", "x", "radius", "least")).alias("queries")))

        def dealt(df, row, column):
            return df.withColumn("deal", row * side + column).repartition(side * side, "deal")

        every_place = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
        left = dealt(blocks.withColumn("_column", every_place), F.pmod(F.col("block") % (1 << 32) + F.shiftright("block", 32), F.lit(side)), F.col("_column"))
        right = dealt(packs.withColumn("_row", every_place), F.col("_row"), F.pmod(F.col("_pack"), F.lit(side)))
        return left.drop("_column").join(right.drop("_row", "_pack"), "deal").select("block", "size", "ids", "norms", "x", "queries")

    share = math.ceil(2 * k * BLOCK / max(1, n))

    def search(found: bool):
        def run(batches):
            import pyarrow as pa

            lines = _lines(dim, projections, seed)
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1).to_pylist()[0]
                    ids, norms = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["norms"])
                    block = Block(np.frombuffer(row["x"]).reshape(row["size"], dim), np.sqrt(np.maximum(0.0, longest - norms)), lines)
                    out = answer(block, ids, row["queries"], found)
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)),
                                                      pa.array([row["block"]] * len(out), pa.int64())],
                                                     names=["query_id", "vec_id", "score", "at", "block"])

        return run

    def answer(block: Block, ids, queries, found: bool):
        x = np.frombuffer(b"".join(q["x"] for q in queries)).reshape(len(queries), dim)
        centres = (x @ block.lines[:-1]).T
        radius = np.array([q["radius"] for q in queries])
        if not found:
            # Start below the nearest of some vectors, at a positive radius.
            some = np.arange(0, len(ids), max(1, len(ids) // 64))
            squares = np.array([q["norm"] for q in queries])[:, None] + longest - 2 * x @ block.x[some].T
            far = np.sqrt(np.maximum(0.0, squares))
            radius = np.maximum.reduce([0.85 * far.min(1), 1e-3 * far.max(1), np.full(len(queries), 1e-12 * math.sqrt(longest))])
        open_, out = np.arange(len(queries)), []
        while len(open_):
            low, size = block.windows(centres[:, open_], width * radius[open_] / 2)
            wider = []
            for column, at in enumerate(open_.tolist()):
                q, other = queries[at], ids != queries[at]["id"]
                rows = np.flatnonzero((block.counts(low[:, column], size[:, column]) >= least) & other)
                full = 2 * math.sqrt(longest) + math.sqrt(q["norm"])
                wanted = min(int(other.sum()), max(2, share))
                if not found and len(rows) < wanted and radius[at] <= full:
                    wider.append(at)
                    continue
                scores = block.scores(x[at], rows)
                if found:
                    good = scores >= q["least"]
                    rows, scores = rows[good], scores[good]
                best = np.lexsort((ids[rows], -scores))[:k if found else wanted]
                out += [(q["id"], int(ids[rows[b]]), float(scores[b]), int(rows[b])) for b in best]
            open_ = np.array(wider, dtype=np.int64)
            radius[open_] *= growth
        return out

    shape = "query_id long, vec_id long, score double, at int, block long"
    first_found = stored_table(meet(queries.withColumns({"radius": F.lit(0.0), "least": F.lit(0.0)})).mapInArrow(search(False), shape))
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    worst = (first_found.withColumn("_turn", order).where(F.col("_turn") <= k).groupBy("query_id")
             .agg(F.min("score").alias("_least"), F.count(F.lit(1)).alias("_n")))
    # Fewer than k found: everything must pass.
    wide = F.lit(4 * math.sqrt(longest)) + 2 * F.sqrt("norm")
    distance = F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + F.lit(longest) - 2 * F.col("_least")))
    # Rounding of projections must not close a window around copies of the query.
    radius = F.when(F.col("_n") >= k, distance * (1 + 1e-9) + F.lit(1e-7 * math.sqrt(longest))).otherwise(wide * 8)
    bounded = queries.join(worst.withColumnRenamed("query_id", "id"), "id", "left").select(
        "id", "norm", "x", F.coalesce(radius, wide * 8).alias("radius"),
        F.when(F.col("_n") >= k, F.col("_least")).otherwise(F.lit(-math.inf)).alias("least"))
    # What the first search found stays found; a row of a block counts once.
    both = meet(bounded).mapInArrow(search(True), shape).unionByName(first_found)
    return both.dropDuplicates(["query_id", "block", "at"]).select("query_id", "vec_id", "score")
