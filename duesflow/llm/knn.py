"""Exact top-k inner products by a Voronoi k-nearest-neighbour join.

With one more coordinate ``sqrt(M - |x|^2)``, M the largest squared length, the largest
inner product is the smallest Euclidean distance. Queries and data are grouped by their
nearest pivot. From summaries of the groups (radius of the queries, the k smallest data
distances) follows a distance within which all answers of a query group lie. Groups of data
are dealt to parts; a vector is sent, once, if a group of queries needs it, and queries, of
which there are far fewer, go to the parts with groups that they need. A part compares its
vectors in blocks, each with the queries whose bound it can meet, and keeps the best of each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duesflow.llm.util import stored_table

ANSWER = "query_id long, vec_id long, score long"
# Bytes of queries and their answers that one task holds, and vectors compared at a time.
HELD, AT_ONCE = 2**27, 2048


def _whole(vectors, scale: float):
    """Valid vectors of an Arrow list column as integers: per length (row numbers, matrix)."""
    offsets = np.asarray(vectors.offsets)
    # Components that are NULL become NaN.
    values = vectors.values.to_numpy(zero_copy_only=False)
    sizes = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), -1)
    for size in np.unique(sizes[sizes >= 0]):
        rows = np.flatnonzero(sizes == size)
        x = values[offsets[rows][:, None] + np.arange(size)].astype(np.float64)
        finite = np.isfinite(x).all(1)
        with np.errstate(over="ignore"):
            x = np.floor(scale * x[finite])
        yield rows[finite], np.clip(x, -2.0**53, 2.0**53)


def _packed(x: np.ndarray):
    """Rows of integers as bytes, each row in 2, 4 or 8 bytes a component as its largest one needs."""
    import pyarrow as pa

    most = np.abs(x).max(axis=1, initial=0)
    out = np.empty(len(x), dtype=object)
    for kind, rows in ((np.int16, most < 2**15), (np.int32, (most >= 2**15) & (most < 2**31)), (np.float64, most >= 2**31)):
        out[rows] = [r.tobytes() for r in x[rows].astype(kind)]
    return pa.array(out, pa.binary())


def _unpacked(column: list[bytes], dim: int) -> np.ndarray:
    """The rows that ``_packed`` made, in single precision if all are short."""
    widths = {len(b) // dim for b in column} if dim else set()
    kinds = {2: np.int16, 4: np.int32, 8: np.float64}
    if len(widths) == 1:
        width = widths.pop()
        return np.frombuffer(b"".join(column), kinds[width]).reshape(len(column), dim).astype(np.float32 if width == 2 else np.float64)
    return np.array([np.frombuffer(b, kinds[len(b) // dim]) for b in column] if dim else [], np.float64).reshape(len(column), dim)


def _groups_of(matrix: np.ndarray, extra: np.ndarray, pivots: np.ndarray):
    """Nearest pivot and distance of each row of ``matrix`` with ``extra`` as last coordinate."""
    full = np.concatenate([matrix, extra[:, None]], axis=1)
    squares = (full * full).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * full @ pivots.T
    nearest = squares.argmin(1)
    return nearest, np.sqrt(((full - pivots[nearest]) ** 2).sum(1))


def _length(x: np.ndarray) -> float:
    """The length of the longest row."""
    return float(np.sqrt(np.square(x, dtype=np.float64).sum(1).max(initial=0)))


def _scores(queries: np.ndarray, data: np.ndarray, most: float | None = None) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits the value stops at the ends of long.

    No sum of some of the products is above ``most``, the longest query times the longest
    vector, so below 2^24 single precision is exact, and below 2^53 double precision.
    """
    most = _length(queries) * _length(data) if most is None else most
    if most < 2**24 * 0.999:
        return queries.astype(np.float32, copy=False) @ data.astype(np.float32, copy=False).T
    if most < 2**53 * 0.999:
        return queries.astype(np.float64, copy=False) @ data.astype(np.float64, copy=False).T
    exact = queries.astype(np.int64).astype(object) @ data.astype(np.int64).astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class _Best:
    """The ``k`` largest scores of each query among the vectors offered, which come in order of their ids."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score, self.id = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        self.n, self.floor = np.zeros(len(ids), np.int64), np.full(len(ids), -np.inf)

    def offer(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries from number ``first`` on with some vectors."""
        span = slice(first, first + len(scores))
        # An equal score of a later, larger id is not among the answers.
        if scores.dtype == np.int64:
            row, col = np.nonzero((scores > self.score[span, -1:]) | (self.n[span] < self.k)[:, None])
        else:
            floor = self.floor[span].astype(scores.dtype)
            hot = np.flatnonzero(scores.max(axis=1) > floor)
            row, col = np.nonzero(scores[hot] > floor[hot, None])
            row = hot[row]
        other = ids[col] != self.ids[first + row]
        row, col = row[other], col[other]
        if not len(row):
            return
        hot = np.unique(row)
        at, place = np.nonzero(np.arange(self.k) < self.n[first + hot, None])
        held = (first + hot[at], place)
        score = np.concatenate([self.score[held], scores[row, col].astype(np.int64)])
        found = np.concatenate([self.id[held], ids[col]])
        row = np.concatenate([hot[at], row])
        # ~s falls as s rises, and has no overflow at the smallest long.
        order = np.lexsort((found, ~score, row))
        row, score, found = row[order], score[order], found[order]
        start = np.searchsorted(row, hot)
        count = np.diff([*start, len(row)])
        place = np.arange(len(row)) - np.repeat(start, count)
        take = place < self.k
        self.score[first + row[take], place[take]] = score[take]
        self.id[first + row[take], place[take]] = found[take]
        hot += first
        self.n[hot] = np.minimum(count, self.k)
        self.floor[hot] = np.where(count >= self.k, self.score[hot, -1], -np.inf)

    def batches(self, rows: int = 2**16):
        import pyarrow as pa

        for at in range(0, len(self.ids), max(1, rows // self.k)):
            span = slice(at, at + max(1, rows // self.k))
            there = np.arange(self.k) < self.n[span, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()) for a in (np.repeat(self.ids[span], self.n[span]), self.id[span][there], self.score[span][there])],
                names=["query_id", "vec_id", "score"])


def top_inner_products(vectors: DataFrame, *, k: int = 10, every: int = 100, scale: float = 1024.0,
                       id_column: str = "vec_id", vector_column: str = "embedding", pivots: int = 64,
                       queries_per_block: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest integer inner products of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of the
    same length but those with the query's own id. Components are floor(``scale`` * x). Ties
    go to the smaller id. Vectors that are NULL or hold NULL or non-finite components, and
    rows without an id, take no part; scaled components stop at 2^53 in size. Rows that
    repeat an id are candidates each, and a query that repeats counts once (its smallest
    vector). Fewer than ``k`` candidates give fewer rows; an empty table gives none. Other
    columns are ignored. ``pivots`` vectors are drawn by hash; they steer the work, not the
    answers. Broadcast are the pivots and a summary of at most ``pivots`` x ``k`` distances
    per vector length. Vectors of different lengths are solved apart.

    A task holds at most about ``HELD`` bytes of queries, with their answers so far, and a batch of vectors.
    Vectors are moved once per ``HELD`` bytes of all queries; queries, and answers, once per part
    that needs them, of which there are a few per core, or more while that moves less than the vectors.

    Runs jobs: grouped vectors are written to the shared folder.
    """
    plain = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))

    def to_whole(batches):
        import pyarrow as pa

        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for rows, x in _whole(batch.column(1), scale):
                rows, x = rows[known[rows]], x[known[rows]]
                ids = batch.column(0).take(pa.array(rows))
                asked = np.asarray(ids) % every == 0
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.full(len(rows), x.shape[1]), pa.int32()), pa.array((x * x).sum(1), pa.float64()), _packed(x),
                    pa.array([r.tobytes() if a else None for r, a in zip(x, asked, strict=True)], pa.binary())],
                    names=["id", "dim", "norm", "x", "query"])

    whole = stored_table(plain.mapInArrow(to_whole, "id long, dim int, norm double, x binary, query binary"))
    answers = None
    for dim, longest in whole.groupBy("dim").agg(F.max("norm")).collect():
        found = _solve(whole.where(F.col("dim") == dim), dim, longest, k, pivots, queries_per_block)
        answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        answers = whole.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _solve(whole: DataFrame, dim: int, longest: float, k: int, n_pivots: int, block: int) -> DataFrame:
    import pyarrow as pa

    spark = whole.sparkSession
    drawn = whole.orderBy(F.xxhash64("id"), "id", "x").limit(n_pivots).collect()
    centres = np.concatenate([_unpacked([bytes(r.x) for r in drawn], dim), np.sqrt([[max(0.0, longest - r.norm)] for r in drawn])], axis=1)
    centres = np.unique(centres, axis=0)
    shared = spark.sparkContext.broadcast(centres)

    def group(as_query: bool):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _unpacked(batch.column(2).to_pylist(), dim).astype(np.float64)
                norm = np.asarray(batch.column(1))
                # A query's last coordinate is 0: its distances then order the inner products.
                extra = np.zeros(len(x)) if as_query else np.sqrt(np.maximum(0.0, longest - norm))
                cell, far = _groups_of(x, extra, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cell, pa.int32()), pa.array(far)],
                                                 names=["id", "x", "cell", "far"])

        return run

    shape = "id long, x binary, cell int, far double"
    first = W.partitionBy("id").orderBy("query")
    asked = whole.where(F.col("query").isNotNull()).withColumn("turn", F.row_number().over(first)).where("turn = 1")
    queries = stored_table(asked.select("id", "norm", "x").mapInArrow(group(True), shape))
    data = stored_table(whole.select("id", "norm", "x").mapInArrow(group(False), shape))

    # Summaries: the widest query of a group, the nearest vectors of a data group. One more
    # than k, because a query's own row may be among them.
    asked_in = queries.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()
    near = F.row_number().over(W.partitionBy("cell").orderBy("far", "id"))
    summary = data.select("cell", "far", "id").withColumn("turn", near).where(F.col("turn") <= k + 1).collect()
    sizes = data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).orderBy("cell").collect()
    between = np.sqrt(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(2))
    # Groups without a query reach nothing.
    reach = np.full(len(centres), -np.inf)
    for cell, radius, _ in asked_in:
        upper: dict[int, float] = {}
        for r in summary:
            most = radius + between[cell, r.cell] + r.far
            upper[r.id] = min(upper.get(r.id, np.inf), most)
        ordered = sorted(upper.values())
        # k other ids lie within this; rounding must not cut an answer off. No query of the
        # group is nearer to a vector than the distance of their pivots less that of each to its own.
        reach[cell] = (ordered[k] * (1 + 1e-9) + 1e-6 if len(ordered) > k else np.inf) + radius
    bounds = spark.sparkContext.broadcast((between, reach))

    # Data groups one after the other, cut into equal parts; a group is dealt to its parts at random.
    n, total = sum(r.n for r in asked_in), sum(r.n for r in sizes)
    packs = max(1, -(-n * (8 * dim + 16 * k + 32) // HELD))
    wanted = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(3 * spark.sparkContext.defaultParallelism, total // (3 * n + 1)))
    parts = max(1, -(-wanted // packs))
    start, dealt, goes = 0, [], {cell: set() for cell, _, _ in asked_in}
    for cell, size, low, high in sizes:
        spans = {g: (float(between[g, cell] - reach[g]), float(between[g, cell] + reach[g])) for g in goes}
        spans = {g: s for g, s in spans.items() if s[0] <= high and low <= s[1]}
        dealt.append((cell, start, size, list(spans.values())))
        for g in spans:
            goes[g].update(range(start * parts // total, (start + size - 1) * parts // total + 1))
        start += size
    span = pa.list_(pa.struct([("low", pa.float64()), ("high", pa.float64())]))
    cells, starts, counts, lists = zip(*dealt, strict=True)
    spans = spark.createDataFrame(pa.table({"cell": pa.array(cells, pa.int32()), "start": pa.array(starts, pa.int64()),
                                            "size": pa.array(counts, pa.int64()), "spans": pa.array(lists, span)}))
    there = spark.createDataFrame(pa.table({"cell": pa.array(list(goes), pa.int32()),
                                            "parts": pa.array([sorted(p) for p in goes.values()], pa.list_(pa.int32()))}))
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2**20))
    part = F.expr(f"(start + spread * size div {2**20}) * {parts} div {total}")
    sent = (data.withColumn("spread", spread).join(F.broadcast(spans), "cell")
            .where(F.exists("spans", lambda s: F.col("far").between(s.low, s.high)))
            .select(part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("pack"), F.lit(1).alias("kind"), "id", "x", "cell", "far"))
    asking = queries.join(F.broadcast(there), "cell").select(
        F.explode("parts").alias("part"), F.pmod(F.xxhash64("id"), F.lit(packs)).alias("pack"), F.lit(0).alias("kind"), "id", "x", "cell", "far")
    unit = (F.col("part") * packs + F.col("pack")).cast("int").alias("unit")
    met = asking.unionByName(sent).select(unit, "kind", "id", "x", "cell", "far")

    def solve(batches):
        best = None
        for fresh, asked, batch in _pieces(batches):
            if fresh:
                if best is not None:
                    yield from best.batches()
                best, held = None, []
            if asked:
                held.append(batch)
                continue
            if not held:
                continue
            if best is None:
                # Queries of a group lie side by side.
                cells = np.concatenate([np.asarray(b.column("cell")) for b in held])
                order = np.argsort(cells, kind="stable")
                best = _Best(np.concatenate([np.asarray(b.column("id")) for b in held])[order], k)
                q = _unpacked([v for b in held for v in b.column("x").to_pylist()], dim)[order]
                blocks = [[at, np.unique(cells[order][at:at + block]), _length(q[at:at + block]), 0] for at in range(0, len(q), block)]
            _compare(best, q, blocks, block, batch, dim, *bounds.value)
        if best is not None:
            yield from best.batches()

    return met.repartitionById(parts * packs, "unit").sortWithinPartitions("unit", "kind", "id").mapInArrow(solve, ANSWER)


def _pieces(batches):
    """Batches cut where the unit or the kind changes: (first of its unit, queries, batch)."""
    last = None
    for batch in batches:
        unit, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        cuts = [0, *(np.flatnonzero((np.diff(unit) != 0) | (np.diff(kind) != 0)) + 1), len(unit)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low < high:
                yield unit[low] != last, kind[low] == 0, batch.slice(low, high - low)
                last = unit[low]


def _compare(best: _Best, queries: np.ndarray, blocks: list, block: int, batch, dim: int, between: np.ndarray, reach: np.ndarray) -> None:
    """Offer each block of queries the vectors of ``batch`` that one of its groups can reach; blocks hold
    (first query, groups, length, vectors so far)."""
    ids, cell, far = (np.asarray(batch.column(c)) for c in ("id", "cell", "far"))
    x = _unpacked(batch.column("x").to_pylist(), dim)
    lengths = np.sqrt(np.square(x, dtype=np.float64).sum(1))
    reached = np.abs(between[:, cell] - far) <= reach[:, None]
    for one in blocks:
        first, groups, longest, seen = one
        needed = reached[groups].any(0)
        mine, own, long = (ids, x, lengths) if needed.all() else (ids[needed], x[needed], lengths[needed])
        at = 0
        while at < len(mine):
            # Few vectors at first: until k are known, each is among the best.
            piece = slice(at, at + min(AT_ONCE, max(256, seen)))
            scores = _scores(queries[first:first + block], own[piece], longest * float(long[piece].max(initial=0)))
            best.offer(first, scores, mine[piece])
            seen += len(scores[0])
            at = piece.stop
        one[3] = seen
