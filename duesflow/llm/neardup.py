"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is the bag of its five-word shingles. A shingle weighs its count times an IDF
that falls from 2, for shingles in few documents, to 1, for one in every document. Each of
``BANDS * DEPTH`` samples picks a shingle with a chance in proportion to its weight, alike in
all documents; documents that share all samples of a band meet. Those that meet are compared
by exact weighted Jaccard similarity, and classes are the connected parts of what passes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duesflow.llm.tokens import forget_coders
from duesflow.llm.util import SPACE, free_names, stored_table, text_or_empty
from duesflow.llm.words import WordHasher, mix

WORDS = 5
BANDS, DEPTH = 10, 3
RARE = 1e-3  # shingles in a smaller share of the documents all weigh 2
TABLE = 1 << 16
BUCKET_BITS = 22
PAIRED = 16  # documents of a bucket that are paired one by one
BLOCK, BLOCK_BYTES = 256, 4_000_000  # documents, and bytes of text, of a part of a larger one


class Shingler:
    """Shingles of texts as 64-bit hashes with counts."""

    def __init__(self):
        self._hasher = WordHasher()
        self._factors = mix(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, texts: list[str]):
        """(hashes, counts, starts): the bags of all texts one after the other, hashes ascending in each.

        Letters are lower-cased. A text of fewer words than a shingle is one shingle; one
        without words has none.
        """
        codes, _, _, sizes = self._hasher([t.lower().encode("utf-8", "surrogatepass") for t in texts])
        short = (sizes > 0) & (sizes < WORDS)
        if short.any():
            # Blank words fill up short texts, so that every text with words has a whole shingle.
            full = np.where(short, WORDS, sizes)
            filled = np.zeros(full.sum(), np.uint64)
            filled[np.arange(len(codes)) + np.repeat(np.cumsum(full - sizes) - (full - sizes), sizes)] = codes
            codes, sizes = filled, full
        n = max(0, len(codes) - WORDS + 1)
        mixed = np.zeros(n, np.uint64)
        for place in range(WORDS):
            mixed += codes[place:place + n] * self._factors[place]
        mixed = mix(mixed)
        shingles = np.maximum(sizes - WORDS + 1, 0)
        begin = np.cumsum(sizes) - sizes
        ends = np.cumsum(shingles)
        starts = ends - shingles
        # Shingles that would reach into the next text are left out.
        hashes = mixed[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - starts, shingles)]
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            hashes[a:b].sort()
        fresh = np.empty(len(hashes), bool)
        fresh[1:] = hashes[1:] != hashes[:-1]
        fresh[starts[shingles > 0]] = True
        at = np.flatnonzero(fresh)
        counts = np.diff(np.append(at, len(hashes)))
        before = np.concatenate([[0], np.cumsum(fresh)])
        return hashes[at], counts, before[starts]


def idf(df, n_docs: int):
    """2 down to 1 with the share of documents, level below ``RARE``."""
    share = np.clip(np.asarray(df, np.float64) / max(n_docs, 1), RARE, 1.0)
    return 1.0 + np.log(share) / np.log(RARE)


class Frequent:
    """IDF of the shingles that at least a share ``RARE`` of the documents hold; all others weigh ``other``."""

    def __init__(self, hashes, weights, other: float = 2.0):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.other = np.asarray(hashes)[order], np.asarray(weights)[order], other

    def __call__(self, hashes):
        out = np.full(len(hashes), self.other)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            out[hit] = self.weights[at[hit]]
        return out


def weighted_jaccard(a, weights_a, b, weights_b) -> float:
    """Sum of minima over sum of maxima; the hashes of each side ascend. Two empty bags are equal."""
    common, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    low = np.minimum(weights_a[at_a], weights_b[at_b]).sum()
    most = weights_a.sum() + weights_b.sum() - low
    return float(low / most) if most > 0 else 1.0


def _tables():
    """Quantiles of Gamma(2, 1) at the middles of ``TABLE`` equal parts: itself, its inverse, its logarithm."""
    at = np.linspace(0, 1, TABLE + 1)[:-1] + 0.5 / TABLE
    low, high = np.zeros(TABLE), np.full(TABLE, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        under = 1 - np.exp(-middle) * (1 + middle) < at
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return low.astype(np.float32), (1 / low).astype(np.float32), np.log(low).astype(np.float32)


class Sampler:
    """Improved consistent weighted samples of weighted bags.

    For sample k, r and c ~ Gamma(2, 1) and b ~ U(0, 1) come from a hash of shingle and k;
    t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r. The shingle with the
    least a, with its t, is the sample.
    """

    def __init__(self, samples: int = BANDS * DEPTH):
        self.gamma, self.inverse, self.log = _tables()
        self.seeds = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def __call__(self, hashes, weights, starts):
        """Samples (bags x samples) of bags that begin at ``starts`` of the arrays."""
        logs = np.log(weights).astype(np.float32)
        ends = np.append(starts[1:], len(hashes))
        out = np.empty((len(starts), len(self.seeds)), np.uint64)
        bag = np.repeat(np.arange(len(starts)), ends - starts)
        for k, seed in enumerate(self.seeds):
            x = (hashes ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
            cut = (x & np.uint64(TABLE - 1)).astype(np.int64)
            x >>= np.uint64(16)
            r_at = (x & np.uint64(TABLE - 1)).astype(np.int64)
            x >>= np.uint64(16)
            b = x.astype(np.float32) * np.float32(2.0**-32)
            r = self.gamma[r_at]
            t = np.floor(logs * self.inverse[r_at] + b)
            a = self.log[cut] - r * (t - b + np.float32(1))
            least = np.minimum.reduceat(a, starts)
            at = np.flatnonzero(a == least[bag])
            # Of equal values the smallest hash, so that the choice does not hang on order.
            first = np.unique(bag[at], return_index=True)[1]
            pick = at[first]
            out[:, k] = mix(hashes[pick] + (t[pick].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        return out


def _bags(batches, size: int = 150_000):
    """(keys, hashes, counts, starts) of texts with words, about ``size`` characters at a time."""
    shingler = Shingler()

    def bags(keys, texts):
        hashes, counts, starts = shingler(texts)
        full = np.flatnonzero(np.diff(np.append(starts, len(hashes))))
        return np.array(keys, np.int64)[full], hashes, counts, starts[full]

    keys, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys.append(key)
            texts.append(text.as_py() or "")
            held += len(texts[-1])
            if held >= size:
                yield bags(keys, texts)
                keys, texts, held = [], [], 0
    if keys:
        yield bags(keys, texts)


def _held(batches, size: int = 2_000_000):
    """Shingles of many texts at a time, one entry per text that holds one."""
    held, n = [], 0
    for _, hashes, _, _ in _bags(batches):
        held.append(hashes)
        n += len(hashes)
        if n >= size:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _full_buckets(texts: DataFrame, least: int):
    """Whether each of the 2^BUCKET_BITS buckets of shingles is met at least ``least`` times in all texts.

    Tasks count buckets, and 64 tasks' counts at a time are added up, block by block and
    round by round. Counts stop at ``least``, which changes no answer. Runs jobs.
    """
    blocks, fan_in, schema = 64, 64, "part long, block int, counts binary"
    width = (1 << BUCKET_BITS) // blocks

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        forget_coders()
        # In place: bincount would take as much again, in 64 bits, for every call.
        met = np.zeros(1 << BUCKET_BITS, np.int32)
        for hashes in _held(batches):
            np.add.at(met, (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), 1)
        part = TaskContext.get().partitionId()
        for block in range(blocks):
            some = np.minimum(met[block * width:(block + 1) * width], least).astype(np.int32)
            if some.any():
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int64()), "block": pa.array([block], pa.int32()), "counts": pa.array([some.tobytes()])})

    def add(table):
        import pyarrow as pa

        total = np.zeros(width, np.int64)
        for counts in table.column("counts"):
            total += np.frombuffer(counts.as_py(), np.int32)
        return pa.table({"part": table.column("part")[:1], "block": table.column("block")[:1],
                         "counts": pa.array([np.minimum(total, least).astype(np.int32).tobytes()])})

    counted = texts.mapInArrow(count, schema)
    while True:
        counted = stored_table(counted.withColumn("part", F.floor(F.col("part") / fan_in))
                               .groupBy("part", "block").applyInArrow(add, schema))
        if not counted.agg(F.max("part")).first()[0]:
            break
    full = np.zeros(1 << BUCKET_BITS, bool)
    for row in counted.toLocalIterator():
        full[row.block * width:(row.block + 1) * width] = np.frombuffer(row.counts, np.int32) >= least
    return full


def learn_frequent(texts: DataFrame, n_docs: int) -> Frequent:
    """Document frequencies of all shingles that ``RARE`` of the documents, and at least two, hold, exactly.

    The first pass counts buckets of shingles; the second counts the shingles of buckets that
    are met often enough, and Spark adds these up. There are at most (shingles per document)
    / ``RARE`` such shingles, whatever the number of documents, and only they and one bit per
    bucket reach the driver. Below 1 / ``RARE`` documents all others are in one document. Runs jobs.
    """
    least = max(2, int(np.ceil(RARE * n_docs)))
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(np.packbits(_full_buckets(texts, least)))

    def count(batches):
        import pyarrow as pa

        full = np.unpackbits(shared.value).view(bool)
        for hashes in _held(batches):
            named, df = np.unique(hashes[full[(hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]], return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": pa.array(named.view(np.int64)), "df": pa.array(df.astype(np.int64))})

    counted = (texts.mapInArrow(count, "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))
               .where(F.col("df") >= least).toArrow())
    return Frequent(counted.column(0).to_numpy().view(np.uint64), idf(counted.column(1).to_numpy(), n_docs), float(idf(1, n_docs)))


def _signatures(texts: DataFrame, shared) -> DataFrame:
    """(uid, buckets, marks) of every text with words: a bucket per band, and 16 bits of every sample."""

    def sign(batches):
        import pyarrow as pa

        frequent, sampler = Frequent(*shared.value), Sampler()
        for keys, hashes, counts, starts in _bags(batches):
            if not len(keys):
                continue
            samples = sampler(hashes, frequent(hashes) * counts, starts)
            banded = samples.reshape(len(keys), BANDS, DEPTH)
            bucket = np.zeros((len(keys), BANDS), np.uint64)
            for place in range(DEPTH):
                bucket = mix(bucket + banded[:, :, place])
            marks = (samples & np.uint64(0xFFFF)).astype(np.uint16).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "uid": pa.array(keys, pa.int64()),
                "buckets": pa.array(list(bucket.view(np.int64)), pa.list_(pa.int64())),
                "marks": pa.array(list(marks), pa.list_(pa.int32()))})

    return texts.mapInArrow(sign, "uid long, buckets array<long>, marks array<int>")


def _compare(pairs: DataFrame, texts: DataFrame, shared, how: str | None) -> DataFrame:
    """``pairs`` (uid, centre) with their exact similarity; ``how`` is a join hint, or None.

    The text of a centre that many ask for is copied to as many parts as its askers need.
    """
    per_part = 256
    hinted = lambda df: df.hint(how) if how else df
    asked = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / per_part).cast("int").alias("parts"))
    dealt = (pairs.join(asked, "centre")
             .select("uid", "centre", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int").alias("part")))
    left = hinted(dealt).join(texts.select("uid", F.col("text").alias("left")), "uid")
    right = (texts.select(F.col("uid").alias("centre"), F.col("text").alias("right")).join(hinted(asked), "centre")
             .select("centre", "right", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))

    def measure(batches):
        import pyarrow as pa

        frequent, shingler = Frequent(*shared.value), Shingler()

        def weigh(texts):
            hashes, counts, starts = shingler(texts)
            weights, ends = frequent(hashes) * counts, np.append(starts[1:], len(hashes))
            return [(hashes[a:b], weights[a:b]) for a, b in zip(starts, ends, strict=True)]

        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                centres = dict(zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True))
                known = dict(zip(centres, weigh(list(centres.values())), strict=True))
                bags = weigh(part.column(2).to_pylist())
                out += [weighted_jaccard(*bag, *known[c]) for bag, c in zip(bags, part.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["uid", "centre", "similarity"])

    return (left.join(right, ["centre", "part"]).select("uid", "centre", "left", "right")
            .mapInArrow(measure, "uid long, centre long, similarity double"))


def _links(texts: DataFrame, unique: DataFrame, shared, least: float) -> tuple[DataFrame, DataFrame]:
    """(links, roots): links (uid, centre, similarity) that connect alike documents, and their components.

    All documents that share a bucket are compared, unless links connect them already. Two
    rounds connect most: each document is compared with the first of its buckets, then, in
    buckets of more than ``PAIRED``, those not connected to it with the first of themselves.
    What is still apart is paired: in small buckets pair by pair, in others block by block.
    So the work grows with the square of a bucket only by what no link connects. Pairs whose
    samples agree in less than half of ``least`` are not compared outside blocks; at a
    similarity of ``least`` that happens to fewer than one in a million.
    """
    signed = stored_table(_signatures(texts, shared).join(unique.select("uid"), "uid", "left_semi"))
    marks = signed.select("uid", "marks")
    spread = signed.select("uid", F.posexplode("buckets").alias("band", "bucket"))

    def crowded(groups):
        """Rows of the groups whose documents are not all connected, with the group's size, its centre and that one's root."""
        met = (groups.groupBy("key").agg(F.min("uid").alias("centre"), F.min_by("root", "uid").alias("centre_root"), F.count(F.lit(1)).alias("n"),
                                         F.min("root").alias("low"), F.max("root").alias("high"))
               .where("low < high").drop("low", "high"))
        return stored_table(groups.join(met, "key"))

    def compared(pairs, how):
        theirs = marks.select(F.col("uid").alias("centre"), F.col("marks").alias("theirs"))
        same = F.aggregate(F.zip_with("marks", "theirs", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
        likely = (pairs.join(marks, "uid").join(theirs, "centre").where(same >= int(least / 2 * BANDS * DEPTH))
                  .select("uid", "centre"))
        # Used three times in the comparison, and texts are moved by it.
        return stored_table(_compare(stored_table(likely), involved, shared, how))

    def rooted(groups, roots):
        return crowded(groups.select("key", "uid").join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid")))

    alive = crowded(spread.select(F.xxhash64("band", "bucket").alias("key"), "uid", F.col("uid").alias("root")))
    # From here on only documents that share a bucket with another matter. One plan at every size.
    involved = stored_table(texts.join(alive.select("uid").distinct().hint("merge"), "uid", "left_semi"))
    measured = compared(alive.where("uid <> centre").groupBy("uid").agg(F.min("centre").alias("centre")), "merge")
    edges = measured.where(F.col("similarity") >= least).select("uid", F.col("centre").alias("other"))
    roots = _contracted(edges)
    alive = rooted(alive, roots)
    apart = alive.where((F.col("n") > PAIRED) & (F.col("root") != F.col("centre_root"))).select("key", "uid")
    first = apart.groupBy("key").agg(F.min("uid").alias("centre"))
    again = compared(apart.join(first, "key").where("uid <> centre").groupBy("uid").agg(F.min("centre").alias("centre")), None)
    measured = measured.unionByName(again)
    edges = again.where(F.col("similarity") >= least).select("uid", F.col("centre").alias("other"))
    roots = _contracted(edges.unionByName(roots.select("uid", F.col("root").alias("other"))))
    alive = rooted(alive, roots)

    few = alive.where(F.col("n") <= PAIRED).select("key", "uid", "root")
    other = few.select("key", F.col("uid").alias("centre"), F.col("root").alias("theirs"))
    pairs = (few.join(other, (few.key == other.key) & (F.col("uid") > F.col("centre")) & (F.col("root") != F.col("theirs")))
             .select("uid", "centre").distinct().join(measured.select("uid", "centre"), ["uid", "centre"], "left_anti"))
    measured = measured.unionByName(compared(pairs, None))
    blocks = stored_table(_in_blocks(alive.where(F.col("n") > PAIRED).select("key", "uid", "root"), involved, shared, least))
    links = measured.where(F.col("similarity") >= least).unionByName(blocks).dropDuplicates(["uid", "centre"])
    return links, _components(links.select("uid", F.col("centre").alias("other")))


def _in_blocks(rows: DataFrame, texts: DataFrame, shared, least: float) -> DataFrame:
    """Links (uid, centre, similarity) between different roots of each group of ``rows`` (key, uid, root).

    The largest root of a group and all its others are dealt to parts; each part of others
    meets every part in a block of its own, and a block compares all pairs exactly. A block
    gives only links that join what its links and roots do not join yet, so that their number
    grows with its documents.
    """
    held = stored_table(rows.join(texts, "uid").withColumn("length", F.octet_length("text")))
    # A root that holds most of a group's rows is not compared with itself.
    tallies = held.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("length").alias("bytes"))
    needed = F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    mains = (tallies.groupBy("key").agg(F.max(F.struct("rows", "root", "bytes")).alias("main"),
                                        F.sum("rows").alias("all_rows"), F.sum("bytes").alias("all_bytes"))
             .select("key", F.col("main.root").alias("main"), F.col("main.rows").alias("rows"), F.col("main.bytes").alias("bytes"), "all_rows", "all_bytes")
             .withColumn("of_main", needed)
             .withColumn("rows", F.col("all_rows") - F.col("rows")).withColumn("bytes", F.col("all_bytes") - F.col("bytes"))
             .withColumn("of_others", needed).select("key", "main", "of_main", "of_others"))
    is_main = F.col("root") == F.col("main")
    part = lambda parts: F.pmod(F.xxhash64("uid", "key"), F.col(parts)).cast("int")
    dealt = (held.join(mains, "key")
             .withColumn("part", F.when(is_main, F.col("of_others") + part("of_main")).otherwise(part("of_others")))
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("of_others") - 1)
                                                      .otherwise(F.col("of_others") + F.col("of_main") - 1))))
             .select("key", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "uid", "root", "text"))

    def solve(table):
        import pyarrow as pa

        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        at, uids, roots = (table.column(c).to_numpy() for c in ("part", "uid", "root"))
        hashes, counts, starts = Shingler()([t.as_py() for t in table.column("text")])
        idfs, ends = Frequent(*shared.value)(hashes), np.append(starts[1:], len(hashes))
        left, right = np.flatnonzero(at == low), np.flatnonzero(at == high)
        i, j = _alike(hashes, counts, idfs, starts, left, right, least - 1e-3)
        apart = (roots[left[i]] != roots[right[j]]) & ((low != high) | (i < j))
        joined: dict[int, int] = {}

        def find(root):
            while root in joined:
                root = joined[root]
            return root

        out = []
        for a, b in zip(left[i[apart]].tolist(), right[j[apart]].tolist(), strict=True):
            one, two = find(int(roots[a])), find(int(roots[b]))
            if one == two:
                continue
            bags = [(hashes[starts[x]:ends[x]], idfs[starts[x]:ends[x]] * counts[starts[x]:ends[x]]) for x in (a, b)]
            similarity = weighted_jaccard(*bags[0], *bags[1])
            if similarity >= least:
                joined[max(one, two)] = min(one, two)
                out.append((int(max(uids[a], uids[b])), int(min(uids[a], uids[b])), similarity))
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table({"uid": pa.array(columns[0], pa.int64()), "centre": pa.array(columns[1], pa.int64()),
                         "similarity": pa.array(columns[2], pa.float64())})

    return dealt.groupBy("key", "low", "high").applyInArrow(solve, "uid long, centre long, similarity double")


def _alike(hashes, counts, idfs, starts, left, right, least: float, width: int = 2048):
    """Places (i, j) in ``left`` and ``right`` of all pairs of bags whose similarity is at least ``least``, to single precision.

    The n-th time of a shingle is an item of its own, so that the sum of minima is the sum of
    the weights of common items, a product of matrices.
    """
    bag = np.repeat(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(hashes)))), counts)
    before = np.cumsum(counts) - counts
    turn = (np.arange(len(bag)) - np.repeat(before, counts)).astype(np.uint64)
    weights = np.repeat(idfs, counts).astype(np.float32)
    totals = np.bincount(bag, weights, len(starts)).astype(np.float32)
    names = np.where(turn > 0, mix(np.repeat(hashes, counts) + turn * np.uint64(0x9E3779B97F4A7C15)), np.repeat(hashes, counts))
    _, item, held = np.unique(names, return_inverse=True, return_counts=True)
    # Only items of two bags or more can be common.
    number = np.where(held > 1, np.cumsum(held > 1) - 1, -1)[item]
    order = np.argsort(number, kind="stable")
    order = order[np.searchsorted(number[order], 0):]
    number, bag, weights = number[order], bag[order], weights[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        some = slice(*np.searchsorted(number, [first, first + width]))
        has = np.zeros((len(starts), width), np.float32)
        has[bag[some], number[some] - first] = 1
        weight = np.zeros(width, np.float32)
        weight[number[some] - first] = weights[some]
        common += (has[left] * weight) @ has[right].T
    return np.nonzero(common >= least * (totals[left][:, None] + totals[right] - common))


def _contracted(links: DataFrame) -> DataFrame:
    """(uid, root): one round of star contraction, which joins most but not all that is connected."""
    return stored_table(_star(links.select(F.greatest("uid", "other").alias("u"), F.least("uid", "other").alias("v")).distinct())
                        .groupBy(F.col("u").alias("uid")).agg(F.min("v").alias("root")))


def _star(edges: DataFrame) -> DataFrame:
    """One contraction of edges (u, v), v < u: larger neighbours move to the smallest neighbour, then smaller ones do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    return (large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def _components(links: DataFrame) -> DataFrame:
    """(uid, root) from links (uid, other): the smallest uid connected to each linked document.

    By repeated star contraction, until a round changes nothing.
    """
    edges = stored_table(links.select(F.greatest("uid", "other").alias("u"), F.least("uid", "other").alias("v")).distinct())
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return edges.select(F.col("u").alias("uid"), F.col("v").alias("root"))
        before = mark
        edges = stored_table(_star(edges))


def near_groups(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others ignored): doc_id, class_id, class_size, n_links, kept.

    Texts whose words are the same form one text first, whose links count once. ``class_id`` is
    the smallest ``doc_id`` of the class, ``kept`` marks one row of it, ``n_links`` counts the
    links found to different texts (their number follows the search, which does not compare
    all pairs of a class). Texts without words, NULL among them, are alike to each other and
    to nothing else. NULL ids come last in a class; repeated rows are copies. An empty table
    gives no rows. Runs jobs.
    """
    held = stored_table(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", text_or_empty().alias("text")))
    return _classes(held, least).drop("uid")


def _classes(held: DataFrame, least: float) -> DataFrame:
    """``near_groups`` of stored rows (uid, doc_id, text), with their uid."""
    words = F.btrim(F.lower(F.regexp_replace("text", SPACE, " ")))
    rows = stored_table(held.select("uid", "doc_id", F.unhex(F.sha2(words, 256)).alias("same")))
    unique = stored_table(rows.groupBy("same").agg(F.min("uid").alias("uid")))
    texts = held.select("uid", "text")
    frequent = learn_frequent(texts, max(1, rows.count()))
    shared = held.sparkSession.sparkContext.broadcast((frequent.hashes, frequent.weights, frequent.other))
    links, roots = _links(texts, unique, shared, least)
    ends = links.select("uid").unionByName(links.select(F.col("centre").alias("uid")))
    n_links = ends.groupBy("uid").agg(F.count(F.lit(1)).alias("n_links"))
    placed = stored_table(
        rows.join(unique.join(roots, "uid", "left").join(n_links, "uid", "left")
                  .select("same", F.coalesce("root", "uid").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "same")
        .select("uid", "doc_id", "root", "n_links"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid"))
    classes = placed.groupBy("root").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size"))
    return placed.join(classes, "root").select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", "n_links", (F.col("uid") == F.col("first.uid")).alias("kept"), "uid")


def drop_near_copies(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """One row of each class of ``near_groups``, with all columns of ``docs``.

    The documents are written to the shared folder once, so that rows keep their identity.
    Extra columns may have any name.
    """
    row, stays = free_names(docs, "_near_row", "_near_kept")
    held = stored_table(docs.withColumn(row, F.monotonically_increasing_id()))
    plain = held.select(F.col(row).alias("uid"), "doc_id", text_or_empty().alias("text"))
    kept = _classes(plain, least).where("kept").select(F.col("uid").alias(stays))
    return held.join(kept, F.col(row) == F.col(stays), "left_semi").drop(row)
