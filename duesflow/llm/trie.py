"""A trie of conversations, with sums over subtrees by centroid decomposition.

Conversations that start with the same turns share nodes. A node is named by its depth and
the smallest of its conversations, so a conversation names the nodes of its own path from
some depth on. Subtree sums are found without walking levels: the edges to parents form a
forest; each component is split at its centroid, the deepest node that still has more than
half of the component's weight below it. What hangs at the centroid is one total, which
goes to the nodes on the way from the centroid to the component's top. The way needs no
walk either: it is the nodes with more than half of the weight below them. Each split
halves the weight, so a chain of a million turns takes as few rounds as any other tree.

Components with many nodes are split by joins over all rows; once a component is small, one
task splits it to the end, many components at a time in arrays.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duesflow.llm.util import NOT_SPACE, stored_table
from duesflow.operators.numbering import number_rows

# Components of at most so many nodes are split in one task.
SMALL = 8192
# Turns of a run whose sums are added up together.
RUN = 1024
PIECES = ("s1", "s2", "s3", "s4")


def number_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): turns numbered from 0 inside their conversation.

    The order is turn (NULL first), role, text; NULL roles and texts become empty. Rows
    without a conversation are left out, other columns dropped. Runs of turn numbers, and
    of texts without a number, are numbered apart, so that one conversation with a third of
    all rows is many tasks.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("_turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    bare = F.col("_turn").isNull()
    cuts = [F.shiftright("_turn", 10), F.when(bare, F.col("role")), F.when(bare, F.substring("text", 1, 12))]
    numbered = number_rows(rows, "_place", ["_turn", "role", "text"], cuts, ["conv_id"])
    return numbered.select("conv_id", (F.col("_place") - 1).alias("pos"), "role", "text")


def _paths(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, length, tokens, s1..s4): every prefix of every conversation; equal prefixes have equal sums.

    A prefix is known by the sum, over its turns, of SHA-256 of (place, role, text), cut to four
    numbers of 32 bits: different prefixes agree by chance once in about 2^128 pairs.
    """
    digest = F.sha2(F.concat_ws("|", F.col("pos").cast("string"), F.octet_length("role").cast("string"), F.col("role"), F.col("text")), 256)
    pieces = {name: F.conv(F.substring("_hash", 8 * i + 1, 8), 16, 10).cast("long") for i, name in enumerate(PIECES)}
    marked = turns.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), F.floor(F.col("pos") / RUN).alias("_run"),
        F.regexp_count("text", F.lit(NOT_SPACE)).cast("long").alias("tokens"), digest.alias("_hash"),
    ).withColumns(pieces).drop("_hash")
    before = W.partitionBy("conv_id").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    starts = marked.groupBy("conv_id", "_run").agg(*[F.sum(s).alias(s) for s in PIECES]).select(
        "conv_id", "_run", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_{s}") for s in PIECES])
    inside = W.partitionBy("conv_id", "_run").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    summed = marked.withColumns({s: F.sum(s).over(inside) for s in PIECES}).join(starts, ["conv_id", "_run"])
    turns_on = summed.join(lengths, "conv_id").select(
        "conv_id", "depth", "length", "tokens", *[(F.col(s) + F.col(f"_{s}")).alias(s) for s in PIECES])
    nothing = F.lit(0).cast("long")
    return turns_on.unionByName(lengths.select(
        "conv_id", nothing.alias("depth"), "length", nothing.alias("tokens"), *[nothing.alias(s) for s in PIECES]))


def _digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of (conv_id, depth, member): ids in ascending order, hashed one after the other.

    A hash over a list has to read it in order, so the members of one node are one stream
    of one task; nothing but the state of the hash is kept.
    """

    def run(batches):
        import pyarrow as pa

        current, state, out = None, None, []
        for batch in batches:
            for conv, depth, member in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (conv, depth) == current:
                    state.update(f",{member}".encode())
                    continue
                if current is not None:
                    out.append((*current, state.hexdigest()))
                current, state = (conv, depth), hashlib.sha256(str(member).encode())
            yield _batch(out, pa)
            out = []
        if current is not None:
            yield _batch([(*current, state.hexdigest())], pa)

    def _batch(rows, pa):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))],
            names=["conv_id", "depth", "ends_sha256"])

    dealt = ends.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "member")
    return dealt.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def split_components(conv, depth, parent, top_conv, top_depth, weight, gained, values):
    """Subtree sums of whole components held in arrays, by centroid decomposition of all of them at once.

    Rows are nodes (conv, depth) with their parent's conv (its depth is one less), the top of
    their component, the weight below them in it, and per value what they ``gained`` from
    parts split off before and what they hold themselves. Gives gained + sums below.
    """
    n = len(conv)
    names, code = np.unique(conv, return_inverse=True)
    key = depth.astype(np.int64) * len(names) + code
    by_key = np.argsort(key)
    is_top = (conv == top_conv) & (depth == top_depth)
    above = np.minimum(np.searchsorted(names, parent), len(names) - 1)
    wanted = (depth - 1) * len(names) + above
    up = by_key[np.minimum(np.searchsorted(key, wanted, sorter=by_key), n - 1)]
    up[is_top] = -1
    # Places in preorder: a node's interval holds those of all below it.
    siblings = np.argsort(up, kind="stable")
    running = np.cumsum(weight[siblings]) - weight[siblings]
    first = np.searchsorted(up[siblings], up[siblings])
    offset = np.empty(n, np.int64)
    offset[siblings] = running - running[first]
    offset[is_top] = -1
    place, level = np.zeros(n, np.int64), depth - top_depth
    by_level = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[by_level], np.arange(level.max() + 2))
    for low, high in zip(bounds[1:-1], bounds[2:], strict=True):
        rows = by_level[low:high]
        place[rows] = place[up[rows]] + 1 + offset[rows]
    end = place + weight
    label = np.empty(n, np.int64)
    order = np.lexsort((place, top_depth, top_conv))
    label[order] = np.cumsum(is_top[order])
    weight, gained, out = weight.copy(), gained.copy(), np.zeros_like(gained)
    rows = np.arange(n)
    while len(rows):
        rows = rows[np.lexsort((place[rows], label[rows]))]
        here = np.arange(len(rows))
        starts = np.flatnonzero(np.concatenate([[True], label[rows[1:]] != label[rows[:-1]]]))
        comp = np.cumsum(np.bincount(starts, minlength=len(rows))) - 1
        heavy = 2 * weight[rows] > weight[rows[starts]][comp]
        centre = np.maximum.reduceat(np.where(heavy, here, -1), starts)
        centroid = rows[centre]
        below = (place[rows] >= place[centroid][comp]) & (place[rows] < end[centroid][comp])
        total = np.add.reduceat(np.where(below[:, None], values[rows], 0), starts, axis=0)
        out[centroid] = gained[centroid] + total
        gone = np.zeros(len(rows), bool)
        gone[centre] = True
        way = rows[heavy & ~gone]
        way_comp = comp[heavy & ~gone]
        lost = weight[centroid]
        gained[way] += total[way_comp]
        weight[way] -= lost[way_comp]
        child = below & (up[rows] == centroid[comp])
        label[rows] = np.where(below, np.maximum.accumulate(np.where(child, here, 0)), starts[comp])
        rows = rows[~gone]
    return out


def subtree_sums(nodes: DataFrame, ways: DataFrame, values: list[str], *, small: int = SMALL) -> DataFrame:
    """(conv_id, depth, values...): each value summed over the subtree of each node.

    ``nodes``: (conv_id, depth, parent, weight, values...), stored; weight is a positive number summed
    over the subtree. ``ways``: (conv_id, depth, rep, next), the node that a conversation passes
    at a depth and the one after it. Components of more than ``small`` nodes are split by
    joins, at most log2(weight) rounds; a round moves the rows of large components only.
    """
    if nodes.isEmpty():
        return nodes.select("conv_id", "depth", *values)
    gains = [f"_gained_{v}" for v in values]
    top = nodes.where("depth = 0").first()
    zero = F.lit(0).cast("long")
    state = nodes.select("conv_id", "depth", "parent", F.lit(top.conv_id).cast("long").alias("top_conv"), zero.alias("top_depth"),
                         "weight", *values, *[zero.alias(g) for g in gains])
    shape, tops = state.columns, ["top_conv", "top_depth"]
    solved, ready = [], []
    while True:
        sizes = state.groupBy(*tops).agg(F.count(F.lit(1)).alias("_size"), F.max("weight").alias("_total"))
        sized = stored_table(state.join(sizes, tops))
        ready.append(sized.where(F.col("_size") <= small).select(shape))
        large = sized.where(F.col("_size") > small)
        if large.isEmpty():
            break
        heavy = 2 * F.col("weight") > F.col("_total")
        centre = large.where(heavy).groupBy(*tops).agg(F.max(F.struct("depth", "conv_id", "weight")).alias("_centre"))
        passed = ways.select(F.col("conv_id"), F.col("depth").alias("_at"), "rep", "next")
        met = large.withColumn("_heavy", heavy).join(centre, tops).withColumn("_at", F.col("_centre.depth")).join(
            passed, ["conv_id", "_at"], "left")
        under = F.coalesce((F.col("depth") >= F.col("_at")) & (F.col("rep") == F.col("_centre.conv_id")), F.lit(False))
        split = stored_table(met.withColumn("_under", under))
        totals = split.where("_under").groupBy(*tops).agg(*[F.sum(v).cast("long").alias(f"_total_{v}") for v in values])
        known = split.join(totals, tops).withColumn("_found", F.col("_under") & (F.col("depth") == F.col("_at")))
        solved.append(known.where("_found").select("conv_id", "depth", *[
            (F.col(g) + F.col(f"_total_{v}")).alias(v) for v, g in zip(values, gains, strict=True)]))
        way = F.col("_heavy") & ~F.col("_found")
        moved = F.col("_under")
        state = stored_table(known.where("NOT _found").select(
            "conv_id", "depth", "parent", F.when(moved, F.col("next")).otherwise(F.col("top_conv")).alias("top_conv"),
            F.when(moved, F.col("_at") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
            (F.col("weight") - F.when(way, F.col("_centre.weight")).otherwise(0)).alias("weight"), *values,
            *[(F.col(g) + F.when(way, F.col(f"_total_{v}")).otherwise(0)).alias(g) for v, g in zip(values, gains, strict=True)]))
    k = len(values)

    def finish(batches):
        import pyarrow as pa

        def solve(rows):
            column = [np.asarray(rows.column(i).fill_null(0)) for i in range(6 + 2 * k)]
            value, gained = (np.stack([c.astype(np.int64) for c in part], axis=1) for part in (column[6:6 + k], column[6 + k:]))
            sums = split_components(*column[:6], gained, value)
            return pa.RecordBatch.from_arrays([pa.array(column[0]), pa.array(column[1]), *[pa.array(sums[:, i]) for i in range(k)]],
                                              names=["conv_id", "depth", *values])

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < 4 * small:
                continue
            # All but the last component are whole.
            table = pa.Table.from_batches(held).combine_chunks()
            top = np.stack([np.asarray(table.column(3)), np.asarray(table.column(4))])
            same = np.flatnonzero((top != top[:, -1:]).any(axis=0))
            cut = int(same[-1]) + 1 if len(same) else 0
            if cut:
                yield solve(table.slice(0, cut).combine_chunks())
                held = table.slice(cut).to_batches()
                size = table.num_rows - cut
        if size:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    waiting = ready[0]
    for part in ready[1:]:
        waiting = waiting.unionByName(part)
    local = waiting.repartition(*tops).sortWithinPartitions(*tops).mapInArrow(
        finish, ", ".join(f"{c} long" for c in ("conv_id", "depth", *values)))
    for part in solved:
        local = local.unionByName(part)
    return local


def prefix_trie(turns: DataFrame, lengths: DataFrame, *, small: int = SMALL) -> DataFrame:
    """One row per distinct sequence of first turns of any conversation.

    ``turns``: (conv_id, pos, role, text) without NULLs, pos from 0 without gaps (``number_turns``);
    ``lengths``: (conv_id, length) of every conversation, those without turns too. Result:
    conv_id, the smallest member; depth, 0 for the root, which has no text; parent_conv_id (NULL
    for the root); n_convs, members; n_children; n_leaves, childless nodes at or below;
    saved_tokens, (members - 1) x words of the last text, summed at and below; ends_sha256,
    SHA-256 of the ids of the members that end here, ascending, joined by commas. Equal
    conversations share all nodes. No conversations give no rows. Runs jobs; paths and
    rounds are written to the shared folder.
    """
    key = ["depth", *PIECES]
    paths = stored_table(_paths(turns, lengths))
    groups = paths.groupBy(*key).agg(
        F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.max("tokens").alias("tokens"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"))
    groups = stored_table(groups)
    steps = stored_table(paths.join(groups.select(*key, "rep"), key).select("conv_id", "depth", "length", "rep"))
    after = steps.select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("rep").alias("next"))
    ways = stored_table(steps.drop("length").join(after, ["conv_id", "depth"], "left"))
    parents = ways.where(F.col("next") == F.col("conv_id")).select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent"))
    children = parents.groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored_table(
        groups.select(F.col("rep").alias("conv_id"), "depth", "n_convs", "weight", ((F.col("n_convs") - 1) * F.col("tokens")).alias("saved_tokens"))
        .join(parents, ["conv_id", "depth"], "left").join(children, ["conv_id", "depth"], "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
        .withColumn("n_leaves", (F.col("n_children") == 0).cast("long")))
    values = ["n_leaves", "saved_tokens"]
    sums = subtree_sums(nodes.select("conv_id", "depth", "parent", "weight", *values), ways, values, small=small)
    ends = _digests(steps.where("depth = length").select(F.col("rep").alias("conv_id"), "depth", F.col("conv_id").alias("member")))
    none = hashlib.sha256(b"").hexdigest()
    return (nodes.drop(*values).join(sums, ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left")
            .select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
