"""Spelling variants of the words of a corpus, found by pivotal grams.

Two words at edit distance 1 share all letters before the edit and all after it. Each word
has a prefix of grams, its three rarest bigrams (with every place of the third), and two
pivots, disjoint bigrams of that prefix chosen by dynamic programming for least frequency.
Of two near words, take the one whose prefix ends earlier in the order of rarity. The edit
misses one of its pivots: either the first, and then the other word has it at the same place
after the same letters, or the second, and then the other word has it as far from its end
before the same letters; and it stands in the other word's prefix. So pivots meet prefixes
by (gram, place, letters up to the border), an equality. Inside such a group, words are
sorted from both ends, only those that also share the half without the edit are compared,
and each is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duesflow.llm.util import stored_table

LETTERS = "[A-Za-zÀ-ÿ]+"
# Distinct words that a task collects before it hands their counts on.
COUNTED = 200_000
# Prefix rows of a group from which on its words are compared by what is left without one letter.
CROWD = 32
# Rows of a group that a task keeps; larger groups are dealt anew by longer keys.
GROUP = 50_000


def count_words(docs: DataFrame, *, text_column: str = "text", id_column: str = "doc_id", least_length: int = 7,
                least_count: int = 2, slip_every: int = 31) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z in lower case, with their occurrences.

    With ``slip_every`` = s, a run loses one code point where s divides the crc32 of
    ``<id>:<run>`` (0 turns that off). Words shorter than ``least_length`` code points or met
    fewer than ``least_count`` times are left out. A NULL text has no words; a NULL id counts
    as an empty one. Repeated rows count each; other columns are ignored; an empty table
    gives no words.
    """

    def count(batches):
        import pyarrow as pa

        run, shape = re.compile(LETTERS), ["word", "n"]
        met: Counter = Counter()

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(list(met), pa.string()), pa.array(list(met.values()), pa.int64())], names=shape)
            met.clear()
            return rows

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                text, name = text.as_py(), name.as_py()
                if not text:
                    continue
                # bytes.lower() changes A-Z only
                for word, n in Counter(run.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "replace"))).items():
                    if slip_every:
                        h = zlib.crc32(f"{'' if name is None else name}:{word}".encode())
                        if h % slip_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                    if len(word) >= least_length:
                        met[word] += n
                if len(met) >= COUNTED:
                    yield flush()
        if met:
            yield flush()

    rows = docs.select(F.col(id_column).cast("string"), F.col(text_column).cast("string")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def choose_pivots(places: list[int], cost: list[int], size: int = 2, pivots: int = 2) -> list[int]:
    """``pivots`` of the ``places`` (ascending starts of grams of ``size``) that do not overlap, of least total cost.

    best[j] is the cheapest choice of j grams among those seen so far; a gram may follow the
    best choice of j - 1 grams among those that end before it. Ties go to earlier places.
    """
    best = [[(0, [])] + [None] * pivots]
    for i, (place, price) in enumerate(zip(places, cost, strict=True)):
        free = i
        while free and places[free - 1] + size > place:
            free -= 1
        line = list(best[i])
        for j in range(1, pivots + 1):
            before = best[free][j - 1]
            if before is not None and (line[j] is None or before[0] + price < line[j][0]):
                line[j] = (before[0] + price, before[1] + [place])
        best.append(line)
    return best[-1][pivots][1]


def _key(side: str, letters: str) -> int:
    data = f"{side}{letters}".encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) << 31) ^ zlib.adler32(data)


def _gram_rows(word: str, rank: dict[str, int], count: dict[str, int]):
    """(pivot or not, side, place, rank of the last prefix gram, letters of the key) for one word."""
    grams = [word[k:k + 2] for k in range(len(word) - 1)]
    ranks = [rank[g] for g in grams]
    last = sorted(ranks)[2]
    prefix = [k for k, r in enumerate(ranks) if r <= last]
    first, second = choose_pivots(prefix, [count[grams[k]] for k in prefix])
    yield True, "L", first, second, last, word[:first + 2]
    yield True, "R", first, second, last, word[second:]
    for k in prefix:
        yield False, "L", k, 0, last, word[:k + 2]
        yield False, "R", k, 0, last, word[k:]


def near(a: str, b: str) -> bool:
    """True if exactly one inserted, deleted or replaced code point turns ``a`` into ``b``."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    at, end = 0, len(b)
    while at < end and a[at] == b[at]:
        at += 1
    return a[at + 1:] == (b[at + 1:] if len(a) == len(b) else b[at:])


def _borders(length: int, first: int, second: int) -> tuple[int, int]:
    """(border between the pivots, middle): edits at or after the border spare the first pivot, others the second."""
    middle = length // 2
    return max(first + 2, min(second, middle)), middle


def _share(side: str, word: str, first: int, second: int) -> list[tuple[str, str, str]]:
    """What a near word shares with ``word`` whose edit spares the pivot of this side: (how, start, end) per half the edit may be in."""
    border, middle = _borders(len(word), first, second)
    if side == "L":
        return [("start", word[:max(border, middle)], "")] + ([("end", word[:border], word[middle:])] if border < middle else [])
    return [("end", "", word[min(border, middle):])] + ([("start", word[:middle], word[border:])] if border > middle else [])


def _refined(side: str, row) -> list[tuple[int, tuple]]:
    """The keys of a row of a crowded group: the half that near words share is part of them."""
    pivot, first, second, last, word, n = row
    if pivot:
        return [(_key(f"{side}{how}{len(end) if how == 'end' else len(start)} ", end if how == "end" else start), row)
                for how, start, end in _share(side, word, first, second)]
    out, lengths = set(), (len(word) - 1, len(word), len(word) + 1)
    for other in lengths:
        middle = other // 2
        if side == "L":
            # the pivot stands at ``first`` here too; the border of the other word is unknown between it and the middle
            start = max(first + 2, middle)
            if start <= len(word):
                out.add(("start", word[:start]))
            out.add(("end", word[len(word) - (other - middle):]))
        else:
            tail = max(len(word) - first, other - middle)
            if tail <= len(word):
                out.add(("end", word[len(word) - tail:]))
            out.add(("start", word[:middle]))
    return [(_key(f"{side}{how}{len(part)} ", part), row) for how, part in out]


def _matches(side: str, group: list) -> list[tuple]:
    """Verified pairs (word, n, other, its n) between the pivot rows and the prefix rows of one group."""
    from bisect import bisect_left

    asked = [r for r in group if r[0]]
    there = [r for r in group if not r[0]]
    if not asked or not there:
        return []
    out = []
    if len(there) <= 8:
        for _, _, _, last, word, n in asked:
            out += [(word, n, r[4], r[5]) for r in there if r[3] >= last and near(word, r[4])]
        return out
    # Leaving out each letter of a very long word would take the square of its length.
    if len(there) >= CROWD and max(len(r[4]) for r in group) <= 256:
        return _one_out(side, asked, there)
    ordered = {"start": sorted((r[4], r[3], r[5]) for r in there)}
    starts = {"start": [r[0] for r in ordered["start"]]}
    for _, first, second, last, word, n in asked:
        found = {}
        for how, start, end in _share(side, word, first, second):
            if how == "end" and "end" not in ordered:
                ordered["end"] = sorted((r[4][::-1], r[3], r[5]) for r in there)
                starts["end"] = [r[0] for r in ordered["end"]]
            part = start if how == "start" else end[::-1]
            rows = ordered[how]
            for at in range(bisect_left(starts[how], part), len(rows)):
                text, its_last, its_n = rows[at]
                if not text.startswith(part):
                    break
                if its_last >= last:
                    other = text if how == "start" else text[::-1]
                    if near(word, other):
                        found[other] = its_n
        out += [(word, n, other, its_n) for other, its_n in found.items()]
    return out


def _one_out(side: str, asked: list, there: list) -> list[tuple]:
    """As ``_matches`` for many words: two words are near if they agree once a letter of one, or the same place of both, is out.

    Only letters outside the shared key are left out, so the work grows with the letters of
    the group, not with its pairs.
    """
    from os.path import commonprefix

    words = [r[4] for r in there] + [r[4] for r in asked]
    if side == "L":
        fixed = len(commonprefix([min(words), max(words)]))
    else:
        words = [w[::-1] for w in words]
        fixed = len(commonprefix([min(words), max(words)]))

    def part(word):
        return word[fixed:] if side == "L" else word[:len(word) - fixed]

    rests: dict[str, list] = {}
    whole: dict[str, list] = {}
    for row in there:
        text = part(row[4])
        whole.setdefault(text, []).append(row)
        for i in range(len(text)):
            rests.setdefault(text[:i] + text[i + 1:], []).append((i, row))
    out = []
    for _, _, _, last, word, n in asked:
        text = part(word)
        found = [row for _, row in rests.get(text, ())]
        for i in range(len(text)):
            rest = text[:i] + text[i + 1:]
            found += whole.get(rest, ())
            found += [row for at, row in rests.get(rest, ()) if at == i and row[4] != word]
        out += [(word, n, other, its_n) for other, its_n in {r[4]: r[5] for r in found if r[3] >= last}.items()]
    return out


ROW = "key long, side string, pivot boolean, first int, second int, last int, word string, n long"
FOUND = f"{ROW}, other string, other_n long"


def near_pairs(words: DataFrame, *, group: int = GROUP) -> DataFrame:
    """(word, n, other, other_n): each pair of near words of (word, n) once or more, in either order.

    Words need four code points at least, so that they have three bigrams; shorter ones take
    no part. The table of bigrams is counted by Spark; its size is bounded by the square of
    the number of distinct letters, which must be small (letters of alphabets: some thousand
    bigrams at most), since it goes to every task. Groups larger than ``group`` rows are not
    kept in memory: their rows are dealt once more by keys that hold the half of the word
    that near words share. Runs jobs; rows of grams are written to the shared folder.
    """
    spark = words.sparkSession
    words = words.where(F.char_length("word") >= 4).select("word", F.col("n").cast("long").alias("n"))

    def count_grams(batches):
        import pyarrow as pa

        met: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                met.update([word[k:k + 2] for k in range(len(word) - 1)])
        yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.string()), pa.array(list(met.values()), pa.int64())], names=["gram", "n"])

    grams = words.select("word").mapInArrow(count_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = {r.gram: r.n for r in grams}
    ranks = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}
    shared = spark.sparkContext.broadcast((ranks, counts))

    def rows_of(batches):
        import pyarrow as pa

        rank, count = shared.value
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(names), 4096):
                yield _table([(_key(side, letters), side, (pivot, first, second, last, word, n))
                              for word, n in zip(names[at:at + 4096], sizes[at:at + 4096], strict=True)
                              for pivot, side, first, second, last, letters in _gram_rows(word, rank, count)], pa)

    def matched(whole: bool):
        def run(batches):
            import pyarrow as pa

            pairs, kept, current, crowded = [], [], None, False
            for batch in batches:
                columns = [batch.column(i).to_pylist() for i in range(8)]
                again = []
                for key, side, *row in zip(*columns, strict=True):
                    if (key, side) != current:
                        if kept:
                            pairs += _matches(current[1], kept)
                        current, kept, crowded = (key, side), [], False
                    if crowded:
                        again += [(k, side, r) for k, r in _refined(side, tuple(row))]
                        continue
                    kept.append(row)
                    if not whole and len(kept) > group:
                        again += [(k, side, r) for old in kept for k, r in _refined(side, tuple(old))]
                        kept, crowded = [], True
                if again:
                    yield _table(again, pa, found=True)
                if len(pairs) >= 10_000:
                    yield _pairs(pairs, pa)
                    pairs = []
            if kept:
                pairs += _matches(current[1], kept)
            if pairs:
                yield _pairs(pairs, pa)

        return run

    def dealt(rows):
        # The order puts the rows of a group together; those of a pivot come last.
        return rows.repartition("key", "side").sortWithinPartitions("key", "side")

    first = stored_table(dealt(words.mapInArrow(rows_of, ROW)).mapInArrow(matched(False), FOUND))
    columns = ["word", "n", "other", "other_n"]
    pairs = first.where(F.col("other").isNotNull()).select(columns)
    crowded = first.where(F.col("other").isNull()).drop("other", "other_n")
    if not crowded.isEmpty():
        pairs = pairs.unionByName(dealt(crowded).mapInArrow(matched(True), FOUND).select(columns))
    return pairs


def _table(rows: list, pa, found: bool = False):
    kinds = (pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64())
    flat = list(zip(*((key, side, *row) for key, side, row in rows), strict=True)) or [[] for _ in kinds]
    arrays = [pa.array(column, kind) for column, kind in zip(flat, kinds, strict=True)]
    names = ["key", "side", "pivot", "first", "second", "last", "word", "n"]
    if found:
        arrays += [pa.nulls(len(rows), pa.string()), pa.nulls(len(rows), pa.int64())]
        names += ["other", "other_n"]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _pairs(pairs: list[tuple], pa):
    size = len(pairs)
    word, n, other, other_n = zip(*pairs, strict=True)
    blank = [pa.nulls(size, kind) for kind in (pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32())]
    return pa.RecordBatch.from_arrays(
        [*blank, pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(other, pa.string()), pa.array(other_n, pa.int64())],
        names=["key", "side", "pivot", "first", "second", "last", "word", "n", "other", "other_n"])


def variant_groups(words: DataFrame, *, times: int = 10, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word with its near words counted and its usual form.

    The form is the near word of largest n, ties to the first in code-point order, if that n
    is at least ``times`` (2 or more) the word's; else NULL. The root is where the forms end:
    n grows at least ``times`` from one to the next, so a chain has at most 63 of them and
    six rounds of joins, each twice as far, find every root. ``words`` holds each word once.
    Runs jobs.
    """
    words = stored_table(words.select("word", F.col("n").cast("long").alias("n")))
    found = near_pairs(words, group=group)
    both = F.array(F.struct(F.col("word"), F.col("other"), F.col("other_n")),
                   F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    links = found.select(F.inline(both)).groupBy("word", "other").agg(F.first("other_n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other"))
    nearest = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    usual = -F.col("best.minus") >= F.lit(times) * F.col("n")
    formed = stored_table(words.join(nearest, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("best.other")).alias("form"),
        F.when(usual, -F.col("best.minus")).alias("form_n")))
    steps = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(6):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = steps.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        further = stored_table(further)
        steps = further.drop("_moved")
        if further.where("_moved").isEmpty():
            break
    return formed.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
