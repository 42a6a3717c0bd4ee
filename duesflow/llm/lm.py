"""A hashed maximum-entropy language model with a class-factored softmax.

The ``CLASSES * MEMBERS`` most frequent training tokens are model words: a class, chosen by
a softmax over all classes, and a member of it, chosen by a softmax over its members. All
other tokens belong to one of ``CLASSES`` tail classes by their ending; inside a tail class
the counts, plus one, decide. Both softmaxes add up weights of hashed features: the token
before, the token before that (a skip), and the two together. Weights start at 0 with the
classes' own frequencies as bias, are trained by gradient steps in every partition, and
the partitions' changes are averaged, in two rounds over two halves of the training texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duesflow.llm.util import stored_table
from duesflow.llm.words import WordHasher

CLASSES, MEMBERS = 32, 64
ROWS = 1 << 14
SLICES = 64
END = b"\n"  # no token holds white space
HEAD = 1 << 18
LONGEST = 64
ROUNDS = 2
STATE = "doc_id long, held boolean, n_tokens long, n_known long, base double, lm double"


def tokens_of(text: str) -> list[bytes]:
    """Lower-case (A-Z) runs of characters other than ASCII white space, then the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def tail_class(token: bytes) -> int:
    import zlib

    return zlib.crc32(token[-2:]) % CLASSES


def count_tokens(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(token binary, n) over all texts of ``docs``; a task keeps at most about ``most`` sums."""

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        sums: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                sums.update(tokens_of(text.as_py() or ""))
                if len(sums) >= most:
                    yield pa.RecordBatch.from_pydict({"token": pa.array(list(sums), pa.binary()), "n": pa.array(list(sums.values()), pa.int64())})
                    sums.clear()
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(sums), pa.binary()), "n": pa.array(list(sums.values()), pa.int64())})

    return docs.select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent tokens (at most ``HEAD``) with counts, and sums over all others.

    ``total``, ``distinct``: of all training tokens. ``tail_n``, ``tail_v``: per tail class.
    """

    def __init__(self, tokens: list[bytes], counts, total: int, distinct: int, tail_n, tail_v):
        self._joined = b" ".join(tokens)
        self.counts = np.asarray(counts, np.int64)
        self.total, self.distinct = total, distinct
        self.tail_n, self.tail_v = np.asarray(tail_n, np.float64), np.asarray(tail_v, np.float64)
        self.n_model = min(CLASSES * MEMBERS, len(tokens))
        # A model word's class and member follow from its rank; other tokens' codes from their ending.
        self.codes = np.array([r if r < self.n_model else CLASSES * MEMBERS + tail_class(t) for r, t in enumerate(tokens)], np.int64)

    def facts(self) -> tuple:
        """The arguments that make this vocabulary again, as plain values for a broadcast."""
        tokens = self._joined.split(b" ") if len(self.counts) else []
        return tokens, self.counts, self.total, self.distinct, self.tail_n, self.tail_v

    def log_tail(self):
        """log10 of the room of each tail class, of which a token seen c times takes c + 1 parts."""
        return np.log10(self.tail_n + self.tail_v + 1)

    def biases(self):
        """Log frequencies: of the 2 * CLASSES classes, and of the members inside each model class."""
        counts = np.zeros(CLASSES * MEMBERS)
        counts[:self.n_model] = self.counts[:self.n_model]
        counts = counts.reshape(CLASSES, MEMBERS)
        with np.errstate(divide="ignore", invalid="ignore"):
            classes = np.concatenate([counts.sum(1), self.tail_n + 1])
            top = np.log(classes / classes.sum())
            inside = np.log(counts / counts.sum(1, keepdims=True))
        return np.maximum(top, -60).astype(np.float32), np.maximum(np.nan_to_num(inside, nan=-60.0, neginf=-60.0), -60).astype(np.float32)


def learn_vocabulary(counts: DataFrame, head: int = HEAD) -> tuple[Vocabulary, int]:
    """The vocabulary of stored ``counts`` and the count from which on all short tokens are in its head.

    The head is cut by a histogram of counts with 16 steps a doubling, so that at most
    ``head`` tokens of at most ``LONGEST`` bytes come to the driver. The step that does not
    fit as a whole fills what is left, in the order of 4,096 hash values of its tokens.
    """
    short = F.octet_length("token") <= LONGEST
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(
        F.count(F.when(short, 1)).alias("short"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    room, least, wanted = head, 1 << 62, None
    for row in steps:
        if row.short > room:
            part = F.crc32("token") % 4096
            sizes = counts.where(short & (step == row.step)).groupBy(part.alias("part")).count().orderBy("part").collect()
            end = 0
            for size in sizes:
                if size["count"] > room:
                    break
                room, end = room - size["count"], size.part + 1
            wanted = (step == row.step) & (part < end)
            break
        room, least = room - row.short, row.least
    whole = F.col("n") >= least
    taken = counts.where(short & (whole if wanted is None else whole | wanted)).collect()
    rows = sorted(((r.n, bytes(r.token)) for r in taken), key=lambda r: (-r[0], r[1]))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, numbers = [t for _, t in rows], [n for n, _ in rows]
    of_class = (F.crc32(F.substring("token", -2, 2)) % CLASSES).cast("int")
    sums = counts.groupBy(of_class.alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    tail_n, tail_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in sums:
        tail_n[row.c], tail_v[row.c] = row.n, row.v
    for n, token in rows[:CLASSES * MEMBERS]:
        tail_n[tail_class(token)] -= n
        tail_v[tail_class(token)] -= 1
    return Vocabulary(tokens, numbers, total, distinct, tail_n, tail_v), least


class Coder:
    """Ranks and codes of the tokens of many texts at once.

    Words are looked up by their 64-bit hashes, found in a table with open places; the end
    of a text is a token of its own. Two head tokens with one hash would be taken for one;
    of 2^18 tokens that happens to one vocabulary in 5 * 10^8.
    """

    def __init__(self, vocabulary: Vocabulary):
        self._hasher = WordHasher()
        tokens = vocabulary.facts()[0]
        self._end = tokens.index(END) if END in tokens else -1
        self._codes = np.append(vocabulary.codes, 0)
        words = [t for t in tokens if t != END]
        ranks = np.array([r for r, t in enumerate(tokens) if t != END], np.int64)
        hashes = np.concatenate([self._hasher(words[a:a + 4096])[0] for a in range(0, len(words), 4096)] or [np.empty(0, np.uint64)])
        self._bits = max(4, int(len(words)).bit_length() + 2)
        self._keys = np.zeros(1 << self._bits, np.uint64)
        self._ranks = np.full(1 << self._bits, -1, np.int64)
        place, left = (hashes >> np.uint64(64 - self._bits)).astype(np.int64), np.arange(len(words))
        while len(left):
            # The first of those that want a free place gets it; the others try the next.
            free = left[self._ranks[place[left]] < 0]
            _, at = np.unique(place[free], return_index=True)
            taken = free[at]
            self._keys[place[taken]], self._ranks[place[taken]] = hashes[taken], ranks[taken]
            left = np.setdiff1d(left, taken, assume_unique=True)
            place[left] = (place[left] + 1) & ((1 << self._bits) - 1)

    def _find(self, hashes):
        found = np.full(len(hashes), -1, np.int64)
        place, left = (hashes >> np.uint64(64 - self._bits)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            at = place[left]
            ranks = self._ranks[at]
            hit = self._keys[at] == hashes[left]
            found[left] = np.where(hit, ranks, -1)
            left = left[~hit & (ranks >= 0)]
            place[left] = (place[left] + 1) & ((1 << self._bits) - 1)
        return found

    def __call__(self, texts: list[str]):
        """(ranks, codes, text starts, rare): of all tokens in order; rare: (place, token) of those beyond the head."""
        coded = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        hashes, begin, end, sizes = self._hasher(coded)
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        ranks = np.full(len(hashes) + len(texts), self._end, np.int64)
        # Each text's words move by the ends before them.
        places = np.arange(len(hashes)) + np.repeat(np.arange(len(texts)), sizes)
        ranks[places] = found = self._find(hashes)
        codes = self._codes[ranks]
        joined = self._hasher.join(coded)
        missed = np.flatnonzero(found < 0)
        rare = [(p, joined[a:b]) for p, a, b in zip(places[missed].tolist(), begin[missed].tolist(), end[missed].tolist(), strict=True)]
        if self._end < 0:
            rare = sorted(rare + [(int(p), END) for p in starts + sizes])
        for place, token in rare:
            codes[place] = CLASSES * MEMBERS + tail_class(token)
        return ranks, codes, starts, rare


def _hash(kind: int, *values):
    """Feature buckets of whole arrays."""
    mixed = np.full(len(values[0]), kind * 0x9E3779B1, np.uint64)
    for value in values:
        mixed = (mixed ^ value.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 14)).astype(np.uint16)


def _run_sums(values, first, many):
    """Sums of the runs of rows that begin at ``first``: long runs one by one, short ones place by place."""
    out = np.take(values, first, axis=0)
    ones = np.ones(many.max(initial=1), np.float32)
    for i in np.flatnonzero(many >= 8).tolist():
        out[i] = ones[:many[i]] @ values[first[i]:first[i] + many[i]]
    for place in range(1, 8):
        at = np.flatnonzero((many > place) & (many < 8))
        if not len(at):
            break
        out[at] += values[first[at] + place]
    return out


class Network:
    """Weights of the class softmax (``top``) and of the member softmax (``inside``)."""

    def __init__(self, biases, top=None, inside=None):
        self.bias, self.inside_bias = biases
        self.top = np.zeros((ROWS, 2 * CLASSES), np.float32) if top is None else top
        self.inside = np.zeros((ROWS, MEMBERS), np.float32) if inside is None else inside

    @staticmethod
    def examples(codes, starts):
        """(target class, member or -1, features, member features) of concatenated texts.

        ``starts``: where texts begin. Before a text stand two marks of their own.
        """
        mark = CLASSES * (MEMBERS + 1)
        one = np.empty_like(codes)
        one[0:1], one[1:] = mark, codes[:-1]
        one[starts] = mark
        two = np.empty_like(codes)
        two[0:1], two[1:] = mark, one[:-1]
        two[starts] = mark
        is_word = codes < CLASSES * MEMBERS
        target = np.where(is_word, codes // MEMBERS, codes - CLASSES * MEMBERS + CLASSES)
        words = np.flatnonzero(is_word)
        group = target[words]
        return (target, words, codes[words] % MEMBERS, (_hash(1, one), _hash(2, two), _hash(3, one, two)),
                (_hash(4, one[words], group), _hash(5, two[words], group)))

    @staticmethod
    def _softmax(weights, bias, features):
        logits = np.take(weights, features[0], axis=0)
        for feature in features[1:]:
            logits += np.take(weights, feature, axis=0)
        logits += bias
        np.minimum(logits, 60, out=logits)
        np.exp(logits, out=logits)
        return logits, logits @ np.ones(logits.shape[1], np.float32)

    def log10(self, codes, starts):
        """log10 probability of each token's class and, for model words, of the member."""
        target, words, member, features, inner = self.examples(codes, starts)
        p, total = self._softmax(self.top, self.bias, features)
        out = np.log10(np.maximum(p[np.arange(len(codes)), target], 1e-30)) - np.log10(total)
        if len(words):
            p, total = self._softmax(self.inside, self.inside_bias[target[words]], inner)
            out[words] += np.log10(np.maximum(p[np.arange(len(words)), member], 1e-30)) - np.log10(total)
        return out.astype(np.float64)

    @staticmethod
    def _step(weights, seen, touched, bias, features, target, rate):
        p, total = Network._softmax(weights, bias, features)
        p /= -total[:, None]
        p[np.arange(len(target)), target] += 1
        for feature in features:
            order = np.argsort(feature, kind="stable")
            ordered = feature[order]
            first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            rows = ordered[first]
            many = np.diff(np.append(first, len(ordered)))
            slope = _run_sums(np.take(p, order, axis=0), first, many)
            squares = seen[rows] + np.einsum("ij,ij->i", slope, slope)
            seen[rows] = squares
            touched[rows] += many
            slope *= (rate * np.sqrt(slope.shape[1]) / np.sqrt(squares + 1.0)).astype(np.float32)[:, None]
            weights[rows] += slope

    def train(self, codes, starts, state, rate):
        """One gradient step; ``state`` holds squared slopes and touches of both weight tables."""
        target, words, member, features, inner = self.examples(codes, starts)
        self._step(self.top, state[0], state[1], self.bias, features, target, rate)
        if len(words):
            self._step(self.inside, state[2], state[3], self.inside_bias[target[words]], inner, member, rate)


def _texts_of(batches, column: int, size: int = 100_000):
    """Rows of batches in lists whose texts have about ``size`` characters."""
    rows, held = [], 0
    for batch in batches:
        for row in zip(*(c if i == column else c.to_pylist() for i, c in enumerate(batch.columns)), strict=True):
            text = row[column].as_py() or ""
            rows.append((*row[:column], text))
            held += len(text)
            if held >= size:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _batches_of(coder: Coder, batches, size: int):
    """(codes, starts) of about ``size`` tokens; a long text is cut into several steps."""
    for rows in _texts_of(batches, 0):
        _, codes, starts, _ = coder([t for t, in rows])
        for at in range(0, len(codes), size):
            yield codes[at:at + size], starts[(starts >= at) & (starts < at + size)] - at


def train(docs: DataFrame, vocabulary: Vocabulary, *, rate: float = 0.1, step_tokens: int = 4096, fan_in: int = 64) -> Network:
    """Weights trained on all texts of ``docs`` (doc_id, text).

    Each partition takes gradient steps over its texts from common weights; the changes are
    averaged row by row, weighted by how often a partition touched the row. ``fan_in``
    partitions' changes meet in one task, level by level, in ``SLICES`` slices. Runs jobs.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary.facts())
    network = Network(vocabulary.biases())
    change = "part long, slice int, weights binary, touched binary"
    width = ROWS // SLICES

    def merge(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        total, touched = 0.0, 0.0
        for r in rows:
            n = np.frombuffer(r["touched"], np.float32).astype(np.float64)
            total = total + np.frombuffer(r["weights"], np.float16).reshape(width, -1).astype(np.float64) * n[:, None]
            touched = touched + n
        mean = total / np.maximum(touched, 1)[:, None]
        return pa.Table.from_pydict({
            "part": pa.array([rows[0]["part"] // fan_in], pa.int64()), "slice": pa.array([rows[0]["slice"]], pa.int32()),
            "weights": pa.array([mean.astype(np.float16).tobytes()], pa.binary()),
            "touched": pa.array([touched.astype(np.float32).tobytes()], pa.binary())})

    for turn in range(ROUNDS):
        weights = spark.sparkContext.broadcast((network.top, network.inside))

        def learn(batches, weights=weights):
            import pyarrow as pa
            from pyspark import TaskContext

            words = Vocabulary(*shared.value)
            top, inside = weights.value
            net = Network(words.biases(), top.copy(), inside.copy())
            state = [np.zeros(ROWS, np.float32) for _ in range(4)]
            steps = 0
            for codes, starts in _batches_of(Coder(words), batches, step_tokens):
                net.train(codes, starts, state, rate)
                steps += 1
            if not steps:
                return
            for s in range(2 * SLICES):
                new, old, touched = (net.top, top, state[1]) if s < SLICES else (net.inside, inside, state[3])
                at = slice(s % SLICES * width, (s % SLICES + 1) * width)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "slice": pa.array([s], pa.int32()),
                    "weights": pa.array([(new[at] - old[at]).astype(np.float16).tobytes()], pa.binary()),
                    "touched": pa.array([touched[at].tobytes()], pa.binary())})

        half = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == turn) if ROUNDS > 1 else docs
        changes = stored_table(half.select("text").mapInArrow(learn, change))
        while (most := changes.agg(F.max("part")).first()[0]) is not None:
            changes = stored_table(changes.groupBy(F.floor(F.col("part") / fan_in).alias("group"), "slice").applyInArrow(merge, change))
            if most < fan_in:
                break
        for row in changes.collect():
            table = network.top if row.slice < SLICES else network.inside
            at = slice(row.slice % SLICES * width, (row.slice % SLICES + 1) * width)
            table[at] += np.frombuffer(row.weights, np.float16).reshape(width, -1).astype(np.float32)
    return network


def score_texts(docs: DataFrame, held_out, *, rate: float = 0.1) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others ignored): token counts, base and model scores.

    ``held_out``: a condition on ``doc_id``; all other rows are training texts. ``score`` is
    the log10 probability of the whole text and its end, ``base_score`` that under single
    token counts plus one. A token that no training text holds counts as one event of its
    tail class. NULL and empty texts have one token, the end. Rows with a NULL id are
    training texts; repeated rows are trained on and scored each; an empty table gives no
    rows; without training texts all tokens are unknown.

    Tokens beyond the vocabulary's head meet their counts in a join, those of the head in a
    dictionary of bounded size that every task has. Runs jobs.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    learned = texts.where(~held_out)
    counts = stored_table(count_tokens(learned))
    vocabulary, least = learn_vocabulary(counts)
    network = train(learned, vocabulary, rate=rate)
    room = vocabulary.total + vocabulary.distinct + 1
    shared = spark.sparkContext.broadcast((vocabulary.facts(), network.top, network.inside))

    def score(batches):
        from collections import Counter

        import pyarrow as pa
        from pyspark import TaskContext

        facts, top, inside = shared.value
        words = Vocabulary(*facts)
        coder, net = Coder(words), Network(words.biases(), top, inside)
        seen = np.append(words.counts, 0)
        log_base = np.log10(np.append(words.counts + 1.0, 1.0) / room)
        log_base[-1] = 0.0  # of unknown ranks the join tells
        log_tail = words.log_tail()
        log_inside = np.zeros(len(seen))
        tail = np.flatnonzero(words.codes >= CLASSES * MEMBERS)
        log_inside[tail] = np.log10(words.counts[tail] + 1.0) - log_tail[words.codes[tail] - CLASSES * MEMBERS]
        kinds = pa.schema([("key", pa.int64()), ("token", pa.binary()), ("n", pa.int64()), ("class", pa.int32()), ("doc_id", pa.int64()),
                           ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lm", pa.float64())])
        key = TaskContext.get().partitionId() << 40

        for part in _texts_of(batches, 2):
            ranks, codes, starts, rare = coder([t for *_, t in part])
            lm = _in_parts(net, codes, starts) + log_inside[ranks]
            sums = [np.add.reduceat(x, starts) for x in (lm, log_base[ranks], (seen[ranks] > 0).astype(np.int64))]
            owners = np.searchsorted(starts, [p for p, _ in rare], side="right") - 1
            rarest = [Counter() for _ in part]
            for owner, (_, token) in zip(owners.tolist(), rare, strict=True):
                rarest[owner][token] += 1
            sizes = np.diff(np.append(starts, len(ranks)))
            rows = []
            for i, (doc, held, _) in enumerate(part):
                key += 1
                once = (doc, held, int(sizes[i]), int(sums[2][i]), float(sums[1][i]), float(sums[0][i]))
                if not rarest[i]:
                    # A token that no text can hold, so that the row meets nothing and no other row.
                    rows.append((key, b" " + key.to_bytes(8, "big"), 0, 0, *once))
                for token, n in rarest[i].items():
                    rows.append((key, token, n, tail_class(token), *once))
                    once = (None,) * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    rows = texts.select("doc_id", held_out.alias("held"), "text").mapInArrow(
        score, "key long, token binary, n long, class int, " + STATE)
    # Some tokens below ``least`` are in the head too; no row asks for them.
    rare = counts.where((F.octet_length("token") > LONGEST) | (F.col("n") < least)).select("token", F.col("n").alias("c"))
    c = F.coalesce("c", F.lit(0))
    log_room = F.element_at(F.array(*[F.lit(float(x)) for x in vocabulary.log_tail()]), F.col("class") + 1)
    met = rows.join(rare, "token", "left").select(
        "key", "doc_id", "held", "n_tokens",
        (F.coalesce("n_known", F.lit(0)) + F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        (F.coalesce("base", F.lit(0.0)) + F.col("n") * F.log10((c + 1) / F.lit(float(room)))).alias("base"),
        (F.coalesce("lm", F.lit(0.0)) + F.col("n") * (F.log10(c + F.lit(1.0)) - log_room)).alias("lm"))
    return met.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.max("held").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        F.sum("base").alias("base_score"), F.sum("lm").alias("score")).drop("key")


def _in_parts(network: Network, codes, starts, size: int = 16384):
    """``network.log10`` over long stretches in bounded memory, each part with the two tokens before it."""
    if len(codes) <= 2 * size:
        return network.log10(codes, starts)
    out = []
    for at in range(0, len(codes), size):
        low = max(0, at - 2)
        inside = starts[(starts >= low) & (starts < at + size)] - low
        out.append(network.log10(codes[low:at + size], inside)[at - low:])
    return np.concatenate(out)
