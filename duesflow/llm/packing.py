"""Bounded-space online packing of documents into fixed-length windows.

Every partition keeps a fixed number of open windows. A piece goes into the open
window that it fills best; when none has room, the fullest is topped up with the
head of the piece, if the gap is worth a cut, and emitted. The windows that are
still open at the end of all partitions are merged in rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duesflow.llm.tokens import coded_texts, worker_coder
from duesflow.llm.util import stored_table

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, ids binary, closed boolean, part long")


class OpenWindows:
    """At most ``width`` windows of ``length`` tokens, best fit."""

    def __init__(self, length: int, width: int, slack: int):
        self.length, self.width, self.slack = length, width, slack
        self._room: list[tuple[int, int]] = []  # (room, window) in ascending order
        self._pieces: dict[int, list[tuple]] = {}
        self._next = 0

    def _put(self, at: int, piece: tuple) -> list[tuple] | None:
        """Put the piece into the window at place ``at``; its pieces, if it is now full."""
        import bisect

        room, window = self._room.pop(at)
        self._pieces[window].append(piece)
        if room == piece[2]:
            return self._pieces.pop(window)
        bisect.insort(self._room, (room - piece[2], window))
        return None

    def _open(self) -> None:
        self._room.append((self.length, self._next))
        self._pieces[self._next] = []
        self._next += 1

    def add(self, doc, start: int, length: int, total: int, ids: bytes):
        """Place ids ``start`` to ``start + length`` of a document; yields the windows that close.

        Only the ids of a piece are copied, so the work grows with the length of the text.
        """
        import bisect

        origin = start
        while length:
            here = 4 * (start - origin)
            at = bisect.bisect_left(self._room, (min(length, self.length), -1))
            if at == len(self._room) and len(self._room) < self.width:
                self._open()
                at = len(self._room) - 1
            if at < len(self._room):
                take = min(length, self.length)
                full = self._put(at, (doc, start, take, total, ids[here:here + 4 * take]))
                if full:
                    yield full
            else:
                room, window = self._room[0]
                take = room if room > self.slack else 0
                if take:
                    yield self._put(0, (doc, start, take, total, ids[here:here + 4 * take]))
                else:
                    self._room.pop(0)
                    yield self._pieces.pop(window)
            start, length = start + take, length - take

    def rest(self):
        """The windows still open, the fullest first."""
        for _, window in sorted(self._room):
            yield self._pieces[window]


def _row(window: list[tuple], sequence: int, part: int, closed: bool, keep_ids: bool):
    import zlib

    offset = 0
    for doc, start, length, total, ids in window:
        yield (doc, start, length, zlib.crc32(ids), total, sequence, offset,
               ids if keep_ids or not closed else None, closed, part)
        offset += length


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow_schema():
    import pyarrow as pa

    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in PIECES.split(", "))])


def pack_documents(docs: DataFrame, tokenizer: str, *, length: int = 4096, end_id: int = 2,
                   open_windows: int = 64, slack: int = 32, merge: int = 16, keep_ids: bool = True) -> DataFrame:
    """One row per piece: its document, place in it, ids, and place in a sequence.

    ``docs`` holds ``doc_id`` and ``text``; other columns are ignored. A text is
    tokenized whole (NULL: empty) and closed by ``end_id``, so an empty text is one
    token and a text longer than ``length`` is cut without loss. A NULL or repeated
    ``doc_id`` is packed like any other and stays as it is. Equal rows are packed
    each. An empty table gives no rows. ``slack`` is the largest gap that a full-up
    window may keep; ``merge`` partitions' leftovers meet in one task, round by round.

    Runs jobs: pieces are written to the shared folder before leftovers are merged.
    """

    def pack(batches):
        from pyspark import TaskContext

        schema, part, closed = _arrow_schema(), TaskContext.get().partitionId(), 0
        coder, windows, rows, size = worker_coder(tokenizer), OpenWindows(length, open_windows, slack), [], 0
        end = end_id.to_bytes(4, "little")
        for doc, ids in coded_texts(coder, batches):
            ids += end
            total = len(ids) // 4
            for window in windows.add(doc, 0, total, total, ids):
                rows += _row(window, part << 32 | closed, part, True, keep_ids)
                closed, size = closed + 1, size + 1
            if size >= 256:
                yield _batch(rows, schema)
                rows, size = [], 0
        for window in windows.rest():
            rows += _row(window, part << 32 | closed, part, False, keep_ids)
            closed += 1
        yield _batch(rows, schema)

    def merged(step: int, last: bool):
        def join(table):
            schema, out, window, fill, n = _arrow_schema(), [], [], 0, 0
            rows = sorted(table.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
            group = rows[0]["part"] // merge
            base = step << 58 | group << 32
            for r in rows:
                start, rest, ids = r["start"], r["length"], r["ids"]
                while rest:
                    take = min(rest, length - fill)
                    window.append((r["doc_id"], start, take, r["doc_tokens"], ids[:4 * take]))
                    start, rest, ids, fill = start + take, rest - take, ids[4 * take:], fill + take
                    if fill == length:
                        out += _row(window, base | n, group, True, keep_ids)
                        window, fill, n = [], 0, n + 1
            out += _row(window, base | n, group, last, keep_ids)
            import pyarrow as pa

            return pa.Table.from_batches([_batch(out, schema)])

        return join

    pieces = stored_table(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
                          .mapInArrow(pack, PIECES))
    done, step = [], 0
    while True:
        done.append(pieces.where("closed"))
        left = pieces.where("not closed")
        most = left.agg(F.max("part")).first()[0]
        if most is None:
            break
        step += 1
        last = most < merge
        pieces = stored_table(left.groupBy(F.floor(F.col("part") / merge).alias("group"))
                              .applyInArrow(merged(step, last), PIECES))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("closed", "part")
