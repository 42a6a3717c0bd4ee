"""Packed token-id matrices by best-fit decreasing, with a segment tree over free capacity.

Documents are taken in shards of bounded size. Inside a shard whole ``length``-token
blocks of overlong documents become rows of their own; the rests are placed from the
longest to the shortest, each into the row with the least sufficient room, which a
segment tree over the room values finds in logarithmic time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duesflow.llm.tokens import coded_texts, worker_coder
from duesflow.llm.util import open_store, write_whole

SHARDS = "shard string, n_rows long, n_tokens long, n_pieces long, folder string"
ROWS = ("sequence_id long, n_tokens long, doc_ids array<long>, starts array<long>, cu_seqlens array<long>, "
        "resets array<long>, ids binary")


class RoomTree:
    """Rows by their free room; ``take(need)`` gives one with the least room of at least ``need``."""

    def __init__(self, most: int):
        self._size = 1 << most.bit_length()
        self._any = bytearray(2 * self._size)
        self._rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self._rows[room].append(row)
        node = room + self._size
        while node and not self._any[node]:
            self._any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        node = need + self._size
        if not self._any[node]:
            while node > 1 and not (node & 1 == 0 and self._any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self._size:
                node = 2 * node if self._any[2 * node] else 2 * node + 1
        room = node - self._size
        row = self._rows[room].pop()
        if not self._rows[room]:
            while node and not (node < self._size and (self._any[2 * node] or self._any[2 * node + 1])):
                self._any[node] = 0
                node >>= 1
        return room, row


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Rows of (item, start, length): each item's ids lie in exactly one place."""
    rows: list[list[tuple[int, int, int]]] = []
    rests = []
    for item, size in enumerate(sizes):
        whole = size - size % length
        rows += [[(item, at, length)] for at in range(0, whole, length)]
        if size > whole:
            rests.append((size - whole, item, whole))
    tree = RoomTree(length)
    for size, item, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        found = tree.take(size)
        room, row = found if found else (length, len(rows))
        if not found:
            rows.append([])
        rows[row].append((item, start, size))
        if room > size:
            tree.put(room - size, row)
    return rows


def write_matrices(docs: DataFrame, tokenizer: str, folder: str, *, length: int = 2048, end_id: int = 49407,
                   shard_tokens: int = 1 << 22, shard_docs: int = 8192) -> DataFrame:
    """Tokenize, pack and write shards of packed rows; one row per shard written.

    A shard ``<name>.npz`` (deflate) in ``folder`` holds ``ids`` (rows x length; uint16
    where all ids fit, else uint32; rows are filled up with ``end_id``), ``cu_seqlens``
    (for each row the cumulative segment lengths from 0, one after the other, with
    ``row_starts`` into them), ``resets`` (one bit per id, packed, set where positions
    start again at 0; the padding is a segment of its own), and ``doc_ids``, ``starts``,
    ``known`` per segment.

    ``docs`` holds ``doc_id`` and ``text``; other columns are ignored. NULL text counts
    as empty and gives the end id alone; a NULL ``doc_id`` is written as such
    (``known`` is false). Repeated rows are packed each, ties in length in order of
    arrival. An empty table writes no shard. The frame returned must be stored once:
    each run of it writes the shards again under the same names.
    """

    def write(batches):
        import io
        import zipfile

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        coder, end = worker_coder(tokenizer), end_id.to_bytes(4, "little")

        def shard(number: int, docs: list, coded: list[bytes]):
            rows = best_fit_decreasing([len(c) // 4 for c in coded], length)
            ids = np.full((len(rows), length), end_id, "<u4")
            resets = np.zeros((len(rows), length), bool)
            cumulative, row_starts, docs_of, starts = [], [0], [], []
            for r, row in enumerate(rows):
                at = 0
                cumulative.append(0)
                for item, start, size in row:
                    ids[r, at:at + size] = np.frombuffer(coded[item], "<u4", size, 4 * start)
                    resets[r, at] = True
                    at += size
                    cumulative.append(at)
                    docs_of.append(docs[item])
                    starts.append(start)
                if at < length:
                    resets[r, at] = True
                row_starts.append(len(cumulative))
            name = f"shard-{part:06d}-{number:05d}.npz"
            packed = io.BytesIO()
            arrays = {
                "ids": ids.astype("<u2") if ids.max() < 1 << 16 else ids, "resets": np.packbits(resets, axis=1),
                "cu_seqlens": np.array(cumulative, "<i8"), "row_starts": np.array(row_starts, "<i8"),
                "doc_ids": np.array([d or 0 for d in docs_of], "<i8"), "known": np.array([d is not None for d in docs_of]),
                "starts": np.array(starts, "<i8")}
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
                for key, array in arrays.items():
                    with archive.open(f"{key}.npy", "w", force_zip64=True) as file:
                        np.lib.format.write_array(file, array)
            with write_whole(folder, name, attempt) as out:
                out.write(packed.getbuffer())
            return pa.RecordBatch.from_pydict({
                "shard": [name], "n_rows": [len(rows)], "n_tokens": [sum(len(c) for c in coded) // 4],
                "n_pieces": [len(docs_of)], "folder": [folder]})

        docs, coded, size, number = [], [], 0, 0
        for doc, ids in coded_texts(coder, batches):
            docs.append(doc)
            coded.append(ids + end)
            size += len(coded[-1]) // 4
            if size >= shard_tokens or len(docs) >= shard_docs:
                yield shard(number, docs, coded)
                docs, coded, size, number = [], [], 0, number + 1
        if docs:
            yield shard(number, docs, coded)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(write, SHARDS)


def read_matrices(shards: DataFrame) -> DataFrame:
    """One row per packed row of the shards that ``write_matrices`` named.

    ``doc_ids`` and ``starts`` tell the segments, ``cu_seqlens`` where they end, ``resets``
    where positions start again, ``ids`` the row's real ids as little-endian uint32.
    """

    def read(batches):
        import io
        import posixpath

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = open_store(folder)
                with store.open_input_file(posixpath.join(path, name)) as file:
                    data = np.load(io.BytesIO(file.read()))
                ids, cumulative, row_starts = data["ids"], data["cu_seqlens"], data["row_starts"]
                resets = np.unpackbits(data["resets"], axis=1, count=ids.shape[1])
                doc_ids = [d if k else None for d, k in zip(data["doc_ids"].tolist(), data["known"], strict=True)]
                starts = data["starts"].tolist()
                part, number = (int(x) for x in name[6:-4].split("-"))
                base = part << 40 | number << 24
                for first in range(0, len(ids), 512):
                    rows = range(first, min(first + 512, len(ids)))
                    cu = [cumulative[row_starts[r]:row_starts[r + 1]] for r in rows]
                    at = [int(row_starts[r]) - r for r in rows]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([base | r for r in rows], pa.int64()),
                        pa.array([int(c[-1]) for c in cu], pa.int64()),
                        pa.array([doc_ids[a:a + len(c) - 1] for a, c in zip(at, cu, strict=True)], pa.list_(pa.int64())),
                        pa.array([starts[a:a + len(c) - 1] for a, c in zip(at, cu, strict=True)], pa.list_(pa.int64())),
                        pa.array([c.tolist() for c in cu], pa.list_(pa.int64())),
                        pa.array([np.flatnonzero(resets[r]).tolist() for r in rows], pa.list_(pa.int64())),
                        pa.array([ids[r, :int(c[-1])].astype("<u4").tobytes() for r, c in zip(rows, cu, strict=True)], pa.binary()),
                    ], names=[c.split()[0] for c in ROWS.split(", ")])

    return shards.select("shard", "folder").mapInArrow(read, ROWS)
