"""Helpers the operators share."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duesflow.session import cut_lineage, work_dir

__all__ = ["crc_part", "cut_lineage", "open_store", "shared_folder", "stored_table", "text_or_empty"]

# The ASCII white space that separates tokens, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_part(name: str, parts: int, part: int) -> Column:
    """True where crc32 of the value as text leaves ``part``; NULL counts as false."""
    return F.coalesce(F.crc32(F.col(name).cast("string")) % parts == part, F.lit(False))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as no column of ``df`` has, in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def stored_table(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that later uses read one and the same result."""
    return cut_lineage(df)


def shared_folder(spark: SparkSession) -> str:
    """A new folder on storage that driver and executors share, as a URI."""
    path = work_dir(spark)
    return path if ":" in path.split("/", 1)[0] else f"file://{path}"


def open_store(folder: str):
    """(file system, path) of a folder URI, for binary files that Spark has no writer for."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[len("file:"):].lstrip("/")
    store, path = fs.FileSystem.from_uri(folder)
    return store, path


def write_whole(folder: str, name: str, attempt: int):
    """A writer context for ``folder/name`` whose file appears only when complete.

    A task that is run again writes under another temporary name and replaces the
    file by one with the same content.
    """
    import contextlib

    @contextlib.contextmanager
    def writing():
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        hidden = posixpath.join(path, f".{name}.{attempt}")
        with store.open_output_stream(hidden, compression=None) as out:
            yield out
        store.move(hidden, posixpath.join(path, name))

    return writing()
