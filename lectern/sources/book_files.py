"""Files of their own as a Spark source and sink: books, sitemaps, whatever is one file a row.

``spark.dataSource.register(BookFiles)``, then the format ``book_files`` writes
rows of (file, content) to a folder and reads a folder's files: a partition each,
or small ones together.
Tasks write to a staging folder, which readers don't see; the files take their
places when all tasks have finished, and vanish if the job fails. Any file system
that Arrow knows by its address will do; it has to be shared by all executors.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import time
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

STAGING = "_staging"
SCHEMA = "file string, path string, size long, content binary"


def opened(path: str):
    """The file system of an address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[a-z][a-z0-9+.-]*:", path) else f"file://{posixpath.abspath(path)}")


def checked(name: str | None) -> str:
    """A file's place below the folder: relative, no step up, no hidden part."""
    parts = (name or "").split("/")
    if not all(parts) or any(p.startswith(("_", ".")) for p in parts):
        raise ValueError(f"not a file name for a sink: {name!r}")
    return name


def packed(names: list[str]) -> bytes:
    """A list of names as the driver holds it: very many files are a few bytes each."""
    return zlib.compress(json.dumps(names).encode())


def unpacked(names: bytes) -> list[str]:
    return json.loads(zlib.decompress(names))


def listed(system, root: str) -> Iterator[tuple[str, int]]:
    """``name, size`` of the files below ``root``, one after the other: a local folder is never held as a whole."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        folders = [root]
        while folders:
            with os.scandir(folders.pop()) as found:
                for i in found:
                    if i.is_dir():
                        folders.append(i.path)
                    elif i.is_file():
                        yield posixpath.relpath(i.path, root), i.stat().st_size
    else:
        for i in system.get_file_info(fs.FileSelector(root, recursive=True)):
            if i.is_file:
                yield posixpath.relpath(i.path, root), i.size


def _hash(name: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(name)


@dataclass
class Written(WriterCommitMessage):
    """Where a task's files are, and (packed) where they belong."""

    folder: str
    files: bytes


class BookFiles(DataSource):
    """Options: path; for reading, ``ending`` (such as .txt) to take files of one kind only."""

    @classmethod
    def name(cls) -> str:
        return "book_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FileReader(self.options["path"], self.options.get("ending", ""))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        names = [f.name for f in schema.fields]
        if not {"file", "content"} <= set(names):
            raise ValueError("columns file and content are needed")
        return FileWriter(self.options["path"], overwrite, names.index("file"), names.index("content"))


#: Bytes and number of small files that one partition reads.
TOGETHER, MOST_TOGETHER = 4 << 20, 1_024
#: Files that take their places at once.
MOVERS = 8


class Some(InputPartition):
    """The names of the files of a partition, packed."""


class FileReader(DataSourceReader):
    def __init__(self, path: str, ending: str):
        self.path, self.ending = path, ending

    def partitions(self) -> list[Some]:
        system, root = opened(self.path)
        out: list[Some] = []
        names, held = [], 0
        for name, size in listed(system, root):
            if not name.endswith(self.ending) or any(p.startswith(("_", ".")) for p in name.split("/")):
                continue
            if names and (held + size > TOGETHER or len(names) == MOST_TOGETHER):
                out.append(Some(packed(names)))
                names, held = [], 0
            names.append(name)
            held += size
        return [*out, Some(packed(names))] if names else out

    def read(self, partition: Some):
        import pyarrow as pa

        system, root = opened(self.path)
        names, contents = sorted(unpacked(partition.value)), []
        for name in names:
            with system.open_input_stream(f"{root}/{name}") as f:
                contents.append(f.read())
        paths = [f"{self.path.rstrip('/')}/{name}" for name in names]
        columns = [pa.array(names, pa.string()), pa.array(paths, pa.string()), pa.array(list(map(len, contents)), pa.int64()), pa.array(contents, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "path", "size", "content"])


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, file: int, content: int):
        self.path, self.overwrite, self.file, self.content = path, overwrite, file, content
        self.job = uuid.uuid4().hex
        system, root = opened(path)
        system.create_dir(f"{root}/{STAGING}/{self.job}")

    def write(self, iterator) -> Written:
        system, root = opened(self.path)
        # an attempt's own folder: one that is given up leaves nothing that another would take
        mine = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        names: list[str] = []
        for row in iterator:
            name, content = checked(row[self.file]), row[self.content]
            staged = f"{mine}/{len(names)}"
            if not names:  # not the folder above it: an aborted job's is gone, and a task that still runs fails here
                system.create_dir(mine, recursive=False)
            with system.open_output_stream(staged) as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            names.append(name)
        return Written(mine, packed(names))

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = opened(self.path)
        done = [m for m in messages if m]
        hashes = self._hashes(done)
        twice = hashes[1:][hashes[1:] == hashes[:-1]]
        if len(twice):
            name = self._twice(done, set(twice.tolist()))
            if name:
                self.abort(messages)
                raise ValueError(f"two rows for one file: {name}")
        old = []
        if self.overwrite and system.get_file_info(root).type == fs.FileType.Directory:
            at = lambda h: hashes.searchsorted(h)
            old = [n for n, _ in listed(system, root) if not n.startswith(STAGING) and not (at(h := _hash(n)) < len(hashes) and hashes[at(h)] == h)]

        def move(pair):
            system.move(pair[0], f"{root}/{pair[1]}")

        with ThreadPoolExecutor(MOVERS) as movers:
            for m in done:
                names = unpacked(m.files)
                for folder in {posixpath.dirname(n) for n in names} - {""}:
                    system.create_dir(f"{root}/{folder}")
                list(movers.map(move, ((f"{m.folder}/{k}", n) for k, n in enumerate(names))))
        for name in old:
            system.delete_file(f"{root}/{name}")
        self._clear(system, root)

    @staticmethod
    def _hashes(done: list[Written]):
        """Hashes of all names, sorted."""
        import numpy as np

        parts = [np.fromiter(map(_hash, unpacked(m.files)), np.uint64) for m in done]
        return np.sort(np.concatenate([np.empty(0, np.uint64), *parts]))

    @staticmethod
    def _twice(done: list[Written], hashes: set) -> str | None:
        """A name that there is twice, among those of ``hashes``."""
        seen = set()
        for m in done:
            for n in unpacked(m.files):
                if _hash(n) in hashes:
                    if n in seen:
                        return n
                    seen.add(n)
        return None

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, system, root: str) -> None:
        """The job's staging folder goes, and the one of all jobs if it was the last."""
        from pyarrow import fs

        for attempt in range(10):
            with suppress(OSError):  # a task may be writing just now
                if system.get_file_info(f"{root}/{STAGING}/{self.job}").type == fs.FileType.Directory:
                    system.delete_dir(f"{root}/{STAGING}/{self.job}")
                break
            time.sleep(0.1 * attempt)
        if system.get_file_info(f"{root}/{STAGING}").type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(f"{root}/{STAGING}")):
            system.delete_dir(f"{root}/{STAGING}")


def write_files(rows: DataFrame, folder: str, file: Column, content: Column, overwrite: bool = False) -> None:
    """Write one file a row; names must differ. A null content is an empty file."""
    rows.sparkSession.dataSource.register(BookFiles)
    rows.select(file.alias("file"), content.cast("binary").alias("content")).write.format("book_files").option("path", folder).mode("overwrite" if overwrite else "append").save()


def read_files(spark, folder: str, ending: str = "") -> DataFrame:
    """``file, path, size, content`` of the files of a folder, as the text and EPUB sources take them; an unfinished job's are not there."""
    spark.dataSource.register(BookFiles)
    return spark.read.format("book_files").option("ending", ending).load(folder)


def book_name(ident: Column, file: Column) -> Column:
    """A book's file under its id, so that books of one title keep apart."""
    return F.concat_ws("-", ident.cast("string"), file)
