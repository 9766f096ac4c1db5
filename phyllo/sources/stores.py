"""Files of any store that pyarrow's file systems know, named by a path or a URI."""

from __future__ import annotations

import io
import posixpath
import re
import uuid

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store(path: str) -> tuple[FileSystem, str]:
    """(file system, path within it) of a path or URI; ``file:/x`` counts like ``file:///x``."""
    path = re.sub(r"^file:/+", "/", path)
    return FileSystem.from_uri(path) if re.match(r"\w+://", path) else (LocalFileSystem(), path)


def opened(path: str, ahead: int = 1 << 20) -> io.BufferedReader:
    """A file for reading by place and by line, ``ahead`` bytes at a time."""
    system, inner = store(path)
    return io.BufferedReader(system.open_input_file(inner), ahead)


def exists(path: str) -> bool:
    system, inner = store(path)
    return system.get_file_info(inner).type != FileType.NotFound


def files_of(path: str, ending: str) -> list[str]:
    """The file itself, or the files below a folder whose name has the ending, sorted."""
    system, inner = store(path)
    if system.get_file_info(inner).type != FileType.Directory:
        return [path]
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted(head + f.path for f in system.get_file_info(FileSelector(inner, recursive=True)) if f.is_file and f.path.endswith(ending))


def write_whole(path: str, data: bytes) -> None:
    """A small file."""
    system, inner = store(path)
    system.create_dir(posixpath.dirname(inner), recursive=True)
    with system.open_output_stream(inner, compression=None) as out:
        out.write(data)


def write_each(files: DataFrame, path: str = "path", raw: str = "raw") -> int:
    """Write every row's binary as a file of its own, by the tasks that hold the rows; how many there are.

    A file is written under another name and moved into place, so a task that runs
    again leaves the same files. Of rows with one path, one's data stays.
    """

    def run(batches):
        n = 0
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                system, inner = store(name)
                system.create_dir(posixpath.dirname(inner), recursive=True)
                own = f"{posixpath.dirname(inner)}/.{uuid.uuid4().hex}"
                with system.open_output_stream(own, compression=None) as out:
                    out.write(data.as_buffer())
                system.move(own, inner)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    done = files.select(F.col(path).alias("path"), F.col(raw).cast("binary").alias("raw")).mapInArrow(run, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_joined(parts: DataFrame, path: str, head: bytes, at: str = "at", raw: str = "raw") -> int:
    """Write ``head`` and the binaries of ``parts`` in the order of ``at`` as one file; the bytes written.

    One task writes the file, under a name of its own that is moved into place
    when all is there; the driver holds none of it.
    """

    def run(batches):
        system, inner = store(path)
        system.create_dir(posixpath.dirname(inner), recursive=True)
        own, size = f"{inner}.{uuid.uuid4().hex}", len(head)
        with system.open_output_stream(own, compression=None) as out:
            out.write(head)
            for b in batches:
                for value in b.column(0):
                    out.write(value.as_buffer())
                    size += len(value.as_buffer())
        system.move(own, inner)
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], names=["size"])

    ordered = parts.select(F.col(at).alias("at"), F.col(raw).alias("raw")).repartition(1).sortWithinPartitions("at").select("raw")
    sizes = ordered.mapInArrow(run, "size long").collect()  # one row; none if there is no part
    if not sizes:
        write_whole(path, head)
    return sizes[0]["size"] if sizes else len(head)
