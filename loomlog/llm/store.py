"""Arrays in the shared folder, written by tasks and memory-mapped by others."""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np
import pyarrow.fs

from loomlog.llm.flat import worker_cache

# arrays that a worker keeps: mapped ones by their number, as a process may map only so many
# files, and read ones by their bytes
MOST_MAPPED, MOST_READ = 16_384, 512 << 20


def _local(uri: str) -> str | None:
    """The path of a file system that is mounted on all machines, else None."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def _opened(folder: str):
    """The file system of a folder, and the path in it."""
    path = _local(folder)
    if path is None:
        return pyarrow.fs.FileSystem.from_uri(folder)
    return pyarrow.fs.LocalFileSystem(), path


def put(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array under its name. A repeated task writes the same bytes again, whole."""
    put_joined(folder, name, [array])


def put_joined(folder: str, name: str, arrays) -> None:
    """As ``put``, for arrays that come one at a time and are written end to end."""
    fs, path = _opened(folder)
    fs.create_dir(path, recursive=True)
    passing = f"{path}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(passing) as out:
        for array in arrays:
            out.write(np.ascontiguousarray(array).data.cast("B") if array.size else b"")
    fs.move(passing, f"{path}/{name}")


def read(folder: str, name: str, dtype) -> np.ndarray:
    """An array by its name, which the worker does not keep."""
    fs, path = _opened(folder)
    with fs.open_input_file(f"{path}/{name}") as file:
        return np.frombuffer(file.read(), dtype)


def exists(folder: str, name: str) -> bool:
    fs, path = _opened(folder)
    return fs.get_file_info(f"{path}/{name}").type == pyarrow.fs.FileType.File


def delete(folder: str, name: str) -> None:
    """Delete an array that nothing reads any more, if it is there."""
    if exists(folder, name):
        fs, path = _opened(folder)
        fs.delete_file(f"{path}/{name}")


def get(folder: str, name: str, dtype) -> np.ndarray:
    """An array by its name: memory-mapped where the folder is mounted, else read.

    The worker keeps those used last, so that most files are opened once.
    """
    path = _local(folder)
    held = worker_cache().setdefault("mapped" if path else "read", OrderedDict())
    key = (folder, name)
    if key not in held:
        if path is None:
            held[key] = read(folder, name, dtype)
            size = sum(array.nbytes for array in held.values())
            while size > MOST_READ and len(held) > 1:
                size -= held.popitem(last=False)[1].nbytes
        elif os.path.getsize(f"{path}/{name}") == 0:
            held[key] = np.zeros(0, dtype)
        else:
            held[key] = np.asarray(np.memmap(f"{path}/{name}", dtype, "r"))
        while len(held) > MOST_MAPPED:
            held.popitem(last=False)
    held.move_to_end(key)
    return held[key]


def remove(spark, folder: str) -> None:
    """Remove a folder of tables and arrays that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
