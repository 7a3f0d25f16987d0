"""Binary files in the folder all executors share, opened from inside tasks.

A path may carry any scheme that Arrow's file systems know (file, hdfs, s3, gs);
a plain absolute path is local or mounted. A task writes under a name of its own,
so a repeated or speculative attempt never touches another attempt's file; only
names that the job reported back are read.
"""

from __future__ import annotations

from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def open_new(uri: str) -> BinaryIO:
    system, path = place(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_read(uri: str) -> pa.NativeFile:
    system, path = place(uri)
    return system.open_input_file(path)


def mapped(uri: str, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped where the file system is mounted, else read."""
    system, path = place(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if system.get_file_info(path).size else np.zeros(0, dtype)
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype)
