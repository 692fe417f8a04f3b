"""Files that tasks write into the shared folder.

A task writes under a name of its own, so a task that is run again never touches another's file; only the
files named in the manifest that the job returns count, and it is written as a table before anyone reads.
"""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyspark.sql import SparkSession

from weftline.llm.common import scratch


def folder(spark: SparkSession, name: str) -> str:
    return scratch(spark, name)


def _split(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def create(parent: str, suffix: str) -> tuple[str, BinaryIO]:
    """A new file below parent: its path and an open stream."""
    path = f"{parent}/{uuid.uuid4().hex}{suffix}"
    store, inner = _split(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return path, store.open_output_stream(inner, compression=None)


def open_stream(path: str):
    """A file as a stream that is read from its start."""
    store, inner = _split(path)
    return store.open_input_stream(inner, compression=None)


def open_file(path: str):
    """A file that can be read at any place."""
    store, inner = _split(path)
    return store.open_input_file(inner)
