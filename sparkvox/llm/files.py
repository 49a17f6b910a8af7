"""Files of own formats in the shared folder, written and read inside tasks.

A task writes each file under a name of its own and reports the name as a row;
the rows are committed by Spark's Parquet writer. So a task that runs twice
leaves a file that no row names, and readers follow the rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from sparkvox.session import scratch_path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's address below ``spark.checkpoint.dir``."""
    return re.sub(r"^file:/+", "file:///", scratch_path(spark, name))


def new_name(prefix: str, suffix: str) -> str:
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"


@contextmanager
def creating(folder: str, name: str) -> Iterator[pa.NativeFile]:
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{name}", compression=None) as out:  # bytes as given, whatever the name's ending
        yield out


@contextmanager
def opening(folder: str, name: str, seekable: bool = False) -> Iterator[pa.NativeFile]:
    fs, path = pafs.FileSystem.from_uri(folder)
    at = f"{path}/{name}"
    with fs.open_input_file(at) if seekable else fs.open_input_stream(at, compression=None) as source:
        yield source
