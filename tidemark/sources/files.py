"""Paths: listing and opening through Arrow's file systems, and the shared folder."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

DEFAULT_SHARED = "file:///tmp/checkpoints/tidemark"


def shared_uri(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; only a session on one machine has a default."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or DEFAULT_SHARED).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def locate(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listing(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files at or below ``path``, sorted; hidden and temporary names are left out."""
    where, root = locate(path)
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    info = where.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = where.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in f.path[len(root) :].split("/")))


def open_input(path: str):
    where, name = locate(path)
    return where.open_input_file(name)


def read_at(path: str):
    """A function ``(at, n) -> bytes``."""
    source = open_input(path)
    return lambda at, n: source.read_at(n, at) if at < source.size() else b""


def publish(path: str, data: bytes) -> None:
    """Write a file that has its final name only when it is whole."""
    where, name = locate(path)
    where.create_dir(name.rsplit("/", 1)[0], recursive=True)
    temp = f"{name.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(temp, compression=None) as f:
        f.write(data)
    where.move(temp, name)
