"""Small JSON records that appear whole or not at all, under names that are given out once.

A table whose parts are listed by such records changes in one step: a reader sees the parts of the last
record, and a writer that dies leaves nothing but parts that no record names.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import SparkSession

#: Versions of a path that are kept: the current one, and the one that readers may still be at.
KEPT = 2


def _place(spark: SparkSession, *parts: str):
    """File system and path, on whatever store the path names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([parts[0].rstrip("/"), *parts[1:]]))
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def put_once(spark: SparkSession, folder: str, number: int, record: dict) -> bool:
    """Write a record; False if that number has one already."""
    files, target = _place(spark, folder, f"{number:012d}.json")
    if files.exists(target):
        return False
    _, draft = _place(spark, folder, f".{uuid.uuid4().hex}")
    out = files.create(draft, True)
    try:
        out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
    finally:
        out.close()
    # Renaming is one step; of two writers one finds the name taken.
    taken = files.exists(target) or not files.rename(draft, target)
    if taken:
        files.delete(draft, False)
    return not taken


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers that have a record, ascending."""
    files, target = _place(spark, folder)
    if not files.exists(target):
        return []
    names = [s.getPath().getName() for s in files.listStatus(target)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def get(spark: SparkSession, folder: str, number: int) -> dict:
    files, target = _place(spark, folder, f"{number:012d}.json")
    stream = files.open(target)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def last(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """The record of the highest number."""
    held = numbers(spark, folder)
    return (held[-1], get(spark, folder, held[-1])) if held else None


def remove(spark: SparkSession, path: str) -> None:
    files, target = _place(spark, path)
    files.delete(target, True)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of every file below a path, by path; none where there is nothing."""
    files, target = _place(spark, path)
    if not files.exists(target):
        return []
    found, more = [], files.listFiles(target, True)
    while more.hasNext():
        status = more.next()
        name = status.getPath().getName()
        if not name.startswith((".", "_")):
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(found)


# --- versions of a table or document ---------------------------------------------------------


def _records(path: str) -> str:
    return f"{path.rstrip('/')}/_versions"


def publish(spark: SparkSession, path: str, write: Callable[[str], None], made_from: dict | None = None) -> None:
    """``write`` a new version of what lies at ``path``; it counts once its record is there, so a writer that dies
    leaves the old version readable. ``made_from`` is kept in the record."""
    folder = _records(path)
    files, target = _place(spark, folder)
    files.mkdirs(target)
    held = numbers(spark, folder)
    number = held[-1] + 1 if held else 0
    data = f"v-{number:06d}-{uuid.uuid4().hex[:8]}"
    write(f"{path.rstrip('/')}/{data}")
    if not put_once(spark, folder, number, {"data": data, "made_from": made_from}):
        raise RuntimeError(f"another writer has published version {number} of {path}")
    for old in held[: len(held) + 1 - KEPT]:
        remove(spark, f"{path.rstrip('/')}/{get(spark, folder, old)['data']}")
        remove(spark, f"{folder}/{old:012d}.json")


def current(spark: SparkSession, path: str) -> str | None:
    """Where the current version of a path lies: the path itself if it has no versions, None if nothing is there
    or no version is finished."""
    files, target = _place(spark, path)
    if not files.exists(target):
        return None
    folder = _records(path)
    files, target = _place(spark, folder)
    if not files.exists(target):
        return path
    found = last(spark, folder)
    return f"{path.rstrip('/')}/{found[1]['data']}" if found else None


def made_from(spark: SparkSession, path: str) -> dict | None:
    found = last(spark, _records(path))
    return found[1]["made_from"] if found else None


@cache
def code_version() -> str:
    """A hash of this package's source."""
    root, digest = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), hashlib.sha256()
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f not in ("__pycache__", "llm"))
        for name in sorted(n for n in names if n.endswith(".py")):
            with open(os.path.join(folder, name), "rb") as source:
                digest.update(name.encode() + source.read())
    return digest.hexdigest()[:16]


def manifest(spark: SparkSession, inputs: list[str], parameters: dict | None = None) -> dict:
    """What an output is made from: the state of its input paths, parameters and code."""
    def state(path: str) -> str:
        at = current(spark, path)
        if at != path:
            return str(at)
        return hashlib.sha256(json.dumps(listing(spark, path)).encode()).hexdigest()[:16]

    return {"inputs": {p: state(p) for p in inputs}, "parameters": json.loads(json.dumps(parameters or {})), "code": code_version()}
