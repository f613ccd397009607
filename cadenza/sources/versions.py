"""Committed table versions: a pointer that readers resolve and writers move by compare-and-set.

A version is a folder of Parquet files and one commit file, ``_commits/NNNNNNNNNN``,
with its path, its parent and the side inputs it has consumed.  Data are written
first, under a fresh name; the commit file then appears in one step, and only
if no other writer has made that version.  So readers see whole versions only,
a writer that dies leaves files that no commit names, and of two writers that
start from the same version one gets ``VersionConflict``.  A side input is
retired by the very commit that consumed it.

The step is a hard link on a local or mounted folder and a rename that fails if
the target exists on HDFS; object stores without such a rename are not fit for
two writers at once.
"""
from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class VersionConflict(Exception):
    """Another writer has committed the version first."""


@dataclass
class Version:
    number: int
    path: str | None
    parent: int = 0
    consumed: list[str] = field(default_factory=list)


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _local(path: str) -> str | None:
    """The path in the local name space, if it is one."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return path if "://" not in path else None


def _commits(spark: SparkSession, base: str) -> dict[int, Version]:
    """All commits; there is one small file for each version."""
    fs, folder = _fs(spark, f"{base}/_commits")
    if not fs.exists(folder):
        return {}
    out = {}
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.isdigit():
            stream = fs.open(status.getPath())
            try:
                told = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
            out[int(name)] = Version(int(name), told["path"], told["parent"], told["consumed"])
    return out


def current_version(spark: SparkSession, base: str) -> Version:
    """The newest committed version (number 0 and no path before the first)."""
    commits = _commits(spark, base)
    return commits[max(commits)] if commits else Version(0, None)


def read_version(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """The rows of a version, by default the newest."""
    found = current_version(spark, base) if number is None else _commits(spark, base).get(number, Version(0, None))
    if found.path is None:
        raise ValueError(f"no committed version in {base}")
    return spark.read.parquet(found.path)


def pending(spark: SparkSession, base: str, inputs: list[str]) -> list[str]:
    """The side inputs that no commit has consumed."""
    used = {p for v in _commits(spark, base).values() for p in v.consumed}
    return [p for p in inputs if p not in used]


def commit_version(spark: SparkSession, df: DataFrame, base: str, expected: int, consumed: list[str] = ()) -> Version:
    """Write ``df`` and make it version ``expected`` + 1, unless the newest version is no longer ``expected``."""
    path = f"{base}/data-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    if current_version(spark, base).number != expected:
        raise VersionConflict(f"{base} is no longer at version {expected}")
    told = json.dumps({"path": path, "parent": expected, "consumed": list(consumed)}).encode()
    folder, name = f"{base}/_commits", f"{expected + 1:010d}"
    fs, jfolder = _fs(spark, folder)
    fs.mkdirs(jfolder)
    draft = f"{folder}/.{uuid.uuid4().hex}"
    _, jdraft = _fs(spark, draft)
    stream = fs.create(jdraft, False)
    try:
        stream.write(bytearray(told))
    finally:
        stream.close()
    if local := _local(folder):
        try:
            os.link(_local(draft), f"{local}/{name}")
        except FileExistsError:
            raise VersionConflict(f"version {expected + 1} of {base} is taken") from None
    elif not fs.rename(jdraft, _fs(spark, f"{folder}/{name}")[1]):
        raise VersionConflict(f"version {expected + 1} of {base} is taken")
    return Version(expected + 1, path, expected, list(consumed))


def update(spark: SparkSession, base: str, change: Callable[[DataFrame | None], DataFrame], *, consumed: list[str] = (), tries: int = 5) -> Version:
    """Commit ``change`` of the newest version, starting anew from the newer one after a conflict."""
    for _ in range(tries):
        at = current_version(spark, base)
        try:
            return commit_version(spark, change(spark.read.parquet(at.path) if at.path else None), base, at.number, consumed)
        except VersionConflict:
            continue
    raise VersionConflict(f"{base}: {tries} tries met other commits")
