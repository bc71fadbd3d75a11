"""Datasets appear under their name complete and checked, or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    made, system = _path(spark, path)
    return system.exists(made)


def check_output(spark: SparkSession, source: str | None, output: str) -> None:
    """Refuse an output that exists, or that is or lies inside its own source."""
    if source is not None:
        src, out = source.rstrip("/"), output.rstrip("/")
        if out == src or out.startswith(src + "/"):
            raise ValueError("the output must lie outside the source")
    if exists(spark, output):
        raise FileExistsError(f"{output} exists already")


def claimed(spark: SparkSession, path: str) -> bool:
    """Create an empty file unless it exists; of several writers at once one succeeds."""
    made, system = _path(spark, path)
    try:
        system.create(made, False).close()
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getSimpleName():
            return False
        raise
    return True


def published(spark: SparkSession, output: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a folder beside ``output``, then give it that name.

    When ``write`` fails, also in a check at its end, nothing appears under
    ``output``; what was written stays in the folder beside it.  The name is
    given under a claim, a file that only one writer can create: a rename
    onto a folder that another writer made meanwhile would nest inside it on
    some file systems.  A claim left by a writer that died must be removed.
    """
    check_output(spark, None, output)
    staged = f"{output.rstrip('/')}.staged-{uuid.uuid4().hex[:12]}"
    write(staged)
    claim = f"{output.rstrip('/')}.claim"
    if not claimed(spark, claim):
        raise FileExistsError(f"{claim} is held by another writer; the dataset is in {staged}")
    source, system = _path(spark, staged)
    target, _ = _path(spark, output)
    try:
        if system.exists(target) or not system.rename(source, target):
            raise FileExistsError(f"{output} appeared meanwhile; the dataset is in {staged}")
    finally:
        system.delete(_path(spark, claim)[0], False)


def named_parts(spark: SparkSession, folder: str, name: Callable[[dict[str, int], int], str]) -> None:
    """Give the part files of a table partitioned by numbers names of their own.

    ``name`` maps a file's partition numbers and its place among the files of
    its partition to a path beside ``folder``, which goes away.  Only names
    change; the files are listed and renamed one by one.
    """
    made, system = _path(spark, folder)
    parts: dict[tuple, list] = {}
    found = system.listFiles(made, True)
    while found.hasNext():
        path = found.next().getPath()
        if path.getName().endswith(".parquet"):
            keys = tuple(step.split("=") for step in path.toString().split("/") if "=" in step)
            parts.setdefault(tuple((k, int(v)) for k, v in keys), []).append(path)
    for keys, paths in parts.items():
        for place, path in enumerate(sorted(paths, key=lambda p: p.getName())):
            target, _ = _path(spark, f"{made.getParent().toString()}/{name(dict(keys), place)}")
            system.mkdirs(target.getParent())
            if not system.rename(path, target):
                raise FileExistsError(f"{target.toString()} exists already")
    system.delete(made, True)
