"""Directories of one episode each, as Parquet files on a mounted file system.

A legacy dataset has as many directories and files as episodes.  Where the
folder is mounted on all machines (``file:``), tasks write and read these files
themselves: Hadoop's local file system starts a process for each permission it
sets, three of them an episode, and Spark's own scan keeps the list of all files
in the driver and gives every few of them a task.  Other stores are left to Spark.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from epistride.columns import named
from epistride.sources.publish import _path

# The names that Spark gives to directories of a partitioned table.
CHUNK, EPISODE, NO_VALUE = "episode_chunk", "episode_index", "__HIVE_DEFAULT_PARTITION__"

# A row group has at most so many rows, and is closed at so many bytes.
GROUP_ROWS = 65_536
GROUP_BYTES = 64 << 20

# Rows of several files leave a task together, up to so many.
BATCH_ROWS = 8_192

_PLAIN = (T.NumericType, T.BooleanType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path as tasks can open it, or None where only Spark reaches it."""
    made, system = _path(spark, path)
    return system.makeQualified(made).toUri().getPath() if system.getUri().getScheme() == "file" else None


def plain(kind: T.DataType) -> bool:
    """Whether Arrow's and Spark's Parquet files hold such values alike."""
    if isinstance(kind, T.StructType):
        names = [n.lower() for n in kind.names]
        return bool(names) and len(set(names)) == len(names) and all(plain(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return plain(kind.elementType)
    if isinstance(kind, T.MapType):
        return plain(kind.keyType) and plain(kind.valueType)
    return isinstance(kind, _PLAIN) and not isinstance(kind, (T.CharType, T.VarcharType))


def write_files(rows: DataFrame, folder: str) -> None:
    """Write ``rows`` to the files below ``folder`` that their column ``__file`` names.

    Rows of a file must be consecutive in one task.  A file has its name when
    it is complete; a task that runs again writes the same names.
    """
    spark = rows.sparkSession
    made, system = _path(spark, folder)
    system.mkdirs(made)
    path = mounted(spark, folder)
    names = [n for n in rows.columns if n != "__file"]
    schema = to_arrow_schema(rows.select(*[named(n) for n in names]).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, part, writer, held, size, files = None, "", None, [], [0, 0], 0

        def flush() -> None:
            nonlocal writer
            if writer is None:
                writer = pq.ParquetWriter(part, schema, compression="snappy", store_schema=False)
            writer.write_table(pa.Table.from_batches(held, schema))
            held.clear()
            size[:] = 0, 0

        def close() -> None:
            nonlocal writer, files
            if name is None:
                return
            if held:
                flush()
            writer.close()
            writer = None
            os.replace(part, f"{path}/{name}")
            files += 1

        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(batch.num_columns - 1).dictionary_encode()
            codes = at.indices.to_numpy()
            edges = [0, *(i + 1 for i in (codes[1:] != codes[:-1]).nonzero()[0].tolist()), batch.num_rows]
            data = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema)
            for start, end in zip(edges, edges[1:]):
                found = at.dictionary[int(codes[start])].as_py()
                if found != name:
                    close()
                    name = found
                    folder, _, last = f"{path}/{name}".rpartition("/")
                    os.makedirs(folder, exist_ok=True)
                    part = f"{folder}/.{last}.{uuid.uuid4().hex}"
                piece = data.slice(start, end - start)
                held.append(piece)
                size[:] = size[0] + piece.num_rows, size[1] + piece.nbytes
                if size[0] >= GROUP_ROWS or size[1] >= GROUP_BYTES:
                    flush()
        close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    placed = rows.select(*[named(n) for n in names], "__file")
    placed.mapInArrow(run, "files long").agg(F.sum("files")).collect()
    system.create(_path(spark, f"{folder}/_SUCCESS")[0], False).close()


def read_files(spark: SparkSession, path: str) -> DataFrame | None:
    """All frames below ``path``, the episode from its directory's name.

    The driver lists the chunks' directories only, and opens one file for the
    columns.  None where the folder is not laid out so, or not mounted.
    """
    folder = mounted(spark, path)
    if folder is None or not os.path.isdir(folder):
        return None
    chunks = sorted(entry.name for entry in os.scandir(folder) if entry.name[0] not in "._")
    if not all(chunk.startswith(f"{CHUNK}=") for chunk in chunks):
        return None
    files_of = _lister(folder)
    one = next((file for chunk in chunks for file in sorted(files_of(chunk))[:1]), None)
    if one is None:
        return None
    kept = spark.read.parquet(f"{path}/{one}").schema
    kept = T.StructType([f for f in kept if f.name not in (CHUNK, EPISODE)])
    if not plain(kept):
        return None
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = to_arrow_schema(kept)
    schema = columns.append(pa.field(EPISODE, pa.int64()))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                found = list(files_of(chunk))
                for start in range(0, len(found), BATCH_ROWS):
                    yield pa.RecordBatch.from_pydict({"file": pa.array(found[start : start + BATCH_ROWS], pa.string())})

    def cut(held: list[pa.Table]) -> list[pa.RecordBatch]:
        return pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=BATCH_ROWS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                told = name.split("/")[1].partition("=")[2]
                episode = pa.scalar(None if told == NO_VALUE else int(told), pa.int64())
                with pq.ParquetFile(f"{folder}/{name}") as opened:
                    for found in opened.iter_batches(batch_size=BATCH_ROWS):
                        listed = [
                            found.column(f.name).cast(f.type) if f.name in found.schema.names else pa.nulls(found.num_rows, f.type)
                            for f in columns
                        ]
                        table = pa.Table.from_arrays([*listed, pa.repeat(episode, found.num_rows)], schema=schema)
                        held.append(table)
                        rows, size = rows + table.num_rows, size + table.nbytes
                        if rows >= BATCH_ROWS or size >= GROUP_BYTES:
                            yield from cut(held)
                            held, rows, size = [], 0, 0
        if held:
            yield from cut(held)

    listed = spark.createDataFrame([(chunk,) for chunk in chunks], "chunk string").repartition(tasks, "chunk")
    placed = listed.mapInArrow(files, "file string").repartition(tasks, "file")
    return placed.mapInArrow(read, T.StructType([*kept.fields, T.StructField(EPISODE, T.LongType())]))


def _lister(folder: str) -> Callable[[str], Iterator[str]]:
    """What gives the files of a chunk's episodes, relative to ``folder``."""

    def files_of(chunk: str) -> Iterator[str]:
        for episode in os.scandir(f"{folder}/{chunk}"):
            if episode.name[0] in "._":
                continue
            if not episode.name.startswith(f"{EPISODE}="):
                raise ValueError(f"{chunk}/{episode.name} is not the directory of an episode")
            for file in os.scandir(episode.path):
                if file.name[0] not in "._":
                    yield f"{chunk}/{episode.name}/{file.name}"

    return files_of
