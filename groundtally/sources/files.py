"""Integrity of files of any size: a tree of digests over byte ranges, held against a manifest.

Files are listed with their lengths, every file is cut into ranges, and ranges are read and digested wherever a task is
free. A file of one range has the plain digest of its bytes; otherwise the hex digests of up to :data:`FAN` successive
ranges are joined and digested anew, level by level, until one is left. No content is ever held beyond one range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtally.session import cut_lineage

RANGE_BYTES, FAN = 4 << 20, 1024
ALGORITHMS = ("md5", "sha256")
LEAVES = "name string, size long, at long, digest string"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, size) of every file below ``path``; contents aren't read. A partition folder names the one file in it.

    Spark's file sources pass over files of no bytes, so such a file counts as missing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    parts = F.split("path", "/")
    last, folder = F.element_at(parts, -1), F.element_at(parts, -2)
    return files.select(F.when(last.startswith("part-") & folder.contains("="), folder).otherwise(last).alias("name"), "path", "size")


def _opened(path: str):
    """A random-access file of any file system that Arrow knows; a plain path is local to all nodes."""
    from pyarrow import fs

    at = urlparse(path)
    if at.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(at.path) if at.scheme else path)
    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


def range_digests(files: DataFrame, algorithm: str = "md5", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(name, size, at, digest) of every range. A file that shrinks while it is read
    gives digests of what is left."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unsupported digest {algorithm}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            digests = []
            for own, at in zip(batch.column("path").to_pylist(), batch.column("at").to_pylist()):
                if own != path:
                    if source is not None:
                        source.close()
                    path, source = own, _opened(own)
                source.seek(at * range_bytes)
                digests.append(hashlib.new(algorithm, source.read(range_bytes)).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("name", "size", "at")), pa.array(digests, pa.string())], names=["name", "size", "at", "digest"])
        if source is not None:
            source.close()

    last = F.greatest(F.ceil(F.col("size") / range_bytes) - 1, F.lit(0)).cast("long")
    ranges = files.select("name", "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("at"))
    # successive ranges stay together by stretches of FAN, so that one task opens a file once for all of them
    dealt = ranges.repartition("path", F.floor(F.col("at") / FAN)).sortWithinPartitions("path", "at")
    return dealt.mapInArrow(run, LEAVES)


def _digest(text: Column, algorithm: str) -> Column:
    return F.md5(text) if algorithm == "md5" else F.sha2(text, 256)


def tree_digests(leaves: DataFrame, algorithm: str = "md5") -> DataFrame:
    """(name, size, n_ranges, digest) of files from the digests of their ranges. A node joins FAN digests at most."""
    level = leaves.groupBy("name", "size", F.floor(F.col("at") / FAN).alias("at")).agg(
        F.count(F.lit(1)).alias("n_ranges"), F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("below"))
    while True:
        joined = F.array_join(F.transform("below", lambda b: b["digest"]), "")
        level = level.select("name", "size", "at", "n_ranges", F.when(F.size("below") == 1, joined).otherwise(_digest(joined, algorithm)).alias("digest"))
        level = cut_lineage(level)
        if level.filter("at > 0").isEmpty():
            return level.drop("at")
        level = level.groupBy("name", "size", F.floor(F.col("at") / FAN).alias("at")).agg(
            F.sum("n_ranges").alias("n_ranges"), F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("below"))


def file_digests(spark: SparkSession, path: str, algorithm: str = "md5", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(name, size, n_ranges, digest) of every file below ``path``, by ranges."""
    return tree_digests(range_digests(list_files(spark, path), algorithm, range_bytes), algorithm)


def stream_digests(lines: DataFrame, algorithm: str = "md5", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same of files still to be written, from (name, line) in file order, the rows of a name lying together.

    Lines are digested as they pass; what is held is one digest's state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size, at, state, rows = None, 0, 0, None, []

        def close() -> list[tuple]:
            done = [(name, size, i, d) for i, d in [*rows, (at, state.hexdigest())]] if state is not None else []
            rows.clear()
            return done

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found) if found else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["name", "size", "at", "digest"])

        for batch in batches:
            found: list[tuple] = []
            for own, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own != name or state is None:
                    found += close()
                    name, size, at, state = own, 0, 0, hashlib.new(algorithm)
                data = memoryview((line.as_py() or "").encode() + b"\n")
                while data:
                    if size == (at + 1) * range_bytes:
                        rows.append((at, state.hexdigest()))
                        at, state = at + 1, hashlib.new(algorithm)
                    take = data[:(at + 1) * range_bytes - size]
                    state.update(take)
                    size, data = size + len(take), data[len(take):]
            if found:
                yield batch_of(found)
        yield batch_of(close())

    return tree_digests(lines.select("name", "line").mapInArrow(run, LEAVES), algorithm)


def verify_digests(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, size, n_ranges, digest, status): found files against (name, size, digest): ok or the first mismatch."""
    own = found.select("name", F.col("size").alias("found_size"), "n_ranges", F.col("digest").alias("found"))
    return manifest.join(own, "name", "full").select(
        "name", F.col("found_size").alias("size"), "n_ranges", F.col("found").alias("digest"),
        F.when(F.col("found_size").isNull(), "missing").when(F.col("size").isNull(), "unlisted")
        .when(F.col("size") != F.col("found_size"), "size_mismatch")
        .when(F.lower("digest") != F.col("found"), "digest_mismatch").otherwise("ok").alias("status"))
