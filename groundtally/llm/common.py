"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtally.session import ensure_checkpoint_dir

#: Bytes of a part of a batch that Python works on at once.
PART_BYTES = 8 << 20
CAPITALS, SMALLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` to a table of its own in the shared checkpoint folder and go on from the copy.

    Cuts the lineage like ``checkpoint()``, but as compressed Parquet; a lost executor costs no
    recomputation of anything before it. The folder is the cluster's to clean between jobs.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII takes the built-in's fast path; the rest is translated."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALLS))


def digest_of(text: Column) -> Column:
    """SHA-256 of the text, in hex; null is empty."""
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def _parts(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of ``rows`` rows, halved while they hold more than :data:`PART_BYTES`."""
    for start in range(0, batch.num_rows, rows):
        part = batch.slice(start, rows)
        if part.num_rows > 1 and part.nbytes > PART_BYTES:
            yield from _parts(part, (part.num_rows + 1) // 2)
        else:
            yield part


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """Arrow-batched map of columns to columns; ``make`` builds the mapper once per task.

    The mapper gets a dict of lists and returns one; a batch is cut into parts of 512 rows or 8 MB, whichever
    comes first, since rows may be very long. A longer row is a part of its own.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = make()
        for batch in batches:
            size = max(1, batch.nbytes // max(1, batch.num_rows))
            step = max(1, min(512, PART_BYTES // size))
            for part in _parts(batch, step):
                out = mapper({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
