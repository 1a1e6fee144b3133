"""What the operators of this folder share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.session import ship

#: Text that a Python worker holds in numpy form at once, in characters.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``. Where that is
    unset a local session (tests) gets a temporary one, and any other is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
    return tempfile.mkdtemp(prefix="callweave-")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """As ``durable``, as a Parquet table of the shared folder: well compressed, read by column."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    # small row groups: a task holds one while it writes
    df.write.option("parquet.block.size", 16 << 20).option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, longer where the table has such columns, whatever their case."""
    low = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in low:
            n += "_"
        low.add(n.lower())
        out.append(n)
    return out


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about ``limit`` characters; one longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def text_slices(column: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int, list]]:
    """As ``slices``, with the texts, of which no more than a slice are in Python at once."""
    size = pc.utf8_length(column).fill_null(0).to_numpy(zero_copy_only=False).tolist()
    start = held = 0
    for i, n in enumerate(size):
        if i > start and held + n > limit:
            yield start, i, column.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += n
    if start < len(size):
        yield start, len(size), column.slice(start).to_pylist()


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` on each Arrow batch."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(run, schema)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an operator is about to add, whatever their case."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def only(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(f"`{n}`") for n in names])
