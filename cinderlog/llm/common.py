"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cinderlog.session import shared_folder, ship

#: Rows a Python task turns into lists at a time; long texts make Arrow batches large.
SLICE = 256


class Scratch:
    """Tables written under the shared folder: they cut lineage and outlive executors.

    Results are lazy and read these tables, so only who has written a result may `drop` them.
    """

    _noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._written = 0
        noted = Scratch._noted.get()
        if noted is not None:
            noted.append(self.root)

    @classmethod
    @contextmanager
    def noting(cls) -> Iterator[list[str]]:
        """The roots made inside, by this thread alone."""
        roots: list[str] = []
        before = cls._noted.set(roots)
        try:
            yield roots
        finally:
            cls._noted.reset(before)

    @classmethod
    def drop(cls, spark: SparkSession, roots: list[str]) -> None:
        """Deletes the tables under these roots."""
        jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for root in roots:
            folder = jvm.org.apache.hadoop.fs.Path(root)
            folder.getFileSystem(settings).delete(folder, True)

    def path(self, name: str) -> str:
        self._written += 1
        return f"{self.root}/{self._written:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one if the table has a column so named."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_slices(
    work: Callable[[pa.RecordBatch], pa.RecordBatch],
    rows: int = SLICE,
    column: int | None = None,
    size: int = 8_000_000,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work` on slices of the Arrow batches of `mapInArrow`: of up to `rows` rows and, if a
    text column is named, of texts that together take up to `size` bytes, one at least."""

    def ends(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        if column is None:
            yield from ((at, rows) for at in range(0, batch.num_rows, rows))
            return
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        at, held = 0, 0
        for k, length in enumerate(lengths):
            if k > at and (k - at == rows or held + length > size):
                yield at, k - at
                at, held = k, 0
            held += length
        if at < batch.num_rows:
            yield at, batch.num_rows - at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, count in ends(batch):
                out = work(batch.slice(at, count))
                if out is not None and out.num_rows:
                    yield out

    return run


def texts(column: pa.Array) -> list[str]:
    """The column as strings, null as the empty string."""
    return [x or "" for x in column.to_pylist()]


def clean_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def join_on(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join on equal or both null columns, which the result holds once."""
    other = right.select(*[F.col(n).alias(f"_right_{n}") if n in names else F.col(n) for n in right.columns])
    both = [left[n].eqNullSafe(other[f"_right_{n}"]) for n in names]
    on = both[0]
    for more in both[1:]:
        on = on & more
    joined = left.join(other, on, how)
    if how in ("left_anti", "left_semi"):
        return joined
    return joined.drop(*[f"_right_{n}" for n in names])
