"""Session settings and shared work tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The operators rely on these; all are runtime SQL settings.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # "the first n per group" is cut in the map tasks, also for mining's larger n
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}

# Set while a work table is written: what its plan has shuffled goes when it is complete.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that functions
    of it run on nodes where nobody installed it."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent
    if not package.is_dir():
        return  # it runs from an archive, which has been shipped
    archive = Path(tempfile.mkdtemp(prefix="cinderlog-code-")) / "cinderlog-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)


def configure(spark: SparkSession) -> SparkSession:
    """Sets the runtime settings the operators' results depend on, and ships the package."""
    ship(spark)
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "cinderlog") -> SparkSession:
    """A session for tests and the bench on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall back to
    a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.conf.get("spark.master", "").startswith("local"):
        folder = tempfile.mkdtemp(prefix="cinderlog-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


class Workspace:
    """Written tables under the shared folder.

    A written table cuts lineage, survives lost executors, is read back column by
    column, and tells Catalyst its true size, so small tables are broadcast and large
    ones are not without any hint.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = configure(spark)
        self.root = root or f"{shared_folder(spark)}/work-{uuid.uuid4().hex[:12]}"
        self._written = 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self._written += 1
        path = f"{self.root}/{self._written:04d}-{name}"
        before = self.spark.conf.get(_DROP_SHUFFLES, None)
        self.spark.conf.set(_DROP_SHUFFLES, "true")
        try:
            # mostly text, which this takes to about two thirds of what the default does
            df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_DROP_SHUFFLES)
            else:
                self.spark.conf.set(_DROP_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def compact(self, df: DataFrame, name: str, like: Mapping[str, Column]) -> DataFrame:
        """``table`` for columns that mostly equal another value of their row: where they do, null
        is written, and the value is put back when read. ``like`` gives that value per column; it
        may use columns that come before in ``like``."""
        same = {column: f"_same_{column}" for column in like}
        marked = df.withColumns({same[c]: F.col(c).eqNullSafe(value) for c, value in like.items()})
        written = self.table(marked.withColumns({c: F.when(~F.col(same[c]), F.col(c)) for c in like}), name)
        for c, value in like.items():
            written = written.withColumn(c, F.when(F.col(same[c]), value).otherwise(F.col(c)))
        return written.select(*df.columns)
