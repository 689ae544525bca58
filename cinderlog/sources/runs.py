"""Stored runs: parquet tables per run, valid once a commit names them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..operators.frequency import dense
from ..operators.numbering import with_previous
from ..operators.search import gram_rows
from ..plans.analyze import Analysis
from .commits import Commits, Files

RUN_SCHEMA = """
    run_id bigint, source_name string, event_count bigint, parsed_count bigint,
    unparsed_count bigint, cluster_count bigint, incident_count bigint,
    window_start timestamp, window_end timestamp, bucket_seconds bigint,
    sensitivity double, created_at timestamp
"""
CLUSTER_SCHEMA = """
    run_id bigint, cluster_id string, created bigint, template string, token_count int,
    level string, count bigint, example string, examples array<string>,
    first_seen timestamp, last_seen timestamp, services map<string,bigint>,
    primary_service string, filled array<struct<bucket_idx:int,events:bigint>>,
    n_buckets int, bucket_start timestamp, bucket_seconds bigint,
    growth_pct double, baseline_rate double, recent_count bigint, anomaly_score double,
    zscore double, is_anomaly boolean, severity string, severity_score double,
    confidence double,
    severity_factors struct<anomaly:double,level:double,criticality:double,volume:double,growth:double,breadth:double>
"""
INCIDENT_SCHEMA = """
    run_id bigint, incident_id string, rank bigint, cluster_id string, title string,
    service string, severity string, confidence double, status string,
    anomaly_score double, growth_pct double, count bigint, first_seen timestamp,
    last_seen timestamp, correlated_ids array<string>, block bigint
"""
GRAM_SCHEMA = "run_id bigint, gram string, block bigint"
STATE_SCHEMA = """
    run_id bigint, level string, severity string, bucket_idx int, events bigint,
    n_buckets int, bucket_start timestamp, bucket_seconds bigint
"""
CORRELATION_SCHEMA = """
    run_id bigint, upstream_id string, downstream_id string, kind string, detail string,
    lag_seconds double, stage int, order_a bigint, order_b bigint
"""
EXPLANATION_SCHEMA = """
    run_id bigint, incident_id string, source string, summary string, root_cause string,
    suggested_fixes array<string>, saved bigint
"""
SCHEMAS = {
    "runs": RUN_SCHEMA,
    "clusters": CLUSTER_SCHEMA,
    "incidents": INCIDENT_SCHEMA,
    "correlations": CORRELATION_SCHEMA,
    "explanations": EXPLANATION_SCHEMA,
    "grams": GRAM_SCHEMA,
    "states": STATE_SCHEMA,
}
#: Incidents per block, by rank; a block is a folder of its own.
BLOCK = 65_536
#: What a commit names: the row of each run, the folder of its tables, and those of its
#: explanations.
MANIFEST_SCHEMA = f"{RUN_SCHEMA}, folder string, explained array<string>"


@dataclass(frozen=True)
class Run:
    """The tables of one run; all are empty if there is no such run."""

    run: DataFrame
    clusters: DataFrame
    incidents: DataFrame
    correlations: DataFrame
    explanations: DataFrame
    previous: DataFrame
    grams: DataFrame  # trigrams of the searched texts and the blocks of incidents they occur in
    states: DataFrame  # events by level, severity of the incident (null: none) and filled bucket


def _bucket_ts(index: Column) -> Column:
    start = F.unix_micros("bucket_start")
    return F.timestamp_micros(start + index * F.col("bucket_seconds") * 1_000_000)


def bucket_list(clusters: DataFrame) -> DataFrame:
    """Every bucket of a series, empty ones too, as ``buckets``: an array of (bucket_ts, count)."""
    stamped = F.transform(
        dense(F.col("filled"), F.col("n_buckets")),
        lambda n, i: F.struct(_bucket_ts(i).alias("bucket_ts"), n.alias("count")),
    )
    return clusters.withColumn("buckets", stamped)


def bucket_rows(clusters: DataFrame, *keys: str) -> DataFrame:
    """Every bucket of every series, one row each, empty ones too."""
    counts = dense(F.col("filled"), F.col("n_buckets"))
    return clusters.select(
        *keys, "bucket_start", "bucket_seconds", F.posexplode(counts).alias("bucket_idx", "events")
    ).select(*keys, "bucket_idx", _bucket_ts(F.col("bucket_idx")).alias("bucket_ts"), "events")


def filled_rows(clusters: DataFrame, *keys: str) -> DataFrame:
    """The buckets in which something happened, one row each."""
    return clusters.select(*keys, F.inline("filled"))


def bucket_states(clusters: DataFrame, incidents: DataFrame) -> DataFrame:
    """Events by level of the cluster, severity of its incident and filled bucket: what pages
    over time add up, in rows that don't grow with the clusters."""
    severities = incidents.select("cluster_id", F.col("severity").alias("incident_severity"))
    shared = ("n_buckets", "bucket_start", "bucket_seconds")
    return (
        filled_rows(
            clusters.drop("severity").join(severities, "cluster_id", "left"), "level", "incident_severity", *shared
        )
        .groupBy("level", F.col("incident_severity").alias("severity"), "bucket_idx", *shared)
        .agg(F.sum("events").alias("events"))
    )


def run_buckets(series: DataFrame) -> DataFrame:
    """``(bucket_idx, bucket_ts)``: the buckets all series of a run share; none without series."""
    shared = series.agg(*[F.max(c).alias(c) for c in ("n_buckets", "bucket_start", "bucket_seconds")])
    places = F.sequence(F.lit(0), F.col("n_buckets") - 1)
    return shared.select(
        F.explode(places).alias("bucket_idx"), "bucket_start", "bucket_seconds"
    ).select("bucket_idx", _bucket_ts(F.col("bucket_idx")).alias("bucket_ts"))


class RunExists(Exception):
    """The id is taken."""

    def __init__(self, run_id: int):
        super().__init__(f"[PATH_ALREADY_EXISTS] run {run_id} is stored, or being stored")


class RunStore:
    """Runs under one folder.

    A run's tables are staged in folders of their own; the run exists once a commit's
    manifest has its row. An id is claimed by a file that can be made only once, so two
    writers never get the same one; commits are numbered and optimistic, so writers at the same time
    both get theirs in, one after the other. Runs are read by the paths the manifest
    names. What no commit names is left behind by failed or replaced writes and never read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self.files = Files(spark, path)
        self.commits = Commits(self.files)

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> RunStore:
        return cls(spark, path)

    # --- commits

    def _manifest(self, named: str | None) -> DataFrame:
        if named is None:
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.path}/manifests/{named}")

    def manifest(self) -> DataFrame:
        """One row per run, as of now."""
        return self._manifest(self.commits.newest()[1])

    def _commit(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """Puts a changed manifest in place; if another writer was faster, on top of theirs."""
        while True:
            number, named = self.commits.newest()
            name = uuid.uuid4().hex
            changed = change(self._manifest(named)).coalesce(1)
            changed.write.parquet(f"{self.path}/manifests/{name}")
            if self.commits.add(number + 1, name):
                return

    def _claim(self, run_id: int | None, replace: bool) -> int:
        wanted = run_id or self.next_id()
        while not self.files.publish(f"claims/{wanted}", ""):
            if run_id is None:
                wanted += 1
            elif replace:
                break
            else:
                raise RunExists(run_id)
        return wanted

    # --- tables

    def _folder(self, name: str, run_id: int, folder: str) -> str:
        return f"{self.path}/{name}/run_id={run_id}/folder={folder}"

    def _read(self, name: str, found: list[tuple[int, str]]) -> DataFrame:
        """The tables in the given folders of runs; listed are these folders alone."""
        if not found:
            return self.spark.createDataFrame([], SCHEMAS[name])
        paths = [self._folder(name, run_id, folder) for run_id, folder in found]
        schema = f"{SCHEMAS[name]}, folder string"
        read = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths)
        return read.drop("folder")

    def table(self, name: str) -> DataFrame:
        """A table over all runs."""
        if name == "runs":
            return self.manifest().drop("folder", "explained")
        # one row per run
        runs = self.manifest().select("run_id", "folder", "explained").collect()
        if name == "explanations":
            return self._read(name, [(r.run_id, f) for r in runs for f in r.explained])
        return self._read(name, [(r.run_id, r.folder) for r in runs])

    def _stage(self, name: str, df: DataFrame, run_id: int, folder: str, by: tuple[str, ...] = ()) -> None:
        columns = [f.name for f in self._read(name, []).schema if f.name != "run_id"]
        df.select(*columns).write.partitionBy(*by).parquet(self._folder(name, run_id, folder))

    def next_id(self) -> int:
        return (self.manifest().agg(F.max("run_id")).first()[0] or 0) + 1

    def save(
        self,
        analysis: Analysis,
        source_name: str,
        created_at: datetime | str,
        run_id: int | None = None,
        replace: bool = False,
    ) -> int:
        """Stores an analysis, by default under the next free id. An id that is taken is an
        error unless ``replace`` is set; until the new run is whole, the old one stays."""
        run_id = self._claim(run_id, replace)
        folder = uuid.uuid4().hex
        self._stage("clusters", analysis.clusters, run_id, folder)
        blocks = analysis.incidents.withColumn("block", F.floor(F.col("rank") / BLOCK))
        self._stage("incidents", blocks, run_id, folder, ("block",))
        self._stage("grams", gram_rows(blocks), run_id, folder)
        self._stage("states", bucket_states(analysis.clusters, analysis.incidents), run_id, folder)
        self._stage("correlations", analysis.correlations, run_id, folder)
        clusters = analysis.clusters.agg(F.count("*")).scalar()
        counts = analysis.counts.select(F.struct("*")).scalar()
        run = analysis.window.select(
            F.lit(run_id).cast("bigint").alias("run_id"),
            F.lit(source_name).alias("source_name"),
            counts["event_count"].alias("event_count"),
            counts["parsed_count"].alias("parsed_count"),
            counts["unparsed_count"].alias("unparsed_count"),
            clusters.alias("cluster_count"),
            analysis.incidents.agg(F.count("*")).scalar().alias("incident_count"),
            "window_start",
            "window_end",
            F.when(clusters > 0, F.col("bucket_seconds"))
            .otherwise(fixed.DEFAULT_BUCKET_SECONDS)
            .alias("bucket_seconds"),
            F.lit(analysis.sensitivity).alias("sensitivity"),
            F.lit(created_at).cast("timestamp").alias("created_at"),
            F.lit(folder).alias("folder"),
            F.array().cast("array<string>").alias("explained"),
        )
        # one row
        row = self.spark.createDataFrame(run.collect(), MANIFEST_SCHEMA)
        self._commit(lambda runs: runs.filter(F.col("run_id") != run_id).unionByName(row))
        return run_id

    def save_explanations(self, run_id: int, explanations: DataFrame) -> None:
        """Adds explanations of some incidents; those saved later count."""
        folder = uuid.uuid4().hex
        stamped = explanations.withColumn("saved", F.unix_micros(F.current_timestamp()))
        self._stage("explanations", stamped, run_id, folder)
        added = F.when(F.col("run_id") == run_id, F.array_append("explained", F.lit(folder)))
        self._commit(lambda runs: runs.withColumn("explained", added.otherwise(F.col("explained"))))

    def latest_id(self) -> int | None:
        newest = latest_run(self.table("runs")).select("run_id").first()
        return newest[0] if newest else None

    def load(self, run_id: int | None = None) -> Run:
        """One run, the latest by default. Only the folders of that run are read."""
        runs = self.manifest()
        if run_id is None:
            newest_row = latest_run(runs).select("run_id").first()
            run_id = newest_row[0] if newest_row else 0
        row = runs.filter(F.col("run_id") == run_id).first()
        folders = [(run_id, row.folder)] if row else []

        def part(name: str, found: list[tuple[int, str]]) -> DataFrame:
            return self._read(name, found).filter(F.col("run_id") == run_id)

        runs = runs.drop("folder", "explained")
        return Run(
            runs.filter(F.col("run_id") == run_id),
            part("clusters", folders),
            part("incidents", folders),
            part("correlations", folders),
            newest(part("explanations", [(run_id, f) for f in row.explained] if row else [])),
            previous_run(runs, run_id),
            part("grams", folders),
            part("states", folders),
        )


def newest(explanations: DataFrame) -> DataFrame:
    """The explanation of each incident that was saved last."""
    told = [c for c in explanations.columns if c not in ("run_id", "incident_id", "saved")]
    return (
        explanations.groupBy("run_id", "incident_id")
        .agg(F.max_by(F.struct(*told), "saved").alias("told"), F.max("saved").alias("saved"))
        .select("run_id", "incident_id", "told.*", "saved")
    )


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(1)


def previous_run(runs: DataFrame, run_id: int) -> DataFrame:
    return runs.filter(F.col("run_id") < run_id).orderBy(F.desc("run_id")).limit(1)


def run_history(runs: DataFrame) -> DataFrame:
    """Every run with the id and size of the run before it."""
    before = F.struct("run_id", "event_count")
    return (
        with_previous(runs, "run_id", "_before", before)
        .withColumn("previous_id", F.col("_before.run_id"))
        .withColumn("previous_event_count", F.col("_before.event_count"))
        .drop("_before")
    )
