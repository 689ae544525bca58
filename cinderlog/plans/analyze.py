"""From raw lines to a finished analysis."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.masks import normalize
from ..operators import anomaly, correlation, frequency, incidents, mining, numbering, severity, templates
from ..operators.parse import parse_lines, synthetic_clock
from ..session import Workspace

# Sample lines are fetched by broadcasting their line numbers up to this many rows,
# by a shuffle join beyond it.
BROADCAST_LINES = 2_000_000
# They are looked for in up to this many ranges of line numbers, cut at gaps of at least one
# Parquet page.
SAMPLE_RANGES, PAGE_ROWS = 128, 20_000


@dataclass(frozen=True)
class Lines:
    """Parsed lines in two tables: the texts as parsed, written once, and what is counted. Lines
    are numbered, counted and joined by the second; the texts do not move with them."""

    texts: DataFrame  # line_no, raw, ts (null without a time), level, service, message, masked
    marks: DataFrame  # line_no, sequence (its digest), worded, ts, level, service
    base_time: str
    timed: bool  # all lines have a time

    def events(self) -> DataFrame:
        return self.texts if self.timed else synthetic_clock(self.texts, self.base_time)


@dataclass(frozen=True)
class Analysis:
    """Tables of one run. All are written tables, so using one does not recompute it, but for
    ``events`` where lines have no time."""

    lines: Lines
    sequences: DataFrame  # sequence, first_line, events, leaf, founds, alone, tokens
    versions: DataFrame  # leaf, created, from_line, tokens
    steps: DataFrame  # sequence (its digest), from_line, to_line, created
    window: DataFrame  # one row
    clusters: DataFrame
    incidents: DataFrame
    correlations: DataFrame
    counts: DataFrame  # one row
    sensitivity: float = fixed.DEFAULT_SENSITIVITY

    @property
    def events(self) -> DataFrame:
        """``line_no, raw, ts, level, service, message, masked``."""
        return self.lines.events()

    def event_clusters(self) -> DataFrame:
        """Every event with the template it belongs to."""
        return mining.assign_events(self.events, self.sequences, self.steps)


def read_lines(workspace: Workspace, lines: DataFrame, base_time: datetime | str) -> Lines:
    """Parse and mask every line once. Later passes read only the columns they need."""
    raw, message, masked = (F.col(name) for name in ("raw", "message", "masked"))
    parsed = parse_lines(lines).withColumn("masked", normalize(message))
    texts = workspace.compact(parsed, "parsed", {"message": raw, "masked": message})
    marks = texts.select(
        "line_no",
        mining.digest(mining.sequence_text(masked)).alias("sequence"),
        (masked != "").alias("worded"),
        "ts",
        "level",
        "service",
    )
    timed = texts.filter("ts IS NULL").isEmpty()
    if not timed:
        marks = synthetic_clock(marks, base_time)
    return Lines(texts, workspace.table(marks, "marks"), str(base_time), timed)


@dataclass(frozen=True)
class _Steps:
    """Steps of the texts that stay with one template, and of those that change it (None if
    there are none, which is the rule)."""

    staying: DataFrame
    moving: DataFrame | None

    @classmethod
    def of(cls, workspace: Workspace, steps: DataFrame) -> _Steps:
        moved = steps.filter(F.col("to_line").isNotNull()).select("sequence").distinct()
        # written, so that its size is known: it is small, or its texts are few of all
        moving = workspace.table(steps.join(moved, "sequence", "left_semi"), "moving")
        gone = moving.select("sequence").distinct()
        staying = steps.join(gone, "sequence", "left_anti").select("sequence", "created")
        return cls(staying, None if moving.isEmpty() else moving)

    def moved_events(self, marks: DataFrame) -> DataFrame:
        """Marks of moving texts with ``created``, the template at their line."""
        found = marks.join(self.moving, "sequence").filter(mining.at_line())
        return found.drop("from_line", "to_line")


def _facts(
    workspace: Workspace, marks: DataFrame, steps: _Steps, view: frequency.Window
) -> DataFrame:
    """Events counted by template, level, service and bucket.

    Most texts stay with one template, so events are counted per text on the map side and
    only the counts are joined. Texts that change their template are split by line first.
    """
    named = marks.select(
        "sequence",
        "line_no",
        F.when(F.col("worded"), F.col("line_no")).alias("worded_line"),
        "ts",
        "level",
        "service",
        frequency.bucket_index(F.col("ts"), view).alias("bucket_idx"),
    )
    keys = ["sequence", "level", "service", "bucket_idx"]
    worded = F.min("worded_line").alias("worded_line")
    facts = templates.event_facts(named, keys, worded).join(steps.staying, "sequence")
    if steps.moving is not None:
        moved = steps.moved_events(named)
        facts = facts.unionByName(templates.event_facts(moved, [*keys, "created"], worded))
    # the texts' digests have done their work
    return workspace.table(facts.drop("sequence"), "facts")


def _sample_lines(
    workspace: Workspace, marks: DataFrame, steps: _Steps, facts: DataFrame
) -> DataFrame:
    """``(created, line_no, lone, places)``: the lines whose texts a template shows. ``places`` has
    those among the first lines, and is empty for lines wanted for another reason: the first
    message that is not empty, and the founding line. ``lone`` templates show that line only."""
    named = marks.select("sequence", "line_no")
    first = templates.first_lines(named, "sequence").join(steps.staying, "sequence")
    first = first.select("created", "line_no")
    if steps.moving is not None:
        first = first.unionByName(steps.moved_events(named).select("created", "line_no"))
    first = templates.first_lines(first, "created")
    # A template can begin with empty messages; its example is the first other one.
    others = facts.groupBy("created").agg(F.min("worded_line").alias("worded_line"))
    others = others.select("created", F.explode(F.array("worded_line", "created")).alias("line_no"))
    others = others.filter(F.col("line_no").isNotNull()).withColumn("place", F.lit(None).cast("int"))
    chosen = first.select("created", "line_no", "place").unionByName(others)
    chosen = chosen.groupBy("created").agg(
        F.collect_set("line_no").alias("_at"),
        F.collect_list(F.when(F.col("place").isNotNull(), F.struct("line_no", "place"))).alias("_placed"),
    )
    own = F.filter("_placed", lambda line: line["line_no"] == F.col("line_no"))
    return workspace.table(
        chosen.withColumn("lone", F.size("_at") == 1)
        .withColumn("line_no", F.explode("_at"))
        .select("created", "line_no", "lone", F.transform(own, lambda line: line["place"]).alias("places")),
        "sample-lines",
    )


def _with_samples(clusters: DataFrame, lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds ``example, examples, founding``: the first message that is not empty, the first
    raw lines, and the masked texts of the founding line with their digests. Lines are chosen by
    number alone; texts are fetched for the chosen ones, once each, from the parts of the files
    that hold any, and messages and masked texts only where they are not the raw line."""
    # Row groups and pages outside the ranges, which most are, keep their wide columns unread.
    ranges = numbering.spans(chosen, "line_no", SAMPLE_RANGES, PAGE_ROWS)
    raw, message, masked = (F.col(name) for name in ("raw", "message", "masked"))
    texts = lines.filter(numbering.within("line_no", ranges)).select(
        "line_no",
        "raw",
        F.when(~message.eqNullSafe(raw), F.struct("message")).alias("message"),
        F.when(~masked.eqNullSafe(message), F.struct("masked")).alias("masked"),
    )
    shown = F.collect_list(F.struct("line_no", "places", "raw", "message", "masked")).alias("_lines")
    if chosen.count() <= BROADCAST_LINES:
        found = texts.join(F.broadcast(chosen), "line_no").groupBy("created").agg(shown)
        return clusters.join(_told(found), "created")
    # The texts of lone templates, most where there are this many, are where their number takes them.
    found = numbering.join_narrow(texts, chosen, "line_no")
    lone = found.filter("lone").groupBy("line_no").agg(shown).withColumnRenamed("line_no", "created")
    several = found.filter("NOT lone").groupBy("created").agg(shown)
    return clusters.join(_told(lone), "created").unionByName(clusters.join(_told(several), "created"))


def _told(fetched: DataFrame) -> DataFrame:
    """``(created, example, examples, founding)`` from the lines of each template."""

    def message_of(line: Column) -> Column:
        return F.when(line["message"].isNull(), line["raw"]).otherwise(line["message"]["message"])

    def masked_of(line: Column) -> Column:
        return F.when(line["masked"].isNull(), message_of(line)).otherwise(line["masked"]["masked"])

    def placed(line: Column) -> Column:
        return F.transform(line["places"], lambda place: F.struct(place.alias("place"), line["raw"].alias("raw")))

    def named(line: Column) -> Column:
        text = mining.sequence_text(masked_of(line))
        return F.struct(mining.digest(text).alias("sequence"), text.alias("text"))

    worded = F.transform(
        F.filter("_lines", lambda line: message_of(line) != ""),
        lambda line: F.struct(line["line_no"].alias("line_no"), message_of(line).alias("message")),
    )
    founding = F.filter("_lines", lambda line: line["line_no"] == F.col("created"))
    raw_lines = F.array_sort(F.flatten(F.transform("_lines", placed)))
    return fetched.select(
        "created",
        F.coalesce(F.array_min(worded)["message"], F.lit("")).alias("example"),
        F.transform(raw_lines, lambda line: line["raw"]).alias("examples"),
        F.transform(founding, named).alias("founding"),
    )


def _names(versions: DataFrame) -> DataFrame:
    """``(leaf, created, sequence, changed)``: the digest of the text that founded a template, and
    the template as text if it has changed since, which few have."""
    founds = F.col("from_line") == F.col("created")
    text = mining.pattern(F.col("tokens"))
    told = versions.select(
        "leaf",
        "created",
        "from_line",
        F.when(founds, mining.digest(text)).alias("sequence"),
        F.when(~founds, text).alias("changed"),
    )
    latest = F.max_by("changed", F.when(F.col("changed").isNotNull(), F.col("from_line")))
    # dealt by what they are joined by; few rows share a template, so there is little to add up first
    told = told.repartition("created")
    return told.groupBy("leaf", "created").agg(F.max("sequence").alias("sequence"), latest.alias("changed"))


def analyze(
    workspace: Workspace,
    lines: DataFrame,
    base_time: datetime | str,
    sensitivity: float = fixed.DEFAULT_SENSITIVITY,
    sim_threshold: float = fixed.SIM_THRESHOLD,
    max_depth: int = fixed.MAX_DEPTH,
    max_children: int = fixed.MAX_CHILDREN,
    dependencies: DataFrame | None = None,
    criticality: Mapping[str, float] = fixed.SERVICE_CRITICALITY,
) -> Analysis:
    """Parse, mine, count, score, promote and link the lines ``(line_no, raw)``.

    ``base_time`` starts the clock of lines without a time; ``criticality`` weighs the
    services, ``dependencies`` replaces the table of links between them. The raw lines are read once
    and their texts written once; they are moved to be mined, and for the samples. All else is
    counted and joined by line numbers and digests.
    """
    spark = workspace.spark
    read = read_lines(workspace, lines, base_time)
    moments = read.marks.select(F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"))
    window = workspace.table(frequency.analysis_window(moments, str(base_time)), "window")
    routed = mining.routed_lines(workspace, read.texts, max_depth, max_children)
    versions = mining.mine(workspace, routed, sim_threshold)
    steps = workspace.table(mining.sequence_steps(mining.by_digest(routed), versions), "steps")

    view = frequency.Window.known(window)
    parted = _Steps.of(workspace, steps)
    facts = _facts(workspace, read.marks, parted, view)
    chosen = _sample_lines(workspace, read.marks, parted, facts)
    mined = (
        templates.totals(facts, "created")
        .join(templates.services(facts, "created"), "created", "left")
        .join(frequency.sparse_counts(facts, "created", view), "created")
        .join(_names(versions), "created")
        .drop("leaf")
        .withColumn(
            "services", F.coalesce("services", F.create_map().cast("map<string,bigint>"))
        )
        .withColumn("bucket_start", view.start)
        .withColumn("bucket_seconds", view.seconds)
    )
    base = workspace.table(templates.to_clusters(mined), "templates")
    numbered = templates.number_templates(base)
    scored = anomaly.score(frequency.growth(numbered), sensitivity)
    scored = severity.score(scored, base.agg(F.max("count")).scalar(), criticality)
    founding = F.filter("founding", lambda text: text["sequence"] == F.col("sequence"))
    template = F.coalesce("changed", F.get(founding, F.lit(0))["text"])
    shown = (
        _with_samples(scored, read.texts, chosen)
        .withColumn("template", template)
        .drop("founding", "sequence", "changed")
    )
    like = {"example": F.get("examples", F.lit(0)), "template": F.col("example")}
    clusters = workspace.compact(shown, "clusters", like)
    clusters = clusters.withColumn("tokens", F.split("template", " ", -1))
    clusters = clusters.withColumn("token_count", F.size("tokens"))
    ranked = workspace.table(incidents.form(workspace, clusters), "incidents")
    edges = workspace.table(
        correlation.correlate(ranked, dependencies or correlation.dependency_table(spark)),
        "correlations",
    )
    linked = workspace.table(correlation.with_correlated_ids(ranked, edges), "linked")
    counts = read.marks.agg(
        F.count("*").alias("event_count"),
        F.count_if(F.col("level") != fixed.UNKNOWN_LEVEL).alias("parsed_count"),
    ).withColumn("unparsed_count", F.col("event_count") - F.col("parsed_count"))
    return Analysis(
        read, routed, versions, steps, window, clusters, linked, edges, counts, sensitivity
    )
