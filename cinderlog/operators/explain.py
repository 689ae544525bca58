"""Explanations from the engine's own results, for all incidents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import jsonline
from ..functions.display import decimals, signed
from ..sources.runs import Run
from .explorer import chain

EXPLANATION_COLUMNS = ("incident_id", "source", "summary", "root_cause", "suggested_fixes")


def linked_ids(run: Run) -> DataFrame:
    """``upstream`` and ``downstream`` ids of every linked incident, in edge order."""

    def ids(direction: str) -> Column:
        place = F.struct("stage", "order_a", "order_b", "other_id")
        found = F.array_sort(F.collect_list(F.when(F.col("direction") == direction, place)))
        return F.transform(found, lambda edge: edge["other_id"]).alias(direction)

    return chain(run).groupBy("incident_id").agg(ids("upstream"), ids("downstream"))


def explain_input(run: Run) -> DataFrame:
    """Everything an explanation may use, one row per incident."""
    clusters = run.clusters.select(
        "cluster_id", "zscore", "baseline_rate", "level", "template", "example"
    )
    none = F.array().cast("array<string>")
    return (
        run.incidents.select(
            "incident_id", "rank", "cluster_id", "title", "service", "severity", "status",
            "confidence", "anomaly_score", "growth_pct", "count",
        )
        .join(clusters, "cluster_id", "left")
        .join(linked_ids(run), "incident_id", "left")
        .withColumn("template", F.coalesce("template", "title"))
        .withColumn("upstream", F.coalesce("upstream", none))
        .withColumn("downstream", F.coalesce("downstream", none))
        .na.fill({"zscore": 0.0, "baseline_rate": 0.0, "level": fixed.UNKNOWN_LEVEL, "example": ""})
    )


def rule_number(text: Column, rules=fixed.ROOT_CAUSE_RULES) -> Column:
    """Index of the first rule one of whose words occurs in the text; null if none."""
    number = F.lit(None).cast("int")
    for index, (words, _, _) in reversed(list(enumerate(rules))):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(text, F.lit(word))
        number = F.when(hit, index).otherwise(number)
    return number


def root_cause(inputs: DataFrame, rules=fixed.ROOT_CAUSE_RULES) -> DataFrame:
    """Adds ``rule``, ``cause`` and ``suggested_fixes``."""
    text = F.lower(F.concat_ws(" ", "template", "example", "title"))
    causes = F.array(*[F.lit(cause) for _, cause, _ in rules])
    fixes = F.array(*[F.array(*[F.lit(fix) for fix in fixes]) for _, _, fixes in rules])
    default = F.array(*[F.lit(fix) for fix in fixed.DEFAULT_FIXES])
    return (
        inputs.withColumn("rule", rule_number(text, rules))
        .withColumn("cause", F.coalesce(F.get(causes, F.col("rule")), F.lit(fixed.DEFAULT_CAUSE)))
        .withColumn("suggested_fixes", F.coalesce(F.get(fixes, F.col("rule")), default))
    )


def growth_phrase(growth_pct: Column, baseline_rate: Column) -> Column:
    return (
        F.when(baseline_rate < 1e-6, "an entirely new pattern with no prior baseline")
        .when(
            growth_pct >= 100,
            F.concat(F.lit("up "), decimals(growth_pct, 0), F.lit("% versus its baseline")),
        )
        .when(growth_pct <= -50, "now subsiding after an earlier spike")
        .otherwise(F.concat(signed(growth_pct), F.lit("% versus its baseline")))
    )


def _percent(share: Column) -> Column:
    return decimals(share * 100, 0)


def explain(inputs: DataFrame) -> DataFrame:
    """The deterministic explanation of every incident."""
    told = root_cause(inputs)
    up, down = F.col("upstream"), F.col("downstream")
    summary = F.concat(
        F.lit("The detection engine flagged "), "incident_id", F.lit(" on "),
        F.coalesce("service", F.lit("an unknown service")), F.lit(" as "), "severity",
        F.lit(" severity ("), _percent(F.col("confidence")), F.lit("% confidence). The '"),
        "template", F.lit("' cluster produced "), F.col("count").cast("string"),
        F.lit(" events at "), "level", F.lit(" level, "),
        growth_phrase(F.col("growth_pct"), F.col("baseline_rate")),
        F.lit(" (anomaly z-score "), decimals(F.col("zscore"), 1), F.lit(")."),
        F.when(
            F.size(down) > 0,
            F.concat(F.lit(" It appears to be propagating to "), F.array_join(down, ", "), F.lit(".")),
        ).otherwise(""),
    )
    cause = F.concat(
        F.when(
            F.size(up) > 0,
            F.concat(F.lit("This incident is downstream of "), F.array_join(up, ", "), F.lit(". ")),
        ).otherwise(""),
        F.col("cause"),
    )
    return told.select(
        "incident_id",
        F.lit(fixed.DETERMINISTIC_SOURCE).alias("source"),
        summary.alias("summary"),
        cause.alias("root_cause"),
        "suggested_fixes",
    )


def _list_text(ids: Column) -> Column:
    """A list as Python shows it, ``none`` if it is empty."""
    quoted = F.transform(ids, lambda i: F.concat(F.lit("'"), i, F.lit("'")))
    shown = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    return F.when(F.size(ids) > 0, shown).otherwise("none")


def prompt(inputs: DataFrame) -> DataFrame:
    """``(incident_id, prompt)``: the structured text for an outside model."""

    def line(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    lines = [
        line(
            "You are an SRE assistant. The detection ENGINE has already computed the "
            "analysis below. Do NOT re-detect or re-score. Only explain it clearly."
        ),
        line(""),
        line("Incident: ", F.col("incident_id")),
        line("Service: ", F.coalesce("service", F.lit("None"))),
        line("Severity: ", F.col("severity"), " (confidence ", _percent(F.col("confidence")), "%)"),
        line("Status: ", F.col("status")),
        line("Detected template: ", F.col("template")),
        line("Log level: ", F.col("level")),
        line("Event count: ", F.col("count").cast("string")),
        line(
            "Anomaly z-score: ", decimals(F.col("zscore"), 2), "; growth vs baseline: ",
            decimals(F.col("growth_pct"), 0), "%",
        ),
        line("Upstream causes: ", _list_text(F.col("upstream"))),
        line("Downstream impact: ", _list_text(F.col("downstream"))),
        line("Representative log: ", F.col("example")),
        line(""),
        line(
            "Respond as JSON with keys: summary (2-3 sentences), root_cause (1-2 sentences), "
            "suggested_fixes (array of 3 short imperative strings)."
        ),
    ]
    return inputs.select("incident_id", F.concat_ws("\n", *lines).alias("prompt"))


def merge_responses(explanations: DataFrame, responses: DataFrame) -> DataFrame:
    """Outside explanations ``(incident_id, response)`` over the deterministic ones.

    A response counts if it is a JSON object with all three fields; one fix may come as
    plain text, more than five are cut.
    """
    told = F.col("told")

    def value(key: str) -> Column:
        return F.try_element_at(told, F.lit(key))

    kind = jsonline.kind(value("suggested_fixes"))
    as_list = F.transform(
        value("suggested_fixes").try_cast("array<variant>"), jsonline.text_of
    )
    fixes = F.when(kind == "STRING", F.array(value("suggested_fixes").cast("string"))).when(
        F.startswith(kind, F.lit("ARRAY")), F.slice(as_list, 1, fixed.MAX_FIXES)
    )
    valid = (
        F.map_contains_key(told, "summary") & F.map_contains_key(told, "root_cause") & fixes.isNotNull()
    )
    outside = (
        responses.withColumn("told", jsonline.strict_object(F.col("response")))
        .filter(valid)
        .select(
            "incident_id",
            F.struct(
                F.lit(fixed.EXTERNAL_SOURCE).alias("source"),
                jsonline.text_of(value("summary")).alias("summary"),
                jsonline.text_of(value("root_cause")).alias("root_cause"),
                fixes.alias("suggested_fixes"),
            ).alias("outside"),
        )
    )
    own = F.struct("source", "summary", "root_cause", "suggested_fixes")
    return (
        explanations.join(outside, "incident_id", "left")
        .select("incident_id", F.coalesce("outside", own).alias("chosen"))
        .select("incident_id", "chosen.*")
    )
