"""Small texts for people, formatted on the driver from a few aggregated rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics


def read_grades(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, marks, verdict) of a grades JSON file, an object by item."""
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.explode(F.from_json("value", "map<string,struct<marks:map<string,boolean>,verdict:string>>")).alias("item_id", "g"))
    return items.select("item_id", "g.marks", "g.verdict")


def read_unblind(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """((item_id, strategy, bands, b, p, e), dataset name) of an unblinding JSON file."""
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("item_id", "json"))
    parsed = items.where("item_id <> '__dataset__'").select("item_id", F.from_json("json", "strategy string, bands string, denom struct<b:int,p:int,e:int>").alias("u"))
    bands = ~F.coalesce("u.bands", F.lit("")).isin("", "[]", "false", "null", "0", "{}")
    name = items.where("item_id = '__dataset__'").first()
    return parsed.select("item_id", "u.strategy", bands.alias("bands"), "u.denom.b", "u.denom.p", "u.denom.e"), name and name["json"].strip('"')


def trial_markdown(tally: DataFrame, dataset: str | None = None, protocol: str = "mark-failures-only") -> str:
    """One table row a strategy."""
    rows = sorted(tally.collect(), key=lambda r: r["strategy"])  # one a strategy
    rate = lambda x: "n/a" if x is None else f"{x:.2f}"
    counted = "what is not marked as failed passes" if protocol == "mark-failures-only" else "rates are means of the marks entered"
    head = ["strategy", "items", "boundary acceptance", "phase accuracy", "evidence accuracy", "failure-band rate", "usable / touch-up / garbage"]
    lines = [f"Dataset: **{dataset or '(fresh dataset)'}**. Protocol: **{protocol}** ({counted}).", f"Items graded: **{sum(r['n_items'] for r in rows)}**.", "", "| " + " | ".join(head) + " |", "|---" * len(head) + "|"]
    for r in rows:
        cells = [r["strategy"], str(r["n_items"])]
        cells += [f"{rate(r[v])} (n={r[n]})" for v, n in (("boundary_acceptance", "n_boundaries"), ("phase_accuracy", "n_phases"), ("evidence_factual_accuracy", "n_evidence"))]
        cells += [rate(r["failure_band_rate"]), f"{r['usable']} / {r['touchup']} / {r['garbage']}"]
        lines.append("| " + " | ".join(cells) + " |")
    return "\n".join(lines) + "\n"


def trial_report(spark: SparkSession, grades: str, unblind: str, protocol: str = "mark-failures-only") -> str:
    key, dataset = read_unblind(spark, unblind)
    return trial_markdown(metrics.trial_tally(read_grades(spark, grades), key, protocol), dataset, protocol)


def gate_text(flags: DataFrame, episodes: DataFrame, most: int = 200) -> tuple[bool, str]:
    """(passed, report): counts by check and the first flags in order; a report lists at most ``most`` of them."""
    counts = {r["check"]: r["n"] for r in flags.groupBy("check").agg(F.count("*").alias("n")).orderBy("check").collect()}
    n = episodes.select("episode_id").distinct().count()
    lines = [f"Gate over {n} episodes: {'passed' if not counts else f'{sum(counts.values())} flags'}"]
    lines += [f"  {c}: {k}" for c, k in counts.items()]
    lines += [f"  [{r['check']}] {r['episode_id']}: {r['detail']}" for r in flags.orderBy("check", "episode_id", "detail").limit(most).collect()]
    return not counts, "\n".join(lines)


def as_json(row) -> str:
    return json.dumps(row.asDict(recursive=True), indent=2, sort_keys=True, default=str)
