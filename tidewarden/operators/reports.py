"""Reports over alerts: noisy-OR, summaries, statistics, rankings, quality of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import severity


def noisy_or(alerts: DataFrame, keys: list[str], per: str = "alert") -> DataFrame:
    """``keys, combined``: one minus the product of what each risk leaves.

    ``per`` "alert" takes every alert, each risk at most 0.999; "class" takes the
    largest risk of each class, so repeats of a class add nothing.
    """
    if per == "class":
        worst = alerts.groupBy(*keys, "threat_class").agg(F.max("risk_score").alias("r"))
        return worst.groupBy(*keys).agg((F.lit(1.0) - F.product(F.lit(1.0) - F.least(F.col("r") / 100.0, F.lit(1.0)))).alias("combined"))
    r = F.greatest(F.lit(0.0), F.least(F.col("risk_score") / 100.0, F.lit(0.999)))
    return alerts.groupBy(*keys).agg((F.lit(1.0) - F.product(F.lit(1.0) - r)).alias("combined"))


def incident_summary(alerts: DataFrame) -> DataFrame:
    """One row per incident: entity, count, combined risk and level, times, sorted classes."""
    r = F.least(F.col("risk_score") / 100.0, F.lit(0.999))
    grouped = alerts.where("incident_id is not null").groupBy("incident_id").agg(
        F.min_by("entity", F.struct("event_time", "alert_id")).alias("src_ip"), F.count("*").alias("alert_count"),
        (F.lit(1.0) - F.product(F.lit(1.0) - r)).alias("_c"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"),
        F.array_sort(F.collect_set("threat_class")).alias("threat_classes"),
    )
    risk = F.bround(F.col("_c") * 100.0, 0).cast("long")
    return grouped.withColumn("combined_risk", risk).withColumn("risk_level", severity(F.col("combined_risk"))).drop("_c")


def incident_cluster(alerts: DataFrame) -> DataFrame:
    """The dashboard's variant: first source, count, peak risk, joined classes, times; alerts without incident are dropped."""
    valid = alerts.where("incident_id is not null and incident_id not in ('', 'None')")
    return valid.groupBy("incident_id").agg(
        F.min_by("src_ip", F.struct("event_time", "alert_id")).alias("src_ip"), F.count("*").alias("events"), F.max("risk_score").alias("peak_risk"),
        F.concat_ws(", ", F.array_sort(F.collect_set("threat_class"))).alias("vectors"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"),
    )


def alert_stats(alerts: DataFrame) -> DataFrame:
    """One row: total, counts by level and by class as maps, distinct sources and targets, first and last time.

    One pass over ``alerts``: every key is a grouping set of one aggregation.
    """
    keys = ("severity", "threat_class", "src_ip", "dst_ip")
    each = alerts.groupingSets([*[[k] for k in keys], []], *keys).agg(
        F.count("*").alias("n"), F.min("event_time").alias("first"), F.max("event_time").alias("last"), F.grouping_id().alias("set")
    )
    of = {k: (F.col("set") == 15 - (8 >> i)) & F.col(k).isNotNull() for i, k in enumerate(keys)}
    by = lambda key: F.map_from_entries(F.array_sort(F.collect_list(F.when(of[key], F.struct(key, "n"))))).alias(f"by_{key}")
    return each.agg(
        F.coalesce(F.max(F.when(F.col("set") == 15, F.col("n"))), F.lit(0)).alias("total_alerts"), F.count_if(of["src_ip"]).alias("unique_source_ips"),
        F.count_if(of["dst_ip"]).alias("unique_dest_ips"), F.min("first").alias("start_time"), F.max("last").alias("end_time"), by("severity"), by("threat_class"),
    )


def risk_histogram(alerts: DataFrame, bins: int = 20) -> DataFrame:
    """``bin, low, high, count``: fixed-width bins over 0 to 100, the last closed."""
    width = 100.0 / bins
    index = F.least(F.floor(F.col("risk_score") / width), F.lit(bins - 1)).cast("int")
    return alerts.groupBy(index.alias("bin")).agg(F.count("*").alias("count")).withColumns({"low": F.col("bin") * width, "high": (F.col("bin") + 1) * width})


def class_distribution(alerts: DataFrame) -> DataFrame:
    counts = alerts.groupBy("threat_class").agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))  # a row per class


def nearest_rank_percentiles(rows: DataFrame, value: str, keys: list[str] = [], ranks: tuple[int, ...] = (50, 95, 99)) -> DataFrame:  # noqa: B006
    """The values at rank ``ceil(q n / 100)``, not interpolated, and the largest; 0 where there is none.

    Computed from counts per value, so a group's rows are never sorted together.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy(value)
    placed = counts.withColumn("_upto", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    at = [F.min(F.when(F.col("_upto") >= F.greatest(F.ceil(F.col("_n") * q / 100), F.lit(1)), F.col(value))).alias(f"p{q}") for q in ranks]
    out = placed.groupBy(*keys).agg(*at, F.max(value).alias("max"))
    return out if keys else out.fillna(0)


def throughput(events: DataFrame, bucket_s: int) -> DataFrame:
    """``bucket, events, per_second`` over buckets of the events' time."""
    return events.groupBy(F.floor(F.col("ts") / bucket_s).cast("long").alias("bucket")).agg(F.count("*").alias("events")).withColumn("per_second", F.col("events") / float(bucket_s))


def pipeline_counters(**parts: DataFrame) -> DataFrame:
    """``counter, value``: how many rows each named split holds."""
    out = None
    for name, part in parts.items():
        row = part.agg(F.count("*").alias("value")).select(F.lit(name).alias("counter"), "value")
        out = row if out is None else out.union(row)
    return out


def filter_alerts(alerts: DataFrame, classes: list[str] | None = None, levels: list[str] | None = None, ip: str | None = None) -> DataFrame:
    """Alerts of any of the classes and levels whose source or target contains ``ip``."""
    if classes:
        alerts = alerts.where(F.col("threat_class").isin(*classes))
    if levels:
        alerts = alerts.where(F.col("severity").isin(*levels))
    if ip:
        alerts = alerts.where(F.coalesce(F.col("src_ip").contains(ip), F.lit(False)) | F.coalesce(F.col("dst_ip").contains(ip), F.lit(False)))
    return alerts


def format_evidence(evidence: Column) -> Column:
    """Evidence as JSON text: a map's reason, or a list's items joined, at most 120 characters."""
    items = F.from_json(evidence, "array<string>")
    listed = F.when(F.trim(evidence).startswith("["), F.concat_ws("; ", items))
    given = F.nullif(F.get_json_object(evidence, "$.reason"), F.lit(""))
    return F.coalesce(given, F.substring(F.coalesce(listed, evidence), 1, 120), F.lit(""))


def format_alerts(alerts: DataFrame) -> DataFrame:
    """Confidence with two places, times of 19 characters, evidence as short text."""
    return alerts.withColumns({
        "confidence": F.coalesce(F.format_string("%.2f", "confidence"), F.lit("")), "timestamp": F.coalesce(F.substring("timestamp", 1, 19), F.lit("")),
        "evidence": format_evidence(F.col("evidence")),
    })


def recent_alerts(alerts: DataFrame, n: int = 200) -> DataFrame:
    """The ``n`` newest alerts; ties go by id."""
    return alerts.orderBy(F.desc("event_time"), "alert_id").limit(n)


def top_incidents(incidents: DataFrame, k: int, by: str = "combined_risk") -> DataFrame:
    return incidents.orderBy(F.desc(by), "incident_id").limit(k)


def alerts_chronological(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy("event_time", "alert_id")


def confusion_matrix(rows: DataFrame, label: str, prediction: str, classes: list) -> DataFrame:
    """A row per label with the count of each prediction."""
    return rows.groupBy(label).pivot(prediction, classes).agg(F.count(F.lit(1))).fillna(0)


def classification_report(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """``class, precision, recall, f1, support`` per class and for macro and weighted means and accuracy; 0/0 is 0."""
    text = rows.select(F.col(label).cast("string").alias("l"), F.col(prediction).cast("string").alias("p"))
    pairs = text.groupBy("l", "p").agg(F.count("*").alias("n"))
    actual = pairs.groupBy(F.col("l").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    said = pairs.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("said"))
    both = actual.join(said, "class", "full").fillna(0)
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    per = both.select("class", ratio(F.col("hit"), F.col("said")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), "support", "hit")
    per = per.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))
    measures = ("precision", "recall", "f1")
    macro = per.agg(F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("class"), *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in measures], F.sum("support").alias("support"))
    share = F.sum("hit") / F.sum("support")
    accuracy = per.agg(F.lit("accuracy").alias("class"), *[share.alias(m) for m in measures], F.sum("support").alias("support"))
    return per.select("class", *measures, "support").unionByName(macro).unionByName(weighted).unionByName(accuracy)


def roc_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row ``auc``: the rank sum of positives, ties averaged; 0 with a single class.

    Counts per score come first.  Distinct scores are cut at 63 approximate quantiles; each
    range is added up by itself and starts at the sum of the ranges before it, so no task
    holds all scores.
    """
    per = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))
    cuts = per.agg(F.percentile_approx("s", F.array(*[F.lit(k / 64) for k in range(1, 64)]), F.lit(1000)).alias("cuts"))  # one row
    per = per.join(F.broadcast(cuts), F.lit(True)).withColumn("range", F.size(F.filter("cuts", lambda c: c <= F.col("s")))).drop("cuts")
    ranges = per.groupBy("range").agg(F.sum("n").alias("m"))
    before = ranges.select("range", (F.sum("m").over(Window.orderBy("range")) - F.col("m")).alias("before"))  # 64 rows at most
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("range").orderBy("s"))
    ranked = per.join(F.broadcast(before), "range").withColumn("rank", upto - (F.col("n") - 1) / 2.0)
    sums = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    auc = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / F.nullif(F.col("p") * F.col("q"), F.lit(0))
    return sums.select(F.coalesce(auc, F.lit(0.0)).alias("auc"))
