"""Queries of training, scoring, calibration, attribution and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import detectors, ml, reports, windows
from ..operators.joins import match_blocklist
from ..operators.normalize import flow_kinetics
from ..sources.flows import flows
from ..sources.paths import new_path
from .common import WIDE, blocklist, detections, round6, sql_detections, sql_flows
from .registry import query


def _dns(spark, d):
    """DNS rows with lexical features; generated names end in .net."""
    return ml.with_dns_features(flows(spark, d)).withColumn("target", F.col("dns_query").endswith(".net").cast("int"))


def _tls(spark, d):
    rows = ml.tls_features(flow_kinetics(flows(spark, d))).where("ja3 is not null")
    return match_blocklist(rows, blocklist(spark)).withColumn("target", F.col("blocklist_hit").cast("int")).drop("blocklist_hit")


def _dga_model(train):
    """The model of the operator's defaults: 200 trees of depth 6 in each of three folds."""
    return ml.train_dga(train, "target", "flow_id")


@query("m1_dga_classifier")
def m1(spark, d):
    train, test = ml.group_split(_dns(spark, d), "src_ip")
    return ml.probability_of(_dga_model(train), test, ml.DGA_FEATURES).select("flow_id", "target", "probability")


@query("d5_detect_dns_tunnel")
def d5(spark, d):
    rows = _dns(spark, d)
    scored = ml.probability_of(_dga_model(ml.group_split(rows, "src_ip")[0]), rows, ml.DGA_FEATURES)
    return detectors.detect_dns_tunnel(scored, WIDE).select("flow_id", "threat_class", "confidence", F.concat_ws("; ", "evidence").alias("evidence"))


@query("m2_tls_classifier")
def m2(spark, d):
    train, test = ml.group_split(_tls(spark, d), "src_ip")
    model = ml.train_tls(train, "target", "flow_id")
    scored = ml.probability_of(model, test, ml.TLS_FEATURES)
    return detectors.detect_tls(scored, ml.harvest_blocklist(train, "target"), WIDE, probability="probability").select("flow_id", "confidence")


FOREST, SAMPLE, SEED = 200, 256, 7
DEPTH = 8
MEAN_PATH = "CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} <= 2 THEN 1.0::DOUBLE ELSE 2 * (ln({n}::DOUBLE - 1) + 0.5772156649::DOUBLE) - 2 * ({n}::DOUBLE - 1) / {n} END"


def forest_sql(benign: str) -> str:
    """SQL that grows the forest itself, level by level from the same hashes, and scores all flows."""
    share = lambda *parts: f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    width = len(ml.ANOMALY_FEATURES)
    lists = lambda kind: f"[{', '.join(f'{kind}(x[{k}])' for k in range(1, width + 1))}]"
    parts = [f""", x AS (SELECT flow_id, [(pkts_out + pkts_in)::DOUBLE, (bytes_out + bytes_in)::DOUBLE, (bytes_out + bytes_in)::DOUBLE / greatest(1.0::DOUBLE, (pkts_out + pkts_in)::DOUBLE),
  bytes_out::DOUBLE / greatest(1.0::DOUBLE, bytes_in::DOUBLE), dur, (pkts_out + pkts_in)::DOUBLE / dur, (bytes_out + bytes_in)::DOUBLE / dur, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE] AS x,
  {benign} AS benign FROM (SELECT *, CASE WHEN duration IS NULL OR duration = 0 THEN 0.001::DOUBLE ELSE greatest(0.001::DOUBLE, duration) END AS dur FROM flows)),
dealt AS (SELECT t, flow_id, x, {share("'" + str(SEED) + "'", "t", "flow_id")} AS h FROM x, range({FOREST}) AS r(t) WHERE benign),
l0 AS MATERIALIZED (SELECT t, x, 1 AS node FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY h, flow_id) AS r FROM dealt
  WHERE h < least(1.0::DOUBLE, {1.3 * SAMPLE}::DOUBLE / greatest(1, (SELECT count(*) FROM x WHERE benign)))) WHERE r <= {SAMPLE})"""]
    for k in range(DEPTH + 1):
        inner = "n > 1 AND len(differ) > 0" if k < DEPTH else "false"
        feature = f"differ[1 + CAST(floor({share(repr(str(SEED)), 't', 'node', repr('feature'))} * len(differ)) AS BIGINT)]"
        parts.append(f"""n{k} AS MATERIALIZED (SELECT t, node, n, {inner} AS inner_node, f, lo[f] + {share(repr(str(SEED)), 't', 'node', repr('cut'))} * (hi[f] - lo[f]) AS cut FROM (
  SELECT *, {feature} AS f FROM (SELECT *, list_filter(range(1, {width + 1}), lambda j: hi[j] > lo[j]) AS differ FROM (
    SELECT t, node, count(*) AS n, {lists('min')} AS lo, {lists('max')} AS hi FROM l{k} GROUP BY 1, 2))))""")
        if k < DEPTH:
            parts.append(f"l{k + 1} AS MATERIALIZED (SELECT t, x, node * 2 + CASE WHEN x[f] > cut THEN 1 ELSE 0 END AS node FROM l{k} JOIN n{k} USING (t, node) WHERE inner_node)")
    parts.append("nodes AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT t, node, inner_node, f, cut, {k} + {MEAN_PATH.format(n='n')} AS length FROM n{k}" for k in range(DEPTH + 1)) + ")")
    parts.append(f"d0 AS (SELECT flow_id, x, t, 1 AS node FROM x, range({FOREST}) AS r(t))")
    for k in range(DEPTH):
        parts.append(f"d{k + 1} AS (SELECT flow_id, x, t, CASE WHEN inner_node THEN node * 2 + CASE WHEN x[f] > cut THEN 1 ELSE 0 END ELSE node END AS node FROM d{k} JOIN nodes USING (t, node))")
    score = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * pow(2.0::DOUBLE, -avg(length) / ({MEAN_PATH.format(n=SAMPLE)})) - 1))"
    return ",\n".join(parts) + f"\nSELECT flow_id, {round6(score)} AS anomaly FROM d{DEPTH} JOIN nodes USING (t, node) GROUP BY 1"


BENIGN = "ja3 IS DISTINCT FROM md5('ja3-3') AND ja3 IS DISTINCT FROM md5('ja3-7') AND bytes_out <= 200000"


@query("m3_isolation_forest", sql_flows(forest_sql(BENIGN)))
def m3(spark, d):
    """Scores of all flows by 200 trees grown from benign ones."""
    rows = match_blocklist(ml.prepare(flow_kinetics(flows(spark, d)), ml.ANOMALY_FEATURES), blocklist(spark))
    forest = ml.fit_isolation_forest(rows.where("not blocklist_hit and bytes_out <= 200000"), "flow_id", FOREST, SAMPLE, SEED)
    return ml.isolation_scores(rows.select("flow_id", "features_array"), forest, SAMPLE).select("flow_id", S.round_to(F.col("anomaly"), 6).alias("anomaly"))


@query("m4_platt_calibration")
def m4(spark, d):
    train, test = ml.group_split(_dns(spark, d), "src_ip")
    scored = ml.probability_of(_dga_model(train), test, ml.DGA_FEATURES)
    return scored.groupBy(F.floor(F.col("probability") * 10).alias("bin")).agg(F.avg("target").alias("observed"), F.avg("probability").alias("predicted"), F.count("*").alias("n"))


@query("m5_attribution")
def m5(spark, d):
    rows = _dns(spark, d)
    model = _dga_model(ml.group_split(rows, "src_ip")[0])
    found = ml.prepare(rows.where("target = 1"), ml.DGA_FEATURES).select("flow_id", "features_array")
    each = ml.attribute(found, model, ml.DGA_FEATURES, ml.medians(rows, ml.DGA_FEATURES))
    return windows.top_features(each, ["flow_id"]).select("flow_id", "feature", "contribution", "rank")


LABEL = "CASE WHEN ja3 IN (md5('ja3-3'), md5('ja3-7')) THEN 'ENCRYPTED_MALWARE' WHEN bytes_out > 200000 THEN 'DATA_EXFILTRATION' ELSE 'benign' END"
BEST = """best AS (SELECT flow_id, threat_class FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY confidence DESC,
    CASE threat_class WHEN 'DGA_DNS_TUNNELING' THEN 3 WHEN 'ENCRYPTED_MALWARE' THEN 3 WHEN 'C2_BEACONING' THEN 2 WHEN 'DATA_EXFILTRATION' THEN 2 ELSE 1 END DESC, threat_class, detector) AS r FROM dets) WHERE r = 1),
pred AS (SELECT flow_id, l, coalesce(threat_class, 'benign') AS p FROM (SELECT flow_id, """ + LABEL + """ AS l FROM flows) LEFT JOIN best USING (flow_id))"""


def _predicted(spark, d):
    rows = match_blocklist(flows(spark, d), blocklist(spark))
    label = F.when(F.col("blocklist_hit"), "ENCRYPTED_MALWARE").when(F.col("bytes_out") > 200_000, "DATA_EXFILTRATION").otherwise("benign")
    return rows.withColumn("truth", label).drop("blocklist_hit")


@query("m6_evaluate", sql_detections(f""", {BEST}, cls AS (SELECT l AS class FROM pred UNION SELECT p FROM pred),
per AS (SELECT class, (SELECT count(*) FROM pred WHERE l = class) AS support, (SELECT count(*) FROM pred WHERE p = class) AS said, (SELECT count(*) FROM pred WHERE p = class AND l = class) AS hit FROM cls),
pr AS (SELECT *, coalesce(hit / nullif(said, 0)::DOUBLE, 0) AS precision, coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS recall FROM per),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)
SELECT class, {round6('precision')} AS precision, {round6('recall')} AS recall, {round6('f1')} AS f1, support FROM (
SELECT class, precision, recall, f1, support FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), CAST(sum(support) AS BIGINT) FROM f)"""))
def m6(spark, d):
    report = ml.evaluate(_predicted(spark, d), detections(spark, d), "truth", ["benign"])[0]
    return report.withColumns({m: S.round_to(F.col(m), 6) for m in ("precision", "recall", "f1")})


@query("a19_classification_report", sql_flows("""SELECT class, hit / said::DOUBLE AS precision, hit / support::DOUBLE AS recall FROM (
  SELECT class, count(*) FILTER (l = class) AS support, count(*) FILTER (p = class) AS said, count(*) FILTER (l = class AND p = class) AS hit FROM (SELECT CAST(event_id % 3 AS VARCHAR) AS l, CAST(event_id % 5 % 3 AS VARCHAR) AS p FROM flows), (VALUES ('0'), ('1'), ('2')) AS v(class) GROUP BY 1)"""))
def a19(spark, d):
    rows = flows(spark, d).select((F.col("event_id") % 3).alias("l"), (F.col("event_id") % 5 % 3).alias("p"))
    return reports.classification_report(rows, "l", "p").where("class in ('0', '1', '2')").select("class", "precision", "recall")


@query("a18_confusion_matrix", sql_detections(f""", {BEST} SELECT l AS truth, count(*) FILTER (p = 'benign') AS benign, count(*) FILTER (p = 'ENCRYPTED_MALWARE') AS "ENCRYPTED_MALWARE", count(*) FILTER (p = 'DATA_EXFILTRATION') AS "DATA_EXFILTRATION", count(*) FILTER (p = 'RECON_PORT_SCAN') AS "RECON_PORT_SCAN",
  count(*) FILTER (p = 'DDOS') AS "DDOS", count(*) FILTER (p = 'C2_BEACONING') AS "C2_BEACONING", count(*) FILTER (p = 'DGA_DNS_TUNNELING') AS "DGA_DNS_TUNNELING" FROM pred GROUP BY 1"""))
def a18(spark, d):
    rows = ml.predicted_classes(_predicted(spark, d), detections(spark, d))
    return reports.confusion_matrix(rows, "truth", "predicted", ["benign", "ENCRYPTED_MALWARE", "DATA_EXFILTRATION", "RECON_PORT_SCAN", "DDOS", "C2_BEACONING", "DGA_DNS_TUNNELING"])


@query("a20_roc_auc", sql_flows("""SELECT floor((sum(r * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS auc FROM (
  SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM (SELECT CASE WHEN event_type = 'tls' THEN 1 ELSE 0 END AS y, bytes_out // 5000 AS s FROM flows))"""))
def a20(spark, d):
    rows = flows(spark, d).select(F.floor(F.col("bytes_out") / 5000).alias("s"), (F.col("event_type") == "tls").cast("int").alias("y"))
    return reports.roc_auc(rows, "s", "y").select(S.round_to(F.col("auc"), 6).alias("auc"))


@query("m7_prepare", sql_flows("SELECT count(*) AS n, count(DISTINCT src_ip) AS sources, 0 AS shared FROM flows WHERE dns_query IS NOT NULL"))
def m7(spark, d):
    train, test = ml.group_split(_dns(spark, d), "src_ip")
    shared = train.select("src_ip").distinct().join(test, "src_ip", "left_semi").agg(F.count("*").cast("int").alias("shared"))
    both = ml.prepare(train.unionByName(test), ml.DGA_FEATURES).where(F.size("features_array") == len(ml.DGA_FEATURES))
    return both.agg(F.count("*").alias("n"), F.countDistinct("src_ip").alias("sources")).join(shared, F.lit(True))


@query("k9_save_and_load_model")
def k9(spark, d):
    rows, path = _dns(spark, d), new_path(spark, "model")
    ml.save_model(_dga_model(rows), path)
    return ml.probability_of(ml.load_model(spark, path), rows, ml.DGA_FEATURES).select("flow_id", "probability")
