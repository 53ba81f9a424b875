"""Readers of sensor logs, labelled flow tables, blocklists and event envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import JA3_BLOCKLIST
from ..functions.scalars import finite
from ..schemas import ENVELOPE, EVE, ZEEK

ZEEK_TYPES = ("conn", "dns", "ssl", "ssh", "http", "notice", "software")  # fixed values: log types


def read_eve(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of the nested sensor format; malformed lines and unknown types are skipped."""
    rows = spark.read.schema(EVE).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("event_type").isNotNull() & (F.col("event_type") != "stats"))


def read_zeek(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines of the flat sensor format, one file per type; the type comes from the file's name."""
    rows = spark.read.schema(ZEEK).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.log").json(folder)
    kind = F.regexp_extract(F.col("_metadata.file_name"), r"^([a-z]+)", 1)
    return rows.withColumn("log_type", kind).where(F.col("log_type").isin(*ZEEK_TYPES))


def stream_events(spark: SparkSession, folder: str, files_per_trigger: int | None = None, since: float | None = None) -> DataFrame:
    """Follow a folder of nested sensor logs; ``since`` keeps only records from that epoch second on."""
    reader = spark.readStream.schema(EVE).option("mode", "DROPMALFORMED")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.json(folder).where(F.col("event_type").isNotNull() & (F.col("event_type") != "stats"))
    if since is not None:
        rows = rows.where(F.unix_micros(F.col("timestamp").try_cast("timestamp")) >= int(since * 1e6))
    return rows


def read_flow_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A labelled flow table in CSV; the source file's name, which tells the label, is dropped."""
    return spark.read.schema(schema).option("header", True).csv(path).drop("source_file")


def read_blocklist(spark: SparkSession, json_path: str | None = None, csv_path: str | None = None) -> DataFrame:
    """``ja3``: the built-in fingerprints, a JSON list and a commented CSV, trimmed, lower-cased, distinct."""
    lists = spark.createDataFrame([(x,) for x in JA3_BLOCKLIST], "ja3 string")
    if json_path:
        whole = spark.read.option("wholetext", True).text(json_path)
        lists = lists.union(whole.select(F.explode(F.from_json("value", "array<string>"))))
    if csv_path:
        lines = spark.read.text(csv_path).select(F.trim("value").alias("line")).where("line != '' and not line like '#%'")
        lists = lists.union(lines.select(F.split("line", ",")[0]))
    return merge_blocklists(lists)


def merge_blocklists(*lists: DataFrame) -> DataFrame:
    """Distinct union of fingerprint lists."""
    out = lists[0].toDF("ja3")
    for other in lists[1:]:
        out = out.union(other.toDF("ja3"))
    return out.select(F.lower(F.trim("ja3")).alias("ja3")).where("ja3 != ''").distinct()


def parse_envelope(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split entries with a JSON ``data`` column into events and rejects.

    An event needs a finite ``ts`` and non-empty ``flow_id``, ``src_ip`` and
    ``event_type``.  Rejects carry ``data`` and ``error``.
    """
    # As a row of its own the event is parsed once; as a column it would be again wherever it is named.
    parsed = entries.select("*", F.explode(F.array(F.from_json("data", ENVELOPE, {"mode": "PERMISSIVE"}))).alias("event"))
    is_object = F.coalesce(F.trim("data").startswith("{"), F.lit(False)) & F.col("event").isNotNull()
    missing = [F.when(F.coalesce(F.col(f"event.{c}"), F.lit("")) == "", F.lit(f"missing {c}")) for c in ("ts", "flow_id", "src_ip", "event_type")]
    ts = finite(F.col("event.ts").try_cast("double"))
    error = (
        F.when(F.col("data").isNull(), "no data")
        .when(~is_object | F.coalesce(*[F.col(f"event.{c}").cast("string") for c in parsed.schema["event"].dataType.names]).isNull(), "not a JSON object")
        .otherwise(F.coalesce(*missing, F.when(ts.isNull(), "ts is not a finite number")))
    )
    marked = parsed.withColumn("error", error)
    valid = marked.where("error is null").select(*entries.columns, "event.*").withColumn("ts", F.col("ts").cast("double")).drop("data")
    return valid, marked.where("error is not null").select("data", "error")
