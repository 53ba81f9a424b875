"""Secret scans over a history of versions, with a ledger of what has been scanned.

Every version's content has an address, the SHA-256 of its bytes.  A ledger table
holds one row per blob and rule version that was ever scanned, with the spans found,
also where there are none.  A scan takes the blobs of the history that lack a rule
version, reads one copy of each, appends what it finds, and a report joins the
ledger's spans back to all paths and versions that hold the blob.

Appending is one write per scan; a row that a repeated run writes again says the same
and counts once, so a scan that failed midway can simply be run again.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

Span = tuple[str, int, int]


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern and what its matches must hold, else they are dropped and not tried again.

    Every match holds one of ``needs`` in either case; texts without them are not searched.
    """

    kind: str
    pattern: re.Pattern
    holds: Callable[[re.Match], bool] = bool
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class RuleSet:
    """Rules that are scanned together; any change of them needs a new ``version``."""

    version: str
    rules: tuple[Rule, ...]


def entropy(text: str) -> float:
    """Bits a character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Runs of the last two kinds are taken whole, so the least length can stand in the pattern.
BASE = RuleSet("base-1", (
    Rule("assign", ASSIGN, lambda m: len(m[2]) >= 12, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", re.compile(r"AKIA[A-Z0-9]{14,}")),
    Rule("hex", re.compile(r"[0-9a-f]{16,}")),
))

#: Further forms of secrets; one without a form of its own must look random.
FORMS = RuleSet("forms-1", (
    Rule("pem", re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s,:]|-(?!----))*-----END [A-Z ]{0,20}PRIVATE KEY-----")),
    Rule("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"), bool, ("eyj",)),
    Rule("login", re.compile(r"://[^\s:/@]{1,64}:[^\s:/@]{6,128}@[A-Za-z0-9.-]+")),
    Rule("bearer", re.compile(r"(?ai:bearer)\x20+([A-Za-z0-9+/_.=~-]{20,})"), lambda m: entropy(m[1]) >= 3.5, ("bearer",)),
    Rule("issued", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}"), bool, ("gh", "xox", "sk_live_", "aiza")),
))

RULE_SETS = (BASE, FORMS)
KINDS = tuple(rule.kind for rules in RULE_SETS for rule in rules.rules)


def find_secrets(text: str, rules: RuleSet) -> list[Span]:
    """Leftmost, non-overlapping matches of each rule, by start and then in the order of the kinds."""
    lower, spans = text.lower(), []
    for k, rule in enumerate(rules.rules):
        if not rule.needs or any(x in lower for x in rule.needs):
            spans += [(m.start(), k, m.end()) for m in rule.pattern.finditer(text) if rule.holds(m)]
    return [(rules.rules[k].kind, a, b) for a, k, b in sorted(spans)]


SPANS = "array<struct<kind:string,start:long,end:long>>"
LEDGER = f"blob string, rules string, spans {SPANS}"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def addressed(history: DataFrame) -> DataFrame:
    """``history`` with ``blob``, the address of its content; null counts as empty."""
    return history.withColumn("blob", F.sha2(F.coalesce(F.col("content").cast("string"), F.lit("")).cast("binary"), 256))


def empty_ledger(spark: SparkSession, path: str) -> None:
    """Make a ledger that holds nothing at ``path``."""
    spark.createDataFrame([], LEDGER).write.parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def unseen(history: DataFrame, ledger: DataFrame, rule_sets: tuple[RuleSet, ...]) -> DataFrame:
    """``(blob, path, version, todo)``: one place of each blob that lacks rule versions, and which.

    Only addresses are shuffled here, aggregated before they are, so a blob that a
    third of all versions hold is one row from each task.
    """
    places = addressed(history).groupBy("blob").agg(F.min(F.struct("path", "version")).alias("place"))
    known = ledger.groupBy("blob").agg(F.collect_set("rules").alias("seen"))  # as many as there are rule versions
    wanted = F.array(*[F.lit(r.version) for r in rule_sets])
    todo = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    return places.join(known, "blob", "left").select("blob", "place.path", "place.version", todo.alias("todo")).where(F.size("todo") > 0)


def scan_unseen(history: DataFrame, path: str, rule_sets: tuple[RuleSet, ...] = RULE_SETS) -> None:
    """Scan what the ledger at ``path`` lacks of ``history`` and append it there.

    ``history`` has ``path``, ``version`` and ``content``; other columns are ignored.
    Places are dealt out by path and version, so copies of one blob do not meet; rows
    that agree in all three are scanned each and count once.
    """
    spark = history.sparkSession
    by_version = {r.version: r for r in rule_sets}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, (blob, todo) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                text = batch.column(2)[k].as_py()
                rows += [(blob, name, [{"kind": kind, "start": a, "end": b} for kind, a, b in find_secrets(text, by_version[name])]) for name in todo]
            blobs, names, spans = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(names, pa.string()), pa.array(spans, _SPAN)], names=["blob", "rules", "spans"])

    work = cut(unseen(history, read_ledger(spark, path), rule_sets))  # settled before the ledger grows
    texts = addressed(history).select("blob", F.col("path").alias("p"), F.col("version").alias("v"), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("text"))
    same = work["path"].eqNullSafe(texts["p"]) & work["version"].eqNullSafe(texts["v"]) & (work["blob"] == texts["blob"])
    found = texts.join(work, same).select(work["blob"], "todo", "text").mapInArrow(run, LEDGER)
    found.write.mode("append").parquet(path)


def findings(history: DataFrame, ledger: DataFrame, rule_sets: tuple[RuleSet, ...] = RULE_SETS) -> DataFrame:
    """``(path, version, blob, base, spans)`` of every row of ``history``: spans of the first rule set, and of all.

    The ledger gives one row per blob, so a blob with many paths is a hot key on one
    side only, which adaptive execution splits.
    """
    current = ledger.where(F.col("rules").isin([r.version for r in rule_sets])).dropDuplicates(["blob", "rules"])
    order = F.array(*[F.lit(k) for k in (rule.kind for r in rule_sets for rule in r.rules)])
    by_place = lambda spans: F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("k"), s["end"], s["kind"]))),
        lambda s: F.struct(s["kind"], s["start"], s["end"]),
    )
    first = F.flatten(F.collect_list(F.when(F.col("rules") == rule_sets[0].version, F.col("spans"))))
    blobs = current.groupBy("blob").agg(by_place(first).alias("base"), by_place(F.flatten(F.collect_list("spans"))).alias("spans"))
    return addressed(history).select("path", "version", "blob").join(blobs, "blob", "left").select("path", "version", "blob", "base", "spans")


def told(spans: str):
    """Spans as kind:start:end, comma-joined; none is the empty text."""
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))


def secrets(docs: DataFrame, ledger_path: str) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base, spans)`` for each row of ``docs``.

    Documents are paths of one version each.  The rules come in two releases, as they
    do in time: the first scan runs the base rules over all blobs, the second finds
    those pairs in the ledger and runs the further forms alone.  Null texts are empty;
    rows with one id, or none, are told apart by their content.
    """
    spark = docs.sparkSession
    history = docs.select(F.col("doc_id").cast("long").alias("path"), F.lit(0).alias("version"), F.col("text").alias("content"))
    empty_ledger(spark, ledger_path)
    scan_unseen(history, ledger_path, (BASE,))
    scan_unseen(history, ledger_path, RULE_SETS)
    found = findings(history, read_ledger(spark, ledger_path))
    counts = [F.coalesce(F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == kind), False)), F.lit(0)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select(F.col("path").alias("doc_id"), *counts, told("base").alias("base"), told("spans").alias("spans"))
