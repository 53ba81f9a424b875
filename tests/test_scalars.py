import math
import uuid

import pytest
from pyspark.sql import functions as F

from tidewarden.dims import CLASS_PARAMS
from tidewarden.functions import lexical as X
from tidewarden.functions import scalars as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("score, name", [(0, "LOW"), (30, "LOW"), (31, "MEDIUM"), (60, "MEDIUM"), (61, "HIGH"), (80, "HIGH"), (81, "CRITICAL"), (100, "CRITICAL"), (None, None)])
def test_severity_bands(spark, score, name):
    assert value(spark, S.severity(F.lit(score).cast("int"))) == name


def test_fusion_worked_example(spark):
    assert value(spark, S.fuse(F.lit("DATA_EXFILTRATION"), F.lit(0.9), F.lit(0.6), F.lit(0.3))) == 78


@pytest.mark.parametrize("x", [5.0, -5.0])
def test_fusion_stays_within_bounds(spark, x):
    assert 0 <= value(spark, S.fuse(F.lit("DDOS"), F.lit(x), F.lit(x), F.lit(x))) <= 100


def test_half_even_and_half_up_differ(spark):
    assert value(spark, S.round_half_up(F.lit(2.5))) == 3
    assert value(spark, F.bround(F.lit(2.5), 0)) == 2


def test_weights_sum_to_one():
    for weights, prior in CLASS_PARAMS.values():
        assert math.isclose(sum(weights), 1) and 0 <= prior <= 1


@pytest.mark.parametrize("name, canonical", [("dga", "DGA_DNS_TUNNELING"), ("Port-Scan", "RECON_PORT_SCAN"), (" botnet c2 ", "C2_BEACONING"), ("ransomware", None), (None, None)])
def test_canonical_class(spark, name, canonical):
    assert value(spark, S.canonical_class(F.lit(name).cast("string"))) == canonical


@pytest.mark.parametrize("times, expected", [([], 0.0), ([1000.0], 1 - math.exp(-1)), ([880.0], 1 - math.exp(-0.5)), ([1001.0], 0.0)])
def test_repeat_recency(spark, times, expected):
    array = F.array(*[F.lit(t) for t in times]).cast("array<double>")
    assert value(spark, S.recency_of(array, F.lit(1000.0))) == pytest.approx(expected)


def test_age_recency(spark):
    assert value(spark, S.age_recency(F.lit(0.0), F.lit(1800.0))) == pytest.approx(math.exp(-1))
    assert value(spark, S.age_recency(F.lit(10.0), F.lit(0.0))) == 1
    assert value(spark, S.age_recency(F.lit(10.0), F.lit(None).cast("double"))) == 1


@pytest.mark.parametrize("z, confidence", [(1, 0.17), (3, 0.5), (4.5, 0.75), (-6, 1), (60, 1)])
def test_z_to_confidence(spark, z, confidence):
    assert value(spark, S.zscore_confidence(F.lit(float(z)))) == pytest.approx(confidence, abs=0.005)


@pytest.mark.parametrize("x, clean", [(float("nan"), None), (float("inf"), None), (1.7, 1.0), (-2.0, 0.0), (None, None)])
def test_finite_and_clip(spark, x, clean):
    assert value(spark, S.clip01(S.finite(F.lit(x).cast("double")))) == clean


@pytest.mark.parametrize("text", ["flow-1", "", "ü"])
def test_name_based_uuid(spark, text):
    assert value(spark, S.uuid_from(F.lit(text))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, text))


def test_uuid_passes_through(spark):
    given = str(uuid.UUID(int=7))
    assert value(spark, S.uuid_from(F.lit(given.upper()))) == given


def test_times(spark):
    assert value(spark, S.parse_ts(F.lit("1970-01-01T05:30:01.5+0530"))) == 1.5
    assert value(spark, S.parse_ts(F.lit("yesterday"))) is None
    assert value(spark, S.to_iso(F.lit(1.25))) == "1970-01-01T00:00:01.250Z"


@pytest.mark.parametrize("ip, inside", [("10.255.0.1", True), ("172.31.9.9", True), ("172.32.0.0", False), ("192.168.50.7", True), ("192.168.51.7", False), ("fe80::1", False), ("10.0.0.256", False), ("10.0.0", False), ("", False), (None, False)])
def test_internal_addresses(spark, ip, inside):
    assert value(spark, S.is_internal(F.lit(ip).cast("string"))) is inside


@pytest.mark.parametrize("text, bits", [("google", 1.918296), ("", 0), ("aaaa", 0), ("ab", 1)])
def test_char_entropy(spark, text, bits):
    assert value(spark, X.char_entropy(F.lit(text))) == pytest.approx(bits, abs=1e-6)


def test_entropy_is_at_most_that_of_equal_shares(spark):
    for text in ("abcabc", "zzzy", "hello world"):
        assert value(spark, X.char_entropy(F.lit(text))) <= math.log2(len(set(text))) + 1e-9


def test_english_names_score_higher(spark):
    score = lambda s: value(spark, X.ngram_score(F.lit(s)))
    assert score("there") > score("xqzjvk") and score("7.7") == 0 and score("a") == 0


def test_reason_and_evidence(spark):
    assert value(spark, S.reason(F.lit("a"), F.lit(None), F.lit("b"))) == "a; b"
    assert value(spark, S.reason(F.lit(None), otherwise="none")) == "none"
    assert value(spark, S.evidence_list(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1)))) == ["a: 1", "b: 2"]
