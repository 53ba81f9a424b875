"""Queries over hosts that are numbered past the third part of their address."""

import os

import duckdb
import pytest
from oracle import assert_same

from tidewarden import plans


@pytest.fixture(scope="module")
def many_hosts(small, tmp_path_factory):
    """The events with users from 65,280 on, so that addresses run on from 10.0.255 to 10.0.256 and further."""
    d = tmp_path_factory.mktemp("hosts")
    at = "CASE WHEN event_id % 3 = 0 THEN user_id WHEN event_id % 3 = 1 THEN user_id + 65530 ELSE user_id + 88000 END"
    duckdb.sql(f"COPY (SELECT * REPLACE ({at} AS user_id, CASE WHEN event_id % 4 = 0 THEN value + 400 ELSE value END AS value) FROM '{small}/events.parquet') TO '{d}/events.parquet'")
    for name in os.listdir(small):
        if name != "events.parquet":
            os.symlink(f"{small}/{name}", d / name)
    return str(d)


@pytest.mark.parametrize("name", ["p6_is_internal", "j3_cidr_join", "d4_detect_exfil", "e1_detector_registry", "w7_best_detection", "d7_score_alerts", "p11_check_incident"])
def test_hosts_past_the_third_part_are_counted_on(spark, many_hosts, name):
    assert_same(plans.QUERIES[name](spark, many_hosts), plans.ORACLES[name], many_hosts)
