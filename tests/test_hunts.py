"""Hunt catalogues: every predicate parses, planted rows hit and near misses don't."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from cloudsift.plans import group_hunts, row_hunt_queries, row_hunts, timeline_hunts

COLUMNS = "event_time timestamp, event_name string, event_source string, user_identity_arn string, user_identity_type string, user_identity_account_id string, recipient_account_id string, source_ip_address string, aws_region string, error_code string, event_id string, request_parameters string, additional_event_data string, read_only boolean, user_agent string, session_credential_from_console string, session_issuer_arn string"


def trail(spark, rows):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], COLUMNS)


def test_row_hunts(spark):
    plain = [h for h in row_hunts.HUNTS.values() if h.actions and not h.condition]
    hits = [{"event_id": h.id, "event_name": h.actions[-1], "event_source": f"{h.sources[-1]}.amazonaws.com" if h.sources else "x"} for h in plain]
    misses = [{"event_id": "miss", "event_name": h.actions[-1], "event_source": "other.amazonaws.com"} for h in plain if h.sources]
    found = {r.label: r.hits for r in row_hunts.bulk(trail(spark, hits)).collect()}
    assert len(found) == len(row_hunts.HUNTS) and all(found[h.id] >= 1 for h in plain)
    alone = {r.label: r.hits for r in row_hunts.bulk(trail(spark, misses)).collect()}
    assert all(alone[h.id] == 0 for h in plain if h.sources)


def test_conditions(spark):
    rows = [
        {"event_id": "1", "event_name": "ConsoleLogin", "event_source": "signin.amazonaws.com", "additional_event_data": '{"MFAUsed":"No"}'},
        {"event_id": "2", "event_name": "ConsoleLogin", "event_source": "signin.amazonaws.com", "additional_event_data": '{"MFAUsed":"Yes"}'},
        {"event_id": "3", "event_name": "AddUserToGroup", "request_parameters": '{"groupName":"Admins"}'},
        {"event_id": "4", "event_name": "AddUserToGroup", "request_parameters": '{"groupName":"users"}'},
        {"event_id": "5", "event_name": "PutObject", "event_source": "s3.amazonaws.com", "request_parameters": '{"key":"how_to_decrypt.txt"}'},
        {"event_id": "6", "event_name": "CreateAccessKey", "event_source": "iam.amazonaws.com", "user_identity_arn": "arn:x:user/a", "request_parameters": '{"userName":"a"}'},
        {"event_id": "7", "event_name": "CreateAccessKey", "event_source": "iam.amazonaws.com", "user_identity_arn": "arn:x:user/b", "request_parameters": '{"userName":"a"}'},
    ]
    df = trail(spark, rows)
    ids = lambda key: sorted(r.event_id for r in row_hunts.HUNTS[key].run(df).collect())
    assert ids("H016") == ["1"] and ids("H022") == ["3"] and ids("H063") == ["5"] and ids("H131") == ["6"]
    assert row_hunts.HUNTS["H022"].run(df).first().group_name == "Admins"


def test_bulk_deletion(spark):
    rows = [{"event_id": str(i), "event_name": "DeleteObject", "event_source": "s3.amazonaws.com", "user_identity_arn": "a" if i < 50 else "b", "request_parameters": '{"bucketName":"x"}'} for i in range(99)]
    df = trail(spark, rows).withColumn("event_time", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert [(r.user_identity_arn, r.delete_count) for r in group_hunts.run("H040", df).collect()] == [("a", 50)]


def test_catalogue_is_whole():
    audit = {*row_hunts.HUNTS, *group_hunts.HUNTS, *group_hunts.FUNCTIONS}
    assert audit == {f"H{i:03d}" for i in range(1, 140)}
    assert {*timeline_hunts.HUNTS, *timeline_hunts.FUNCTIONS} == {f"T{i:03d}" for i in range(1, 31)}


def test_whole_goes_beyond_the_limit(spark):
    rows = [{"event_id": str(i), "event_name": "x", "event_source": "y", "user_identity_arn": f"a{i}", "error_code": "AccessDenied"} for i in range(60)]
    df = trail(spark, rows).withColumn("vpc_endpoint_id", F.lit(None).cast("string"))
    assert group_hunts.run("H013", df).count() == 50 and group_hunts.run("H013", df, whole=True).count() == 60
    line = spark.range(250).select(F.lit("high").alias("Level"), F.current_timestamp().alias("Timestamp"), F.col("id").cast("string").alias("EventID"), F.lit("r").alias("RuleTitle"), F.concat(F.lit("AKIA"), "id").alias("UserAccessKeyID"), F.lit("ip").alias("SrcIP"), F.lit("user").alias("UserARN"))
    assert timeline_hunts.run("T001", line).count() == 200 and timeline_hunts.run("T001", line, whole=True).count() == 250
    assert timeline_hunts.run("T013", line).count() == 50 and timeline_hunts.run("T013", line, whole=True).count() == 250


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no driver tables")
def test_every_row_hunt_is_hit_and_nearly_hit():
    db = duckdb.connect()
    db.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    hits = {r[0]: r[2] for r in db.execute(row_hunt_queries.SQL["row_hunt_hits"]).fetchall()}
    assert set(hits) == set(row_hunts.HUNTS) and all(hits.values()), [k for k, n in hits.items() if not n]
    source = row_hunt_queries._SOURCE
    for h in row_hunts.HUNTS.values():
        if h.condition and (h.sources or h.actions):
            wide = row_hunt_queries.where_of(row_hunts.RowHunt(h.id, h.severity, 1, h.sources, h.actions))
            assert db.execute(f"{source} SELECT count(*) FROM trail WHERE {wide}").fetchone()[0] > hits[h.id], h.id
