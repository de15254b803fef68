"""Runs of the streaming ingest: files added, changed and left alone; failures between rows and ledger."""

import json
import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cloudsift.sources.loads import Loads
from cloudsift.streaming import hunts, ingest


def line(i, port=443):
    return f"2 1 eni-{i} 10.0.0.1 8.8.8.8 5 {port} 6 1 10 100 160 ACCEPT OK"


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, lines in files.items():
        path = folder / f"{name}.log"
        path.write_text("\n".join(lines) + "\n")
        at = time.time() + put.later
        os.utime(path, (at, at))
    put.later += 5


put.later = -10_000


def seen(loads, name="records", **how):
    return sorted((r.source_file.rsplit("/", 1)[1][0], r.interface_id, r.dstport) for r in loads.rows(name, **how).collect())


def test_runs_load_what_is_new_or_changed(spark, tmp_path):
    source, root = tmp_path / "logs", str(tmp_path / "out")
    put(source, a=[line(1), line(2)], b=[line(3)], c=[line(4)])
    loads = ingest.ingest(spark, str(source), root)
    assert seen(loads) == [("a", "eni-1", 443), ("a", "eni-2", 443), ("b", "eni-3", 443), ("c", "eni-4", 443)]
    first = {r.source_file: r.load for r in loads.ledger().collect()}
    put(source, a=[line(1, 22)], d=[line(5), "broken"])
    loads = ingest.ingest(spark, str(source), root)
    assert seen(loads) == [("a", "eni-1", 22), ("b", "eni-3", 443), ("c", "eni-4", 443), ("d", "eni-5", 443)]
    # Appended, the changed file's old rows stay.
    assert seen(loads, appended=True) == sorted([*seen(loads), ("a", "eni-1", 443), ("a", "eni-2", 443)])
    assert [(r.kind, r.raw) for r in loads.rows("issues").collect()] == [("row", "broken")]
    second = {r.source_file: r.load for r in loads.ledger().collect()}
    assert {f[-5] for f, load in second.items() if first.get(f) != load} == {"a", "d"}
    # Nothing new: no load, the ledger stays.
    ingest.ingest(spark, str(source), root)
    assert {r.source_file: r.load for r in loads.ledger().collect()} == second
    assert loads.vacuum("records") == [] and seen(loads) == [("a", "eni-1", 22), ("b", "eni-3", 443), ("c", "eni-4", 443), ("d", "eni-5", 443)]


def test_a_run_that_breaks_off_between_rows_and_ledger_is_taken_up(spark, tmp_path):
    source, root = tmp_path / "logs", str(tmp_path / "out")
    put(source, a=[line(1)], b=[line(2)])
    ingest.ingest(spark, str(source), root)
    before = seen(Loads(spark, root))
    put(source, a=[line(1, 22), line(9, 22)], c=[line(3)])

    def fail(load):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        ingest.ingest(spark, str(source), root, after_write=fail)
    # The rows are written, but nobody sees them.
    assert seen(Loads(spark, root)) == before and ingest.runs(spark, root) == (2, 1)
    loads = ingest.ingest(spark, str(source), root)
    assert seen(loads) == [("a", "eni-1", 22), ("a", "eni-9", 22), ("b", "eni-2", 443), ("c", "eni-3", 443)]
    assert ingest.runs(spark, root) == (2, 2)
    plain = ingest.ingest(spark, str(source), str(tmp_path / "plain"))
    assert seen(plain) == seen(loads)


def test_batches_of_a_run_are_loads_of_their_own(spark, tmp_path):
    source, root = tmp_path / "logs", str(tmp_path / "out")
    put(source, **{n: [line(i)] for i, n in enumerate("abcde")})
    loads = ingest.ingest(spark, str(source), root, most_files=2)
    assert len(seen(loads)) == 5 and sorted(r.load for r in loads.ledger().collect()) == [0, 0, 1, 1, 2]
    put(source, **{n: [line(9)] for n in "abcde"})
    loads = ingest.ingest(spark, str(source), root)
    assert loads.vacuum("records") == [0, 1, 2] and {x[1] for x in seen(loads)} == {"eni-9"}


def test_audit_files_by_stream(spark, tmp_path):
    source, root = tmp_path / "logs", str(tmp_path / "out")
    source.mkdir()
    event = lambda i: {"eventID": str(i), "eventName": "Get", "eventTime": "2024-01-01T00:00:00Z"}
    (source / "a.json").write_text(json.dumps({"Records": [event(1), event(2)]}))
    (source / "b.json").write_text("{no")
    loads = ingest.ingest(spark, str(source), root, ingest.audit_batch, whole=True)
    assert sorted(r.event_id for r in loads.rows("events").collect()) == ["1", "2"]
    assert [r.source_file[-6:] for r in loads.rows("errors").collect()] == ["b.json"]


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    source, root = str(tmp_path / "log"), str(tmp_path / "out")
    schema = "who string, at timestamp"

    def run(*rows):
        spark.createDataFrame([(w, datetime(2024, 1, 1, h, m)) for w, h, m in rows], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        late = hunts.run(hunts.windowed(stream, ["who"], "at", {"n": F.count("*")}), ["who"], root)
        return late, sorted((r.who, r.window_start.hour, r.n) for r in hunts.windows(spark, ["who"], root).collect())

    assert run(("a", 1, 0), ("a", 1, 30), ("b", 5, 0)) == (0, [("a", 1, 2), ("b", 5, 1)])
    # The watermark is 4:00: 3:59 is too late, 4:10 is not, and an open window grows.
    assert run(("a", 3, 59), ("a", 4, 10), ("b", 5, 59)) == (1, [("a", 1, 2), ("a", 4, 1), ("b", 5, 2)])


def test_batches_are_bounded_by_bytes_not_by_files(spark, tmp_path):
    source, root = tmp_path / "logs", str(tmp_path / "out")
    put(source, **{f"f{i}": [line(i)] for i in range(1100)})
    loads = ingest.ingest(spark, str(source), root)
    # A batch of 1,000 files would make two loads.
    assert [r.load for r in loads.ledger().select("load").distinct().collect()] == [0] and loads.rows("records").count() == 1100
