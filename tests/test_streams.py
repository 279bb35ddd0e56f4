"""Tables that batches are merged into, id logs, offsets, contracts, and streams that stop and go on."""

from __future__ import annotations

import datetime
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkfields.operators import contracts, events
from sparkfields.plans.fixtures import view
from sparkfields.sources.log import EventLog
from sparkfields.streaming import jobs, tables

SMALL = "/root/testdata/sf0.001"
EVENT = "stream_offset bigint, event_id string, event_type string, event_version string, occurred_at timestamp, tenant_id string, document_id string, source string, confidence double, requires_human_validation boolean"


def log_of(spark, n, seed=1):
    """n events of few documents; some come twice, some before their document, some of none."""
    rng, start = random.Random(seed), datetime.datetime(2024, 1, 1)
    rows = []
    for k in range(n):
        doc = f"d{rng.randrange(12)}"
        kind = rng.choice(["ocr.completed", "ocr.failed", "extraction.completed", "erp.sent", "erp.failed", "layout.classified"] + ["document.received"] * (doc not in ("d1", "d2")))
        rows.append((k, f"e{rng.randrange(n)}", kind, "v1", start + datetime.timedelta(seconds=rng.randrange(1000)), "t", doc, "bus", 0.5, rng.random() < 0.5))
    once = {}
    for r in rows:  # a repeated id is the same event
        once.setdefault(r[1], r)
    return spark.createDataFrame([(r[0], *once[r[1]][1:]) for r in rows], EVENT)


def states(df):
    return sorted(tuple(r) for r in df.select("document_id", "status", "n_events", "received_at", "ocr_at", "extracted_at", "needs_review", "erp_status").collect())


def by_hand(rows):
    """The fold in plain Python: (document, status, events, first received, last OCR, last extraction, its review, last ERP event)."""
    first = {}
    for r in sorted(rows, key=lambda r: r.stream_offset):
        first.setdefault(r.event_id, r)
    out = []
    for doc, part in itertools.groupby(sorted(first.values(), key=lambda r: (r.document_id, r.occurred_at, r.event_id)), key=lambda r: r.document_id):
        part = list(itertools.dropwhile(lambda r: r.event_type != "document.received", part))
        if part:
            status, ocr, got, review, erp = "RECEIVED", None, None, None, None
            for r in part:
                if r.event_type in ("ocr.completed", "ocr.failed"):
                    status = r.event_type.replace(".", "_").upper()
                    ocr = r.occurred_at if r.event_type == "ocr.completed" else ocr
                elif r.event_type == "extraction.completed":
                    status, got, review = "VALIDATION_PENDING" if r.requires_human_validation else "EXTRACTION_COMPLETED", r.occurred_at, r.requires_human_validation
                elif r.event_type.startswith("erp."):
                    status, erp = r.event_type.replace(".", "_").upper(), r.event_type
            out.append((doc, status, len(part), part[0].occurred_at, ocr, got, review, erp))
    return sorted(out)


def test_fold_in_any_grouping(spark):
    log = log_of(spark, 200)
    want = by_hand(log.collect())
    assert states(events.document_state(log)) == want
    once = spark.createDataFrame(events.dedupe_events(log).collect(), EVENT)
    rows = events.fold_rows(once).withColumn("g", F.abs(F.hash("e.event_id")) % 4)
    parts = [events.fold(rows.where(f"g = {g}").drop("g")) for g in range(4)]
    left = events.fold(parts[2].unionByName(parts[0]))
    right = events.fold(parts[1].unionByName(parts[3]))
    assert states(events.folded_state(events.fold(right.unionByName(left)))) == want
    waiting = {r.event_id for r in events.orphan_events(log).collect()}
    assert waiting and waiting == {r.e.event_id for r in events.fold(left.unionByName(right)).where("e is not null").collect()}


def test_state_stream_with_restarts_and_replays(spark, tmp_path):
    log = log_of(spark, 240)
    rows = sorted(log.collect(), key=lambda r: r.stream_offset)
    stream = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for k in range(4):
        spark.createDataFrame(rows[60 * k : 60 * k + 60], EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k % 2:
            jobs.state_upsert(stream(), f"{tmp_path}/table", f"{tmp_path}/checkpoint", fanout=2, buckets=4).awaitTermination()
            assert states(jobs.read_state(spark, f"{tmp_path}/table")) == by_hand(rows[: 60 * k + 60])
    runs = jobs.state_runs(spark, f"{tmp_path}/table", 2)
    assert len(runs.manifest.last()["runs"]) == 1 and runs.manifest.last()["runs"][0][1] == 2  # four batches, two at a time
    assert runs.vacuum() == 6 and states(jobs.read_state(spark, f"{tmp_path}/table")) == by_hand(rows)


def test_a_batch_that_is_killed_or_run_again_changes_nothing(spark, tmp_path):
    runs = tables.Runs(spark, str(tmp_path), "k bigint, n bigint", lambda df: df.groupBy("k").agg(F.sum("n").alias("n")), fanout=3)
    batch = lambda b: spark.range(5).select(F.col("id").alias("k"), F.lit(10**b).cast("long").alias("n"))
    total = lambda number=None: {r.n for r in runs.read(number).collect()}
    assert runs.read().count() == 0
    for b in range(3):
        runs.add(batch(b), b)
    runs._write(batch(9), "run-3-0")  # killed before its manifest
    assert total() == {111}
    runs.add(batch(3), 3)
    runs.add(batch(3), 3)
    assert total() == {1111} and total(3) == {111} and total(2) == {11}


def test_ids_are_known_for_ever(spark, tmp_path):
    ids = lambda a, b: spark.range(a, b).select(F.concat(F.lit("id"), "id").alias("id"))
    for blocks in (1 << 12, 2):  # two blocks are full at once, which costs time and no row
        log = tables.IdLog(spark, f"{tmp_path}/{blocks}", blocks=blocks, buckets=4, fanout=2)
        for k in range(4):
            assert log.seen(ids(300 * k, 300 * k + 300), k).count() == 0
            log.add(ids(300 * k, 300 * k + 300), k)
        assert log.seen(ids(1100, 1400)).count() == 100 and log.seen(ids(0, 5)).count() == 5
    few = tables.IdLog(spark, f"{tmp_path}/{1 << 12}", blocks=1 << 12, buckets=4)
    assert few.possible(ids(5000, 8000)).count() < 30


def test_deduplicated_stream(spark, tmp_path):
    rows = [(k, f"e{k % 70}" if k % 9 else None, k % 70) for k in range(210)]
    for k in range(3):
        spark.createDataFrame(rows[70 * k : 70 * k + 70], "stream_offset bigint, event_id string, v bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("stream_offset bigint, event_id string, v bigint").parquet(f"{tmp_path}/in")
        jobs.dedupe_log(stream, f"{tmp_path}/out", f"{tmp_path}/log", f"{tmp_path}/checkpoint", buckets=4).awaitTermination()
    first = {}
    for o, i, v in rows:
        if i is not None:
            first.setdefault(i, (o, v))
    assert {r.event_id: (r.stream_offset, r.v) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == first


def test_offsets_go_on_and_scans_read_their_parts(spark, tmp_path):
    log = EventLog(spark, str(tmp_path))
    rows = lambda a, b: spark.range(a, b).select(F.concat(F.lit("s"), F.col("id") % 3).alias("s"), "id", F.lit(None).cast("string").alias("gap"))
    log.append(rows(0, 90), F.col("s"), [F.col("id")], 0, ranges=6)
    log.append(rows(90, 96), F.col("s"), [F.col("id")], 1)
    log.append(rows(90, 96), F.col("s"), [F.col("id")], 1)  # again
    log.append(rows(96, 99).unionByName(spark.range(1).select(F.lit("new").alias("s"), "id", F.lit("x").alias("gap"))), F.col("s"), [F.col("id")], 2)
    assert log.next_offsets() == {"s0": 34, "s1": 34, "s2": 34, "new": 2}
    for k in range(3):
        got = sorted((r.offset, json.loads(r.value)) for r in log.scan(f"s{k}").collect())
        assert got == [(n + 1, {"s": f"s{k}", "id": 3 * n + k}) for n in range(33)]
    part = log.scan("s1", 28, 4)
    assert sorted(r.offset for r in part.collect()) == [29, 30, 31, 32] and 1 < len(part.inputFiles()) < len(log.scan("s1").inputFiles())
    assert log.scan("s1", 33).count() == 0 and log.scan("none").count() == 0 and log.scan("new").count() == 1
    for bad in ("a/b", "a..b", " ", None):
        with pytest.raises(ValueError):
            log.append(rows(0, 3), F.lit(bad), [F.col("id")], 3)
    with pytest.raises(ValueError):
        log.scan("../x")


def test_dead_letters_keep_the_event(spark):
    rows = view(spark, SMALL, "fx_events")
    _, letters = events.route_dlq(rows)
    asks = letters.select("stream", "event_stream_id", F.lit("erp.sent").alias("target")).where("stream <> 'bogus.event.dlq'")
    again, audit = events.requeue(letters, asks, "ops", "", F.lit("2024-01-02T03:04:05Z"))
    back = events.restored_events(again, rows.schema)
    bad = events.validate_events(rows).where("not is_valid and event_type <> 'bogus.event'").select(*rows.columns)
    assert back.exceptAll(bad).count() == 0 == bad.exceptAll(back).count() and audit.count() == bad.count() > 0
    assert events.validate_events(back).where("error = 'unknown event type'").count() == 0


GOOD = {
    "event_id": "3f0e8a52-6a3e-4c53-8f0c-0e7d3a6f2b11", "event_type": "ocr.failed", "event_version": "v1", "occurred_at": "2024-01-02T03:04:05+00:00", "tenant_id": "t", "document_id": "3f0e8a526a3e4c538f0c0e7d3a6f2b11",
    "source": "bus", "data": {"reason": "x"},
}


def changed(path, value):
    event = json.loads(json.dumps(GOOD))
    at = event
    for name in path.split(".")[:-1]:
        at = at[name]
    if value is KeyError:
        del at[path.split(".")[-1]]
    else:
        at[path.split(".")[-1]] = value
    return json.dumps(event)


def test_contracts_of_single_events(spark):
    cases = [
        (json.dumps(GOOD), None), (changed("event_id", KeyError), None), (changed("occurred_at", 1_700_000_000), None), (changed("data.retryable", "no"), None), (changed("data.engine_used", None), None),
        (changed("data.metadata", {"a": [1, {"b": None}]}), None), (changed("tenant_id", ""), "tenant_id: below 1"), (changed("tenant_id", 5), "tenant_id: not string"), (changed("occurred_at", "2024-01-02T03:04:05"), "occurred_at: no zone"),
        (changed("occurred_at", "yesterday"), "occurred_at: not time"), (changed("document_id", "x"), "document_id: not uuid"), (changed("document_id", KeyError), "document_id: missing"), (changed("source", None), "source: null"),
        (changed("data.retryable", 7), "data.retryable: not bool"), (changed("data.why", 1), "data: unknown key"), (changed("why", 1), "event: unknown key"), (changed("data", []), "data: not object"), (changed("data", KeyError), "data: missing"),
        (changed("event_type", "x"), "unknown event type"), (changed("event_type", KeyError), "unknown event type"), ("{", "not an object"), ("[]", "not an object"), (None, "not an object"), ("", "not an object"),
    ]
    df = spark.createDataFrame([(k, p, "own") for k, (p, _) in enumerate(cases)], "k int, payload string, error string")
    assert {r.k: r.error for r in contracts.check_events(df).collect()} == {k: e for k, (_, e) in enumerate(cases)}
    assert contracts.check_events(df.limit(0)).count() == 0
    mine = {"mine": (contracts.Field("event_type", "string"), contracts.Field("n", "int", least=2, most=9))}
    own = spark.createDataFrame([(1, '{"event_type":"mine","n":"5"}'), (2, '{"event_type":"mine","n":1}'), (3, '{"event_type":"mine","n":2.5}')], "k int, payload string")
    assert {r.k: r.error for r in contracts.check_events(own, contract=mine).collect()} == {1: None, 2: "n: below 2", 3: "n: not int"}


def test_debounce_goes_on_after_a_stop(spark, tmp_path):
    rng, start = random.Random(9), datetime.datetime(2024, 1, 1)
    rows = sorted([(rng.choice("ab"), start + datetime.timedelta(seconds=rng.randrange(1500)), str(k)) for k in range(90)] + [("c", datetime.datetime(2100, 1, 1), "end")], key=lambda r: r[1])
    for k in range(3):
        spark.createDataFrame(rows[31 * k : 31 * k + 31], "key string, ts timestamp, item string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, ts timestamp, item string").parquet(f"{tmp_path}/in")
        out = jobs.debounce_stream(stream, "key", "ts", "item", 30, 200)
        out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    batch = jobs.debounce_max_wait(spark.createDataFrame(rows, "key string, ts timestamp, item string"), "key", "ts", "item", 30, 200).where("key <> 'c'")
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out")
    assert {(r.key, r.started, tuple(r["items"])) for r in got.collect()} == {(r.key, r.started, tuple(r["items"])) for r in batch.collect()}


def test_a_consumer_polls_on_from_its_place(spark, tmp_path):
    log = EventLog(spark, str(tmp_path))
    rows = lambda a, b: spark.range(a, b).select(F.lit("s").alias("s"), "id")
    log.append(rows(0, 7), F.col("s"), [F.col("id")], 0)
    got = []
    take = lambda df: got.append(sorted(r.offset for r in df.collect()))
    assert log.poll("s", "late", take, start="latest") == 0 and got == []
    assert log.poll("s", "all", take, count=3) == 3 and got == [[1, 2, 3], [4, 5, 6], [7]]
    log.append(rows(7, 9), F.col("s"), [F.col("id")], 1)
    got.clear()

    def fails(df):
        take(df)
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        log.poll("s", "all", fails, count=1)
    assert log.poll("s", "all", take, count=1) == 2 and log.poll("s", "late", take) == 1 and got == [[8], [8], [9], [8, 9]]
    assert log.poll("none", "all", take) == 0
    with pytest.raises(ValueError):
        log.poll("s", "x", take, start="middle")


def test_a_batch_of_events_is_files_for_all_cores(spark, tmp_path):
    from sparkfields.plans import flows

    events = flows._arrivals(spark, "/root/testdata/sf0.001", str(tmp_path), 3)
    cores = spark.sparkContext.defaultParallelism
    assert cores < len(list(tmp_path.glob("in/*.parquet"))) <= 3 * cores
    sizes = []
    events.writeStream.foreachBatch(lambda rows, n: sizes.append(rows.count())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert len(sizes) == 3 and sum(sizes) == flows.view(spark, "/root/testdata/sf0.001", "fx_events").count()
