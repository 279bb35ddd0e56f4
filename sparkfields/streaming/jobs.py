"""Structured Streaming jobs over the event log, and debounce in batch and in a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import classify, events, extract
from . import tables


def debounce(df: DataFrame, key: str, ts: str, item: str, seconds: int) -> DataFrame:
    """(key, started, n, items): items of a key that are at most `seconds` apart, in order of time and item; batch or stream."""
    stamp = F.col(ts).cast("timestamp")
    rows = df.withColumn("_ts", stamp)
    if df.isStreaming:
        rows = rows.withWatermark("_ts", f"{seconds} seconds")
    groups = rows.groupBy(F.col(key).alias("key"), F.session_window("_ts", f"{seconds} seconds").alias("w"))
    items = F.array_sort(F.collect_list(F.struct(F.col("_ts").alias("t"), F.col(item).alias("i"))))
    return groups.agg(F.count("*").alias("n"), items.alias("i")).select("key", F.col("w.start").alias("started"), "n", F.transform("i", lambda x: x["i"]).alias("items"))


def debounce_max_wait(df: DataFrame, key: str, ts: str, item: str, seconds: float, max_wait: float) -> DataFrame:
    """As debounce, but a group also ends before the item that comes max_wait seconds after its first.

    Groups of the silence alone are cut first, so that what is folded in one row
    is a session and not all of a key. The fold keeps the place at which each
    group starts; the items are sliced afterwards.
    """
    if max_wait <= seconds:
        raise ValueError("max_wait must be longer than the delay")
    one = debounce(df.withColumn("_pair", F.struct(F.col(ts).cast("timestamp").cast("double").alias("t"), F.col(item).alias("i"))), key, ts, "_pair", int(seconds))
    start = F.struct(F.lit(None).cast("double").alias("first"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("n"))

    def step(acc, x):
        fresh = acc["first"].isNull() | (x["t"] - acc["first"] >= max_wait)
        return F.struct(F.when(fresh, x["t"]).otherwise(acc["first"]).alias("first"), F.when(fresh, F.concat(acc["at"], F.array(acc["n"]))).otherwise(acc["at"]).alias("at"), (acc["n"] + 1).alias("n"))

    cuts = one.select("key", "items", F.aggregate("items", start, step, lambda a: F.concat(a["at"], F.array(a["n"]))).alias("at"))
    parts = cuts.select("key", "items", "at", F.explode(F.sequence(F.lit(0), F.size("at") - 2)).alias("k"))
    groups = parts.select("key", F.slice("items", F.get("at", F.col("k")) + 1, F.get("at", F.col("k") + 1) - F.get("at", F.col("k"))).alias("g"))
    return groups.select("key", F.timestamp_seconds(F.get("g", 0)["t"]).alias("started"), F.size("g").cast("long").alias("n"), F.transform("g", lambda x: x["i"]).alias("items"))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debounce(StatefulProcessor):
    """Groups of one key: items are appended to its list as they come, and looked at when a timer says that a group may be final."""

    def __init__(self, seconds: float, max_wait: float):
        self.seconds, self.max_wait = seconds, max_wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "t double, item string")
        self.due = handle.getValueState("due", "at bigint")

    def close(self) -> None:
        pass

    def _wake(self, at: int) -> None:
        """One timer a key: an earlier one replaces it."""
        held = self.due.get() if self.due.exists() else None
        if held is None or at < held[0]:
            if held is not None:
                self.handle.deleteTimer(held[0])
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        late = timerValues.getCurrentWatermarkInMs() / 1000
        new = [(t.timestamp(), i) for frame in rows for t, i in zip(frame["ts"], frame["item"], strict=True)]
        new = [x for x in new if x[0] > late]
        if new:
            self.items.appendList(new)
            self._wake(int((min(new)[0] + self.seconds) * 1000) + 1)
        yield pd.DataFrame(columns=["key", "started", "n", "items"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        groups: list[list[tuple[float, str]]] = []
        for t, i in sorted(self.items.get(), key=lambda x: (x[0], x[1] is not None, x[1])):
            if not groups or t - groups[-1][-1][0] > self.seconds or t - groups[-1][0][0] >= self.max_wait:
                groups.append([])
            groups[-1].append((t, i))
        now, out = timerValues.getCurrentWatermarkInMs() / 1000, []
        final = lambda g: min(g[-1][0] + self.seconds, g[0][0] + self.max_wait)
        while groups and now > final(groups[0]):
            g = groups.pop(0)
            out.append((key[0], pd.Timestamp(round(g[0][0] * 1e6), unit="us"), len(g), [i for _, i in g]))
        self.due.clear()
        if groups:
            if out:
                self.items.put([x for g in groups for x in g])
            self._wake(max(int(final(groups[0]) * 1000), timerValues.getCurrentWatermarkInMs()) + 1)
        else:
            self.items.clear()
        yield pd.DataFrame(out, columns=["key", "started", "n", "items"])


def debounce_stream(df: DataFrame, key: str, ts: str, item: str, seconds: float, max_wait: float) -> DataFrame:
    """debounce_max_wait over a stream, whatever the order in which items within the watermark come.

    A key's items that aren't final are a list in the state store (RocksDB, which
    is set for the session): what comes is appended, and the list is read when the
    watermark passes a timer, at which its first group may be final. Items older
    than the watermark are dropped. Groups that are open at the end are emitted
    when the input has an end mark (runs.ended).
    """
    if max_wait <= seconds:
        raise ValueError("max_wait must be longer than the delay")
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(item).cast("string").alias("item")).withWatermark("ts", f"{int(seconds)} seconds")
    return rows.groupBy("key").transformWithStateInPandas(Debounce(seconds, max_wait), "key string, started timestamp, n bigint, items array<string>", "Append", "EventTime")


def dedupe_stream(df: DataFrame, key: str = "event_id", ts: str = "occurred_at", within: str = "1 hour") -> DataFrame:
    """A stream without repeated ids that come within the given time of each other."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def route_stream(df: DataFrame, good: str, dead: str, checkpoint: str, **trigger):
    """Valid events of a stream to one Parquet folder, dead letters to another; a batch that is run again is written under its own number."""
    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        ok, bad = events.route_dlq(batch)
        ok.write.mode("overwrite").parquet(f"{good}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{dead}/batch={number}")
        batch.unpersist()

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def dedupe_log(df: DataFrame, out: str, log: str, checkpoint: str, key: str = "event_id", order: str = "stream_offset", buckets: int = 64, **trigger):
    """Events of a stream whose id no batch has brought before, however long ago, to a Parquet folder for each batch.

    Of one batch's rows with an id the first by `order` stays; rows without id
    go. What a batch is compared with is the log as it was before that batch, so
    one that is run again writes the same.
    """
    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = tables.IdLog(spark, log, buckets=buckets)
        tables.unseen(batch, seen, key, F.col(order), number).write.mode("overwrite").parquet(f"{out}/batch={number}")
        seen.add(spark.read.schema(batch.schema).parquet(f"{out}/batch={number}").select(F.col(key).cast("string").alias("id")), number)

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def state_runs(spark: SparkSession, table: str, fanout: int = tables.FANOUT) -> tables.Runs:
    return tables.Runs(spark, f"{table}/state", events.FOLD, events.fold, fanout)


def read_state(spark: SparkSession, table: str) -> DataFrame:
    """The documents that state_upsert has folded so far, as document_state gives them."""
    return events.folded_state(state_runs(spark, table).read())


def state_upsert(df: DataFrame, table: str, checkpoint: str, fanout: int = tables.FANOUT, buckets: int = 64, **trigger):
    """Valid events of a stream folded into a table of document states; the event log itself is never read again.

    Ids that were seen go. The rest of a batch is folded alone and added as a run
    (tables.Runs), so a batch costs what it brings, and a batch that is killed or
    run again changes nothing. Events that come before their document wait in the
    table until it is received.
    """
    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen, fresh = tables.IdLog(spark, f"{table}/ids", buckets=buckets, fanout=fanout), f"{table}/fresh"
        good = events.validate_events(batch).where("is_valid").drop("error", "is_valid")
        events.fold_rows(tables.unseen(good, seen, "event_id", F.col("stream_offset"), number)).write.mode("overwrite").parquet(fresh)
        rows = spark.read.schema(events.FOLD).parquet(fresh)
        state_runs(spark, table, fanout).add(rows, number)
        seen.add(rows.select(F.col("e.event_id").alias("id")), number)

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def classify_extract(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Received texts (event_id, tenant_id, document_id, text) to extraction events in one step; batch or stream.

    Layout, schema and the schema's fields; each row records the event that it
    comes from and the first 500 characters.
    """
    rows = classify.layout_classify(df, text_col).withColumnsRenamed({"confidence": "layout_confidence", "requires_human_validation": "layout_review"})
    rows = rows.withColumn("schema_id", extract.schema_of_layout(F.col("layout")))
    t = F.col(text_col)
    found = {"linha_digitavel": extract.LINHA, "vencimento": extract.DATE, "valor": extract.AMOUNT, "beneficiario": extract.PAYEE, "unidade": extract.UNIT, "consumo_kwh": extract.KWH}
    names = {"boleto": ["linha_digitavel", "vencimento", "valor", "beneficiario"], "fatura": ["vencimento", "valor", "unidade", "consumo_kwh"]}
    rows = rows.withColumn("_f", F.create_map(*[x for n, p in found.items() for x in (F.lit(n), extract.first(t, p))]))
    wanted = F.when(F.col("schema_id") == "boleto", F.array(*[F.lit(n) for n in names["boleto"]])).when(F.col("schema_id") == "fatura", F.array(*[F.lit(n) for n in names["fatura"]])).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("fields", F.map_filter("_f", lambda k, v: F.array_contains(wanted, k) & v.isNotNull()))
    confidence = F.when(F.col("schema_id") == "generic", F.when((F.trim(F.coalesce(t, F.lit(""))) == ""), 0.0).otherwise(0.25)).otherwise(F.size("fields") / 4)
    rows = rows.withColumn("confidence", confidence).withColumn("requires_human_validation", F.col("confidence") < 0.75).withColumn("preview", F.substring(t, 1, 500))
    return rows.withColumn("input_event_id", F.col("event_id")).withColumn("event_type", F.lit("extraction.completed")).drop("_f")


def failure_events(df: DataFrame) -> DataFrame:
    """Rows with an error as ocr.failed events (reason, retryable, input_event_id, file_uri)."""
    return df.where("error is not null").select(F.lit("ocr.failed").alias("event_type"), "tenant_id", "document_id", F.col("error").alias("reason"), F.lit(True).alias("retryable"), F.col("event_id").alias("input_event_id"), "file_uri")


def flush_rows(groups: DataFrame, bad) -> tuple[DataFrame, DataFrame]:
    """Groups that a handler takes, and those for which the column bad says why not; other keys go on."""
    marked = groups.withColumn("error", bad)
    return marked.where("error is null").drop("error"), marked.where("error is not null")
