"""Event contracts, dead letters, state folded from events, decisions and exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from .inbox import first_per_key

# Event types of the contract, and statuses that an event sets.
TYPES = ["document.received", "ocr.completed", "ocr.failed", "layout.classified", "extraction.completed", "erp.integration.requested", "erp.sent", "erp.failed"]
STREAMS = [*TYPES[:1], "ocr.completed", "ocr.failed", "layout.classified", "extraction.completed", "erp.sent", "erp.failed"]
SUFFIX = ".dlq"
#: Times in payloads keep their microseconds.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def validate_events(df: DataFrame) -> DataFrame:
    """df with is_valid and error, the first rule that an event breaks: type, version, tenant, source, confidence, time."""
    blank = lambda c: F.coalesce(X.strip_space(F.col(c)) == "", F.lit(True))
    rules: list[tuple[Column, str]] = [
        (~F.coalesce(F.col("event_type").isin(TYPES), F.lit(False)), "unknown event type"), (~F.coalesce(F.col("event_version") == "v1", F.lit(False)), "event_version"), (blank("tenant_id"), "tenant_id"),
        (blank("source"), "source"), (F.coalesce((F.col("confidence") < 0) | (F.col("confidence") > 1), F.lit(False)), "confidence"), (F.col("occurred_at").isNull(), "occurred_at"),
    ]
    error = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        error = F.when(broken, F.lit(name)).otherwise(error)
    return df.withColumn("error", error).withColumn("is_valid", F.col("error").isNull())


def validate_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """df with error of JSON events: unreadable, unknown or missing keys, sha256 of other than 64 digits, a time without zone."""
    allowed = ["event_id", "event_type", "event_version", "occurred_at", "tenant_id", "document_id", "correlation_id", "source", "data"]
    keys = F.json_object_keys(payload)
    get = lambda p: F.get_json_object(payload, p)
    sha = get("$.data.file.sha256")
    error = (
        F.when(keys.isNull(), "not an object").when(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))) > 0, "unknown key")
        .when(F.size(F.array_except(F.array(*[F.lit(k) for k in allowed[:5]]), keys)) > 0, "missing key").when(~get("$.event_type").isin(TYPES), "unknown event type")
        .when(sha.isNotNull() & (F.length(sha) != 64), "sha256").when(~F.coalesce(get("$.occurred_at").rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.lit(False)), "occurred_at")
        .when((get("$.data.file.size_bytes").try_cast("bigint") < 0) | (get("$.data.confidence").try_cast("double") > 1), "range")
    )
    return df.withColumn("error", error)


def dedupe_events(events: DataFrame) -> DataFrame:
    """The first event of each id in the stream."""
    return first_per_key(events, ["event_id"], ["stream_offset"])


def dedupe_content(media: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """media with is_duplicate: whether an earlier row has the same content."""
    return media.withColumn("is_duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def new_documents(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming (tenant_id, original_filename, id) with outcome created or duplicate: known, or later in the batch."""
    known = existing.select(F.col("tenant_id").alias("k_t"), F.col("original_filename").alias("k_f")).distinct().withColumn("known", F.lit(True))
    rows = incoming.join(known, (F.col("tenant_id") == F.col("k_t")) & (F.col("original_filename") == F.col("k_f")), "left")
    n = F.row_number().over(Window.partitionBy("tenant_id", "original_filename").orderBy("received_at", "id"))
    return rows.withColumn("outcome", F.when(F.col("known").isNotNull() | (n > 1), "duplicate").otherwise("created")).drop("k_t", "k_f", "known")


#: A row of the fold: what is folded of a document so far, or an event `e` that comes before the document's first document.received.
FOLD = (
    "document_id string, birth struct<occurred_at:timestamp,event_id:string>, n bigint, status struct<occurred_at:timestamp,event_id:string,v:string>, ocr struct<occurred_at:timestamp,event_id:string>, "
    "extracted struct<occurred_at:timestamp,event_id:string,v:boolean>, erp struct<occurred_at:timestamp,event_id:string,v:string>, e struct<occurred_at:timestamp,event_id:string,event_type:string,review:boolean>"
)


def fold_rows(events: DataFrame) -> DataFrame:
    """Valid events of distinct ids as rows for fold()."""
    at = F.struct(F.col("occurred_at").cast("timestamp").alias("occurred_at"), F.col("event_id").cast("string").alias("event_id"))
    e = at.withField("event_type", F.col("event_type")).withField("review", F.col("requires_human_validation"))
    rows = events.select(F.col("document_id").cast("string").alias("document_id"), F.when(F.col("event_type") == "document.received", at).alias("birth"), e.alias("e"))
    none = {c: F.lit(None) for c in ("n", "status", "ocr", "extracted", "erp")}
    kinds = dict(re.findall(r"(\w+) (struct<[^>]*>|bigint|string)", FOLD))
    return rows.select(*[none[c].cast(t).alias(c) if c in none else F.col(c).cast(t).alias(c) for c, t in kinds.items()])


def fold(rows: DataFrame) -> DataFrame:
    """One folded row for each document, and the events that wait for its first document.received (or an earlier one) as they are.

    Its results can be folded again with other rows, in any order and grouping. A
    document's rows are summed where they lie, and joined with one row for each
    document, so that one with very many events is no group of one task.
    """
    births = rows.where("birth is not null").groupBy(F.col("document_id").alias("of")).agg(F.min("birth").alias("born"))
    rows = rows.join(births, F.col("document_id") == F.col("of"), "left")
    at = F.struct(F.col("e.occurred_at").alias("occurred_at"), F.col("e.event_id").alias("event_id"))
    ready = F.coalesce(at >= F.col("born"), F.lit(False))
    kind = F.col("e.event_type")
    status = (
        F.when(kind == "ocr.completed", "OCR_COMPLETED").when(kind == "ocr.failed", "OCR_FAILED").when(kind == "extraction.completed", F.when(F.col("e.review"), "VALIDATION_PENDING").otherwise("EXTRACTION_COMPLETED"))
        .when(kind == "erp.sent", "ERP_SENT").when(kind == "erp.failed", "ERP_FAILED")
    )
    own = rows.where(F.col("e").isNotNull() & ready).select(
        "document_id", "birth", F.lit(1).cast("long").alias("n"), F.when(status.isNotNull(), at.withField("v", status)).alias("status"), F.when(kind == "ocr.completed", at).alias("ocr"),
        F.when(kind == "extraction.completed", at.withField("v", F.col("e.review"))).alias("extracted"), F.when(kind.isin("erp.sent", "erp.failed"), at.withField("v", kind)).alias("erp"),
    )
    names = ["document_id", "birth", "n", "status", "ocr", "extracted", "erp"]
    both = own.unionByName(rows.where("e is null").select(*names))
    last = [F.max(c).alias(c) for c in ("status", "ocr", "extracted", "erp")]
    folded = both.groupBy("document_id").agg(F.min("birth").alias("birth"), F.sum("n").alias("n"), *last).withColumn("e", F.lit(None).cast(rows.schema["e"].dataType))
    waiting = rows.where(F.col("e").isNotNull() & ~ready).select(*names, "e")
    return folded.unionByName(waiting)


def folded_state(rows: DataFrame) -> DataFrame:
    """The documents of fold()'s rows: (document_id, status, n_events, received_at, ocr_at, extracted_at, needs_review, erp_status)."""
    return rows.where("e is null").select(
        "document_id", F.coalesce("status.v", F.lit("RECEIVED")).alias("status"), F.col("n").alias("n_events"), F.col("birth.occurred_at").alias("received_at"), F.col("ocr.occurred_at").alias("ocr_at"),
        F.col("extracted.occurred_at").alias("extracted_at"), F.col("extracted.v").alias("needs_review"), F.col("erp.v").alias("erp_status"),
    )


def _valid_once(events: DataFrame) -> DataFrame:
    return dedupe_events(validate_events(events).where("is_valid")).drop("error", "is_valid")


def document_state(events: DataFrame) -> DataFrame:
    """(document_id, status, n_events, received_at, ocr_at, extracted_at, needs_review, erp_status): valid events folded.

    Repeated ids count once; events come in order of time and id; those before
    the first document.received find no document: orphan_events() has them.
    """
    at = events.schema["occurred_at"].dataType.simpleString()
    state = folded_state(fold(fold_rows(_valid_once(events))))
    return state.withColumns({c: F.col(c).cast(at) for c in ("received_at", "ocr_at", "extracted_at")})


def orphan_events(events: DataFrame, source: str = "bus", at: Column | None = None) -> DataFrame:
    """Dead letters of valid events that find no document: theirs is never received, or only later."""
    rows = _valid_once(events)
    waiting = fold(fold_rows(rows)).where("e is not null").select(F.col("e.event_id").alias("orphan"))
    lost = rows.join(waiting, F.col("event_id") == F.col("orphan"), "left_semi")
    return dead_letters(lost, events.columns, F.lit("LookupError"), F.concat(F.lit("document not found: "), F.col("document_id")), source, at)


def dead_letters(rows: DataFrame, event: list[str], error_type: Column, error: Column, source: str, at: Column | None = None) -> DataFrame:
    """(occurred_at, source, stream, event_stream_id, event_type, event_id, error_type, error, payload) for each row; payload has the whole event, its columns `event`, as JSON without nulls."""
    stream = F.concat(F.coalesce("event_type", F.lit("unknown")), F.lit(SUFFIX))
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in event]), JSON_TIMES)
    return rows.select(
        (F.current_timestamp() if at is None else at).alias("occurred_at"), F.lit(source).alias("source"), stream.alias("stream"), F.col("stream_offset").alias("event_stream_id"), "event_type", "event_id",
        error_type.alias("error_type"), error.alias("error"), whole.alias("payload"),
    )


def route_dlq(events: DataFrame, source: str = "bus", at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid events, and the dead letters of the others."""
    checked = validate_events(events)
    letters = dead_letters(checked.where("not is_valid"), [c for c in events.columns if c not in ("error", "is_valid")], F.lit("ValueError"), F.col("error"), source, at)
    return checked.where("is_valid").drop("error", "is_valid"), letters


def restored_events(payloads: DataFrame, schema: T.StructType) -> DataFrame:
    """The events that payloads of dead letters hold, as they were before they went wrong."""
    return payloads.select(F.from_json("payload", schema, JSON_TIMES).alias("e")).select("e.*")


def dlq_summary(letters: DataFrame, limit: int = 50) -> DataFrame:
    """(stream, total, n, last_id, last_error): all letters of each stream, and the number, last id and last error of its first `limit`.

    The rank is filtered next to the window, so each task keeps `limit` letters
    of a stream before they are dealt.
    """
    total = letters.groupBy("stream").agg(F.count("*").alias("total"))
    n = F.row_number().over(Window.partitionBy("stream").orderBy("event_stream_id"))
    head = letters.select("stream", "event_stream_id", "error", n.alias("_n")).where(F.col("_n") <= limit)
    head = head.groupBy(F.col("stream").alias("of")).agg(F.count("*").alias("n"), F.max(F.struct("event_stream_id", "error")).alias("l"))
    rows = total.join(head, F.col("stream") == F.col("of"))
    return rows.select("stream", "total", "n", F.col("l.event_stream_id").alias("last_id"), F.col("l.error").alias("last_error"))


def dlq_requeue(letters: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (stream, event_stream_id, target or null) with outcome and target stream; audit rows are those requeued."""
    q = requests.select(F.col("stream").alias("q_stream"), F.col("event_stream_id").alias("q_id"), F.col("target").alias("q_target"))
    rows = q.join(letters, (F.col("q_stream") == F.col("stream")) & (F.col("q_id") == F.col("event_stream_id")), "left")
    target = F.coalesce("q_target", F.regexp_replace("q_stream", r"\.dlq$", ""))
    outcome = (
        F.when(~F.regexp_replace("q_stream", r"\.dlq$", "").isin(STREAMS), "unknown stream").when(F.col("event_stream_id").isNull(), "no entry")
        .when(F.json_object_keys("payload").isNull(), "payload").when(~target.isin(STREAMS), "unknown target").otherwise("requeued")
    )
    return rows.select(F.col("q_stream").alias("stream"), F.col("q_id").alias("event_stream_id"), target.alias("target"), outcome.alias("outcome"))


def requeue(letters: DataFrame, requests: DataFrame, requested_by: str, note: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """What executing dlq_requeue appends: (stream, payload) to the target streams, and audit rows to {stream}.requeued.

    Without executing it, dlq_requeue is the plan alone.
    """
    plan = dlq_requeue(letters, requests).where("outcome = 'requeued'").select(F.col("stream").alias("q_stream"), F.col("event_stream_id").alias("q_id"), "target")
    both = plan.join(letters, (F.col("q_stream") == F.col("stream")) & (F.col("q_id") == F.col("event_stream_id")))
    audit = both.select(
        F.concat("q_stream", F.lit(".requeued")).alias("stream"), at.alias("occurred_at"), F.col("q_stream").alias("dlq_stream"), F.col("q_id").alias("dlq_entry_id"), F.col("target").alias("target_stream"),
        F.lit(requested_by).alias("requested_by"), F.lit(note).alias("note"), F.col("event_type").alias("payload_event_type"), F.col("event_id").alias("payload_event_id"),
    )
    return both.select(F.col("target").alias("stream"), "payload"), audit


def backlog(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("event_type").alias("stream")).agg(F.count("*").alias("n"))


def scan_events(events: DataFrame, stream: str, offset: int, count: int) -> DataFrame:
    """At most `count` events of a stream after an offset."""
    return events.where((F.col("event_type") == stream) & (F.col("stream_offset") > offset)).orderBy("stream_offset").limit(count)


#: Ranges that a scenario's values are cut into before one of them is sorted.
RANGES = 256


def exact_ranks(samples: DataFrame, by: str, value: str, ranks: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """(by, a column for each of `ranks`): of each group's values in order, those at the given places.

    A rank counts from 0 and may use the column n, the group's size. Approximate
    quantiles cut a group into ranges, whose counts say in which range a rank
    lies; only the values of those ranges are sorted, so no group is sorted in
    one task. The bounds change the cost, not the result; equal values are
    counted first; null values don't count; a group of nulls has none.
    """
    values = samples.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("k"))
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    bounds = samples.groupBy(F.col(by).alias("b_g")).agg(F.percentile_approx(value, shares, F.lit(10 * ranges)).alias("bounds"))
    rows = values.join(bounds, F.col("g").eqNullSafe(F.col("b_g")))
    rows = rows.select("g", "v", "k", F.size(F.filter("bounds", lambda x: x < F.col("v"))).alias("r"))
    counts = rows.groupBy("g", "r").agg(F.sum("k").alias("held"))  # `ranges` rows a group at most
    whole = Window.partitionBy("g")
    counts = counts.withColumn("n", F.sum("held").over(whole)).withColumn("before", F.sum("held").over(whole.orderBy("r")) - F.col("held"))
    wanted = counts.select("g", "r", "before", "held", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), c.cast("long").alias("rank")) for name, c in ranks.items()])).alias("w"))
    wanted = wanted.where((F.col("w.rank") >= F.col("before")) & (F.col("w.rank") < F.col("before") + F.col("held")))
    wanted = wanted.groupBy(F.col("g").alias("w_g"), F.col("r").alias("w_r")).agg(F.first("before").alias("before"), F.collect_list("w").alias("ws"))
    inside = rows.join(wanted, F.col("g").eqNullSafe(F.col("w_g")) & (F.col("r") == F.col("w_r")))
    upto = F.col("before") + F.sum("k").over(Window.partitionBy("g", "r").orderBy("v"))
    inside = inside.withColumn("upto", upto)  # before the explosion, else rows would be summed once for each rank
    inside = inside.select("g", "v", "k", "upto", F.explode("ws").alias("w")).where((F.col("w.rank") < F.col("upto")) & (F.col("w.rank") >= F.col("upto") - F.col("k")))
    return inside.groupBy(F.col("g").alias(by)).agg(*[F.max(F.when(F.col("w.name") == name, F.col("v"))).alias(name) for name in ranks])


def latency_report(samples: DataFrame) -> DataFrame:
    """Per scenario n, ok, errors, the first five errors, p50 (median) and p95 (nearest rank, half to even) of all calls, failed ones too.

    Samples have scenario, iteration, latency_ms, error; with a column
    started_ms there is also ok_per_second, over the time from the first start
    to the last end. No scenario is sorted in one task.
    """
    n = F.col("n")
    ranks = {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "p95": F.bround(F.lit(0.95) * (n - 1))}
    p = exact_ranks(samples, "scenario", "latency_ms", ranks).select(F.col("scenario").alias("g"), ((F.col("low") + F.col("high")) / 2).alias("p50"), "p95")
    first = Window.partitionBy("scenario").orderBy("iteration")
    bad = samples.where("error is not null").select("scenario", "error", F.row_number().over(first).alias("_r")).where("_r <= 5")
    five = bad.groupBy(F.col("scenario").alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "error"))), lambda x: x["error"]), "|").alias("first_errors"))
    ok = F.count_if(F.col("error").isNull())
    more = []
    if "started_ms" in samples.columns:
        seconds = (F.max(F.col("started_ms") + F.col("latency_ms")) - F.min("started_ms")) / 1000
        more = [F.round(ok / F.greatest(seconds, F.lit(1e-6)), 2).alias("ok_per_second")]
    total = samples.groupBy("scenario").agg(F.count("*").alias("n"), ok.alias("ok"), F.count_if(F.col("error").isNotNull()).alias("errors"), *more)
    return total.join(p, F.col("scenario").eqNullSafe(F.col("g")), "left").join(five, F.col("scenario").eqNullSafe(F.col("b")), "left").drop("g", "b")


def _judged(docs: DataFrame, results: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions on known documents with their outcome."""
    known = results.select(F.col("document_id").alias("r_id")).distinct()
    rows = decisions.join(docs.select(F.col("id").alias("doc")), F.col("document_id") == F.col("doc"), "left_semi").join(known, F.col("document_id") == F.col("r_id"), "left")
    no_notes = F.coalesce(X.strip_space(F.col("notes")) == "", F.lit(True))
    outcome = F.when(~F.col("decision").isin("approved", "rejected", "corrected"), "invalid decision").when(F.col("r_id").isNull(), "no extraction").when((F.col("decision") == "rejected") & no_notes, "notes required").otherwise("accepted")
    return rows.withColumn("outcome", outcome).drop("r_id")


def apply_decisions(docs: DataFrame, results: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions with outcome and the status that follows: refused if unknown, without extraction, or rejecting without notes."""
    outcome = F.col("outcome")
    status = F.when(outcome != "accepted", None).when(F.col("decision") == "approved", "APPROVED").when(F.col("decision") == "rejected", "REJECTED").otherwise("VALIDATION_PENDING")
    return _judged(docs, results, decisions).select("document_id", "seq", "decision", "outcome", status.alias("new_status"))


def apply_corrections(docs: DataFrame, results: DataFrame, versions: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions and results after the accepted decisions (document_id, seq, decision, notes, corrected_fields: map) of each document in turn.

    A decision with corrected fields, whatever it decides, makes a version of
    them and settles the review of its document's result.
    """
    from .versions import correct_in_turn

    told = decisions.where(F.size("corrected_fields") > 0)
    rows = _judged(docs, results, told).where("outcome = 'accepted'").select("document_id", "seq", F.col("corrected_fields").alias("fields"))
    after, synced = correct_in_turn(versions, rows, results)
    settled = rows.select(F.col("document_id").alias("s_id")).distinct()
    synced = synced.join(settled, F.col("document_id") == F.col("s_id"), "left").withColumn("requires_human_validation", F.col("requires_human_validation") & F.col("s_id").isNull()).drop("s_id")
    return after, synced


def extraction_status(df: DataFrame, on_demand: bool = False) -> DataFrame:
    """df (status, requires_human_validation) with next_status; on demand, decided and waiting documents keep theirs."""
    after = F.when(F.col("requires_human_validation"), "VALIDATION_PENDING").otherwise("EXTRACTION_COMPLETED")
    held = F.col("status").isin("VALIDATION_PENDING", "APPROVED", "REJECTED") if on_demand else F.lit(False)
    return df.withColumn("next_status", F.when(held, F.col("status")).otherwise(after))


def erp_request(docs: DataFrame, settings: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """(document_id, idempotency_key, connector, status, retry_count, next_status) of approved documents whose tenant exports; a request made before starts anew."""
    on = settings.where("approved_export_enabled").select(F.col("tenant_id").alias("s_tenant"), "connector")
    rows = docs.where("status = 'APPROVED'").join(on, F.col("tenant_id") == F.col("s_tenant"))
    key = F.concat_ws(":", "tenant_id", "id", F.lit("erp"), F.lit("v1"))
    rows = rows.select(F.col("id").alias("document_id"), key.alias("idempotency_key"), "connector", F.lit("requested").alias("status"), F.lit("ERP_INTEGRATION_REQUESTED").alias("next_status"))
    if attempts is None:
        return rows.withColumn("retry_count", F.lit(0).cast("long"))
    old = attempts.groupBy(F.col("idempotency_key").alias("o_key")).agg(F.count("*").alias("retry_count"))
    return rows.join(old, F.col("idempotency_key") == F.col("o_key"), "left").withColumn("retry_count", F.coalesce("retry_count", F.lit(0).cast("long"))).drop("o_key")


def erp_attempts(events: DataFrame) -> DataFrame:
    """Last answer of each idempotency key: (idempotency_key, document_id, status, external_id, reason, answers)."""
    rows = dedupe_events(events.where(F.col("event_type").isin("erp.sent", "erp.failed"))).withColumn("idempotency_key", F.concat_ws(":", "tenant_id", "document_id", F.lit("erp"), F.lit("v1")))
    last = F.max(F.struct("occurred_at", "event_id", "event_type", "document_id")).alias("l")
    rows = rows.groupBy("idempotency_key").agg(last, F.count("*").alias("answers"))
    sent = F.col("l.event_type") == "erp.sent"
    return rows.select("idempotency_key", F.col("l.document_id").alias("document_id"), F.when(sent, "sent").otherwise("failed").alias("status"), F.when(sent, F.col("l.event_id")).alias("external_id"), F.when(~sent, "erp error").alias("reason"), "answers")


def export_approved(docs: DataFrame, results: DataFrame, settings: DataFrame) -> DataFrame:
    """(tenant_id, document_id, status, payload) of approved documents whose tenant exports; write partitioned by tenant."""
    from .inbox import canonical_payload

    on = settings.where("approved_export_enabled").select(F.col("tenant_id").alias("s_tenant"))
    rows = docs.where("status = 'APPROVED'").join(on, F.col("tenant_id") == F.col("s_tenant"), "left_semi")
    payload = canonical_payload(rows, results).withColumnRenamed("document_id", "p_id")
    return rows.join(payload, F.col("id") == F.col("p_id")).select("tenant_id", F.col("id").alias("document_id"), "status", "payload")
