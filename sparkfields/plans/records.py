"""Queries of the inbox, the event log, decisions and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import contracts, events, inbox, versions
from .fixtures import table, view
from .registry import Registry

query = Registry()


@query("SELECT id, status FROM fx_documents WHERE status IN ('APPROVED', 'REJECTED')")
def b03_filter_status(spark: SparkSession, d: str) -> DataFrame:
    return inbox.filter_status(view(spark, d, "fx_documents"), " APPROVED, ,REJECTED").select("id", "status")


_INBOX = """SELECT d.id, d.status, d.channel, r.schema_id, e.decision_date, e.approved_at, e.rejected_at, e.rejection_notes FROM fx_documents AS d LEFT JOIN fx_results AS r ON d.id = r.document_id LEFT JOIN (
  SELECT document_id, max(created_at) AS decision_date, max(CASE WHEN decision = 'approved' THEN created_at END) AS approved_at, max(CASE WHEN decision = 'rejected' THEN created_at END) AS rejected_at,
    arg_max(notes, seq) FILTER (WHERE decision = 'rejected') AS rejection_notes FROM fx_decisions GROUP BY document_id) AS e ON d.id = e.document_id"""


@query("""SELECT d.id FROM fx_documents AS d LEFT JOIN fx_results AS r ON d.id = r.document_id
WHERE contains(lower(original_filename), 'pendente') OR contains(lower(status), 'pendente') OR contains(lower(coalesce(fields, '')), 'pendente') OR contains(lower(document_type), 'pendente') OR contains(lower(channel), 'pendente')
  OR status IN ('RECEIVED', 'OCR_COMPLETED', 'EXTRACTION_COMPLETED', 'VALIDATION_PENDING')""")
def b04_search_documents(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "fx_results").select(F.col("document_id").alias("r_id"), "fields")
    rows = view(spark, d, "fx_documents").join(r, F.col("id") == F.col("r_id"), "left")
    return inbox.search_documents(rows, " Pendente ").select("id")


@query("SELECT id, CASE status WHEN 'APPROVED' THEN 'Aprovado' WHEN 'REJECTED' THEN 'Rejeitado' ELSE 'Pendente' END AS label FROM fx_documents WHERE tenant_id = 'NATION_3'")
def b05_b06_tenant_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = inbox.filter_tenant(view(spark, d, "fx_documents"), "NATION_3")
    return rows.select("id", inbox.status_label(F.col("status")).alias("label"))


@query("SELECT document_id, CAST(CASE WHEN json_extract_string(fields, '$.nota') = '' THEN 2 ELSE 3 END AS BIGINT) AS n FROM fx_results")
def b07_clean_fields(spark: SparkSession, d: str) -> DataFrame:
    fields = inbox.clean_fields(F.from_json("fields", "map<string,string>"))
    return view(spark, d, "fx_results").select("document_id", F.size(fields).cast("long").alias("n"))


_FIELD_ROWS = """SELECT document_id, 'valor' AS name, json_extract_string(fields, '$.valor.value') AS value, CAST(json_extract_string(fields, '$.valor.confidence') AS DOUBLE) AS confidence FROM fx_results WHERE schema_id <> 'legacy_ocr'
UNION ALL SELECT document_id, 'cliente', json_extract_string(fields, '$.cliente'), NULL FROM fx_results WHERE schema_id <> 'legacy_ocr'
UNION ALL SELECT document_id, 'nota', json_extract_string(fields, '$.nota'), NULL FROM fx_results WHERE schema_id <> 'legacy_ocr' AND json_extract_string(fields, '$.nota') NOT IN ('', 'Valor não encontrado')"""


@query(_FIELD_ROWS)
def b08_field_rows(spark: SparkSession, d: str) -> DataFrame:
    return inbox.field_rows(view(spark, d, "fx_results"))


@query("""SELECT d.id AS document_id, r.schema_id, r.schema_version, json_extract_string(r.fields, '$.cliente') AS cliente, d.channel, d.tenant_id, 'local://documents/' || tenant_id || '/' || id || '/original' AS file_uri, CASE WHEN o_orderkey % 2 = 0 THEN 'local://texts/' || id END AS raw_text_uri,
  'channel,file_uri,raw_text_uri' AS source_keys FROM fx_documents AS d LEFT JOIN fx_results AS r ON d.id = r.document_id""")
def b09_canonical_payload(spark: SparkSession, d: str) -> DataFrame:
    docs = view(spark, d, "fx_documents").withColumn("file_uri", X.object_uri(X.object_key(F.col("tenant_id"), F.col("id")))).withColumn("raw_text_uri", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("local://texts/"), "id")))
    p = inbox.canonical_payload(docs, view(spark, d, "fx_results"))
    get = lambda path, name: F.get_json_object("payload", path).alias(name)
    keys = F.array_join(F.json_object_keys(F.get_json_object("payload", "$.source")), ",").alias("source_keys")
    return p.select("document_id", get("$.schema_id", "schema_id"), get("$.schema_version", "schema_version"), get("$.fields.cliente", "cliente"), get("$.source.channel", "channel"), get("$.tenant_id", "tenant_id"), get("$.source.file_uri", "file_uri"), get("$.source.raw_text_uri", "raw_text_uri"), keys)


@query("""SELECT id, nullif(json_extract_string(metadata, '$.metadata_channel'), '') AS channel_name, concat('{"extraction":"', channel, '","metadata_channel":"', json_extract_string(metadata, '$.metadata_channel'), '","ocr":"', status, '"}') AS merged FROM fx_documents""")
def b10_b11_metadata(spark: SparkSession, d: str) -> DataFrame:
    right = F.concat(F.lit('{"extraction":"'), "channel", F.lit('","ocr":"'), "status", F.lit('"}'))
    return view(spark, d, "fx_documents").select("id", inbox.channel_metadata(F.col("metadata")).alias("channel_name"), inbox.merge_metadata(F.col("metadata"), right).alias("merged"))


VALID = """SELECT *, CASE WHEN event_type NOT IN ('document.received', 'ocr.completed', 'extraction.completed', 'erp.sent', 'erp.failed') THEN 'unknown event type' WHEN event_version <> 'v1' THEN 'event_version' WHEN trim(tenant_id) = '' THEN 'tenant_id'
  WHEN confidence > 1 OR confidence < 0 THEN 'confidence' END AS error FROM fx_events"""


@query(f"SELECT stream_offset, error IS NULL AS is_valid, error FROM ({VALID}) AS v")
def b12_validate_events(spark: SparkSession, d: str) -> DataFrame:
    return events.validate_events(view(spark, d, "fx_events")).select("stream_offset", "is_valid", "error")


def _contract_sql() -> str:
    """The contracts as rows, each event's fields looked up one by one, and the first broken rule in order."""
    rows, text = [], lambda x: "NULL" if x is None else f"'{x}'"
    for kind, own in contracts.DATA.items():
        fields = contracts.BASE + own
        for k, f in enumerate(fields):
            parent = f.path.rpartition(".")[0]
            rows.append(f"('{kind}', {k}, '$.{f.path}', '{'$.' + parent if parent else '$'}', '{f.path}', '{f.kind}', {f.required}, {f.nullable}, {text(f.least)}::DOUBLE, {text(f.most)}::DOUBLE, [{', '.join(text(c) for c in f.choices)}]::VARCHAR[])")
    return f"""WITH c(event_type, k, path, parent, name, kind, required, nullable, least, most, choices) AS (VALUES {", ".join(rows)}),
p AS (SELECT seq, payload, CASE WHEN json_valid(payload) THEN json_type(payload) END AS top, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.event_type') END AS event_type FROM fx_payloads),
f AS (SELECT p.seq, c.*, json_type(payload, path) AS j, json_extract_string(payload, path) AS t, json_type(payload, parent) AS pj, json_extract(payload, path) AS node FROM p JOIN c ON p.event_type = c.event_type WHERE top = 'OBJECT'),
g AS (SELECT *, j IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') AS is_number, j = 'VARCHAR' AS is_text, TRY_CAST(trim(t) AS DOUBLE) AS x FROM f),
b AS (SELECT seq, k, CASE
    WHEN j IS NULL THEN CASE WHEN required AND pj IS NOT NULL THEN name || ': missing' END
    WHEN j = 'NULL' THEN CASE WHEN NOT nullable THEN name || ': null' END
    WHEN kind = 'strings' AND (j <> 'OBJECT' OR len(list_filter(json_keys(node), lambda y: json_type(node, '$."' || y || '"') <> 'VARCHAR')) > 0) THEN name || ': not strings'
    WHEN kind = 'string' AND NOT is_text THEN name || ': not string' WHEN kind = 'uuid' AND NOT (is_text AND regexp_matches(t, '{contracts.UUID}')) THEN name || ': not uuid'
    WHEN kind = 'int' AND NOT coalesce((is_text OR is_number) AND x = floor(x), false) THEN name || ': not int' WHEN kind = 'float' AND NOT ((is_text OR is_number) AND x IS NOT NULL) THEN name || ': not float'
    WHEN kind = 'bool' AND NOT (j = 'BOOLEAN' OR ((is_text OR is_number) AND lower(t) IN ({", ".join(f"'{x}'" for x in contracts.TRUTHS)}))) THEN name || ': not bool'
    WHEN kind IN ('time', 'zoned') AND NOT (is_number OR (is_text AND regexp_matches(t, '{contracts.TIME}') AND TRY_CAST(t AS TIMESTAMPTZ) IS NOT NULL)) THEN name || ': not time'
    WHEN kind IN ('object', 'map') AND j <> 'OBJECT' THEN name || ': not ' || kind
    WHEN kind = 'zoned' AND is_text AND NOT regexp_matches(t, '{contracts.ZONE}') THEN name || ': no zone' WHEN len(choices) > 0 AND NOT list_contains(choices, t) THEN name || ': not a choice'
    WHEN least IS NOT NULL AND CASE WHEN kind = 'string' THEN length(t) ELSE x END < least THEN name || ': below ' || CAST(CAST(least AS INT) AS VARCHAR)
    WHEN most IS NOT NULL AND CASE WHEN kind = 'string' THEN length(t) ELSE x END > most THEN name || ': above ' || CAST(CAST(most AS INT) AS VARCHAR) END AS error FROM g),
o AS (SELECT seq, 1000 AS k, 'event: unknown key' AS error FROM p WHERE top = 'OBJECT' AND len(list_filter(json_keys(payload), lambda y: y NOT IN ({", ".join(f"'{f.path}'" for f in contracts.BASE)}))) > 0
  UNION ALL SELECT seq, 1001 + CAST(path <> '$.data' AS INT), substr(path, 3) || ': unknown key' FROM (SELECT p.seq, q.path, unnest(json_keys(payload, q.path)) AS key, p.event_type FROM p, (VALUES ('$.data'), ('$.data.file')) AS q(path) WHERE top = 'OBJECT' AND json_type(payload, q.path) = 'OBJECT') AS u
  WHERE EXISTS (SELECT 1 FROM c WHERE c.event_type = u.event_type AND c.path = u.path) AND NOT EXISTS (SELECT 1 FROM c WHERE c.event_type = u.event_type AND c.path = u.path || '.' || u.key))
SELECT p.seq, CASE WHEN coalesce(top, '') <> 'OBJECT' THEN 'not an object' WHEN event_type IS NULL OR event_type NOT IN (SELECT event_type FROM c) THEN 'unknown event type' ELSE e.error END AS error
FROM p LEFT JOIN (SELECT seq, arg_min(error, k) AS error FROM (SELECT * FROM b UNION ALL SELECT * FROM o) AS x WHERE error IS NOT NULL GROUP BY seq) AS e ON p.seq = e.seq"""


@query(_contract_sql())
def b12_check_events(spark: SparkSession, d: str) -> DataFrame:
    """JSON events of all types against their contracts, each fault by turns."""
    return contracts.check_events(view(spark, d, "fx_payloads")).select("seq", "error")


@query("""SELECT c.document_id, c.seq, c.decision, CASE WHEN decision NOT IN ('approved', 'rejected', 'corrected') THEN 'invalid decision' WHEN r.document_id IS NULL THEN 'no extraction' WHEN decision = 'rejected' AND trim(notes) = '' THEN 'notes required' ELSE 'accepted' END AS outcome,
  CASE WHEN decision NOT IN ('approved', 'rejected', 'corrected') OR r.document_id IS NULL OR (decision = 'rejected' AND trim(notes) = '') THEN NULL WHEN decision = 'approved' THEN 'APPROVED' WHEN decision = 'rejected' THEN 'REJECTED' ELSE 'VALIDATION_PENDING' END AS new_status
FROM fx_decisions AS c JOIN fx_documents AS d ON c.document_id = d.id LEFT JOIN fx_results AS r ON r.document_id = d.id""")
def b13_apply_decisions(spark: SparkSession, d: str) -> DataFrame:
    return events.apply_decisions(view(spark, d, "fx_documents"), view(spark, d, "fx_results"), view(spark, d, "fx_decisions"))


@query("""SELECT d.id, CASE WHEN status IN ('VALIDATION_PENDING', 'APPROVED', 'REJECTED') THEN status WHEN requires_human_validation THEN 'VALIDATION_PENDING' ELSE 'EXTRACTION_COMPLETED' END AS next_status FROM fx_documents AS d JOIN fx_results AS r ON d.id = r.document_id""")
def b14_extraction_status(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "fx_results").select(F.col("document_id").alias("r_id"), "requires_human_validation")
    return events.extraction_status(view(spark, d, "fx_documents").join(r, F.col("id") == F.col("r_id")), on_demand=True).select("id", "next_status")


@query(_INBOX)
def c01_inbox(spark: SparkSession, d: str) -> DataFrame:
    rows = inbox.inbox(view(spark, d, "fx_documents"), view(spark, d, "fx_results"), view(spark, d, "fx_decisions"))
    return rows.select("id", "status", "channel", "schema_id", "decision_date", "approved_at", "rejected_at", "rejection_notes")


@query("""SELECT d.id, r.schema_id, v.version_number, e.n_events, e.event_types FROM fx_documents AS d LEFT JOIN fx_results AS r ON d.id = r.document_id
LEFT JOIN (SELECT document_id, max(version_number) AS version_number FROM fx_versions WHERE is_active GROUP BY document_id) AS v ON d.id = v.document_id
LEFT JOIN (SELECT concat('doc-', lpad(substr(document_id, 5), 8, '0')) AS doc, count(*) AS n_events, string_agg(event_type, ',' ORDER BY stream_offset) AS event_types FROM fx_events GROUP BY 1) AS e ON d.id = e.doc""")
def c02_detail(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "fx_events").withColumn("document_id", F.concat(F.lit("doc-"), F.lpad(F.substring("document_id", 5, 20), 8, "0")))
    rows = inbox.detail(view(spark, d, "fx_documents"), view(spark, d, "fx_results"), view(spark, d, "fx_versions"), e)
    return rows.select("id", "schema_id", "version_number", "n_events", "event_types")


_INCOMING = "SELECT concat('in-', id) AS id, tenant_id, original_filename, received_at FROM fx_documents WHERE o_orderkey % 3 = 0"


@query(f"""WITH i AS ({_INCOMING}), k AS (SELECT DISTINCT tenant_id, original_filename FROM fx_documents WHERE o_orderkey % 3 = 1)
SELECT i.id, CASE WHEN k.tenant_id IS NOT NULL OR row_number() OVER (PARTITION BY i.tenant_id, i.original_filename ORDER BY received_at, id) > 1 THEN 'duplicate' ELSE 'created' END AS outcome
FROM i LEFT JOIN k ON i.tenant_id = k.tenant_id AND i.original_filename = k.original_filename""")
def c05_new_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = view(spark, d, "fx_documents")
    incoming = docs.where("o_orderkey % 3 = 0").select(F.concat(F.lit("in-"), "id").alias("id"), "tenant_id", "original_filename", "received_at")
    return events.new_documents(incoming, docs.where("o_orderkey % 3 = 1")).select("id", "outcome")


_HISTORY = """SELECT document_id, version_number, lag(version_number) OVER (PARTITION BY document_id ORDER BY version_number) AS previous_version, n_fields, confidence, is_active, count(*) OVER (PARTITION BY document_id) AS n_versions
FROM (SELECT document_id, version_number, count(*) AS n_fields, round(avg(confidence), 4) AS confidence, bool_or(is_active) AS is_active FROM fx_versions GROUP BY document_id, version_number) AS v"""


@query(_HISTORY)
def c09_version_history(spark: SparkSession, d: str) -> DataFrame:
    return versions.version_history(view(spark, d, "fx_versions"))


_DLQ = f"SELECT concat(event_type, '.dlq') AS stream, stream_offset AS event_stream_id, event_type, event_id, error FROM ({VALID}) AS v WHERE error IS NOT NULL"


@query(f"""WITH l AS ({_DLQ}), q AS (SELECT stream, event_stream_id, CASE event_stream_id % 4 WHEN 0 THEN 'nowhere' WHEN 1 THEN 'erp.sent' END AS target FROM l UNION ALL SELECT 'erp.sent.dlq', -1, NULL)
SELECT q.stream, q.event_stream_id, coalesce(q.target, replace(q.stream, '.dlq', '')) AS target,
  CASE WHEN q.stream = 'bogus.event.dlq' THEN 'unknown stream' WHEN q.event_stream_id = -1 THEN 'no entry' WHEN q.target = 'nowhere' THEN 'unknown target' ELSE 'requeued' END AS outcome FROM q""")
def c11_dlq_requeue(spark: SparkSession, d: str) -> DataFrame:
    _, letters = events.route_dlq(view(spark, d, "fx_events"))
    target = F.when(F.col("event_stream_id") % 4 == 0, "nowhere").when(F.col("event_stream_id") % 4 == 1, "erp.sent")
    asks = letters.select("stream", "event_stream_id", target.alias("target"))
    return events.dlq_requeue(letters, asks.unionByName(spark.sql("select 'erp.sent.dlq' as stream, -1L as event_stream_id, cast(null as string) as target")))


@query(f"""WITH l AS ({_DLQ}) SELECT concat(stream, '.requeued') AS stream, event_stream_id AS dlq_entry_id, CASE WHEN event_stream_id % 2 = 0 THEN 'erp.sent' ELSE replace(stream, '.dlq', '') END AS target_stream,
  'ops' AS requested_by, event_type AS payload_event_type, event_id AS payload_event_id, event_id AS requeued_event_id FROM l WHERE stream <> 'bogus.event.dlq'""")
def c11_requeue_audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit rows of executed requests, each with the id of what was published again."""
    _, letters = events.route_dlq(view(spark, d, "fx_events"))
    asks = letters.select("stream", "event_stream_id", F.when(F.col("event_stream_id") % 2 == 0, "erp.sent").alias("target"))
    again, audit = events.requeue(letters, asks, "ops", "", F.lit("2024-01-02T03:04:05Z"))
    sent = again.select("stream", F.get_json_object("payload", "$.event_id").alias("requeued_event_id")).distinct()
    out = audit.join(sent, (audit["target_stream"] == sent["stream"]) & (F.col("payload_event_id") == F.col("requeued_event_id"))).drop(sent["stream"])
    return out.select("stream", "dlq_entry_id", "target_stream", "requested_by", "payload_event_type", "payload_event_id", "requeued_event_id")


@query(f"""WITH l AS ({_DLQ}) SELECT CASE WHEN l.event_stream_id % 2 = 0 THEN 'erp.sent' ELSE replace(stream, '.dlq', '') END AS stream, e.* FROM l JOIN fx_events AS e ON e.stream_offset = l.event_stream_id WHERE stream <> 'bogus.event.dlq'""")
def c11_requeued_events(spark: SparkSession, d: str) -> DataFrame:
    """What requeueing publishes again, read back: the whole events as they first came."""
    rows = view(spark, d, "fx_events")
    _, letters = events.route_dlq(rows)
    asks = letters.select("stream", "event_stream_id", F.when(F.col("event_stream_id") % 2 == 0, "erp.sent").alias("target"))
    again, _ = events.requeue(letters, asks, "ops", "", F.lit("2024-01-02T03:04:05Z"))
    return again.select("stream", F.from_json("payload", rows.schema, events.JSON_TIMES).alias("e")).select("stream", "e.*")


@query("SELECT document_id, 1 AS version_number FROM fx_results WHERE document_id NOT IN (SELECT document_id FROM fx_versions)")
def c12_backfill_versions(spark: SparkSession, d: str) -> DataFrame:
    return versions.backfill_versions(view(spark, d, "fx_results"), view(spark, d, "fx_versions")).select("document_id", "version_number")


def settings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_name").alias("tenant_id"), (F.col("n_nationkey") % 2 == 0).alias("approved_export_enabled"), F.concat(F.lit("erp-"), F.col("n_regionkey").cast("string")).alias("connector"))


@query("""SELECT id AS document_id, concat(tenant_id, ':', id, ':erp:v1') AS idempotency_key, concat('erp-', n_regionkey) AS connector, 'requested' AS status, 'ERP_INTEGRATION_REQUESTED' AS next_status, CAST(0 AS BIGINT) AS retry_count
FROM fx_documents JOIN nation ON tenant_id = n_name WHERE status = 'APPROVED' AND n_nationkey % 2 = 0""")
def c14_erp_request(spark: SparkSession, d: str) -> DataFrame:
    return events.erp_request(view(spark, d, "fx_documents"), settings(spark, d))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE status = 'APPROVED') AS approved, count(*) FILTER (WHERE status = 'REJECTED') AS failed, count(*) FILTER (WHERE status NOT IN ('APPROVED', 'REJECTED')) AS pending FROM fx_documents")
def d01_dashboard_metrics(spark: SparkSession, d: str) -> DataFrame:
    return inbox.dashboard_metrics(view(spark, d, "fx_documents"))


@query("SELECT status, count(*) AS n FROM fx_documents GROUP BY status")
def d02_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return inbox.status_counts(view(spark, d, "fx_documents"))


@query(f"WITH l AS ({_DLQ}), n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY event_stream_id) AS k FROM l) SELECT stream, count(*) AS total, count(*) FILTER (WHERE k <= 50) AS n, max(event_stream_id) FILTER (WHERE k <= 50) AS last_id, arg_max(error, event_stream_id) FILTER (WHERE k <= 50) AS last_error FROM n GROUP BY stream")
def d05_dlq_summary(spark: SparkSession, d: str) -> DataFrame:
    return events.dlq_summary(events.route_dlq(view(spark, d, "fx_events"))[1])


_SAMPLES = "SELECT event_type AS scenario, event_id AS iteration, value AS latency_ms, epoch_ms(ts) AS started_ms, CASE WHEN event_id % 19 = 0 THEN concat('e', cast(event_id as string)) END AS error FROM events"


@query(f"""WITH s AS ({_SAMPLES}), g AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY latency_ms, iteration) - 1 AS r, count(*) OVER (PARTITION BY scenario) AS n FROM s),
b AS (SELECT scenario, error, iteration, row_number() OVER (PARTITION BY scenario ORDER BY iteration) AS r FROM s WHERE error IS NOT NULL)
SELECT t.scenario, t.n, t.ok, t.errors, t.ok_per_second, p.p50, p.p95, f.first_errors FROM (SELECT scenario, count(*) AS n, count(*) FILTER (WHERE error IS NULL) AS ok, count(error) AS errors,
  round(count(*) FILTER (WHERE error IS NULL) / greatest((max(started_ms + latency_ms) - min(started_ms)) / 1000, 1e-6), 2) AS ok_per_second FROM s GROUP BY scenario) AS t
LEFT JOIN (SELECT scenario, median(latency_ms) AS p50, max(latency_ms) FILTER (WHERE r = round_even(0.95 * (n - 1), 0)) AS p95 FROM g GROUP BY scenario) AS p ON t.scenario = p.scenario
LEFT JOIN (SELECT scenario, string_agg(error, '|' ORDER BY iteration) AS first_errors FROM b WHERE r <= 5 GROUP BY scenario) AS f ON t.scenario = f.scenario""")
def d06_latency_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    error = F.when(F.col("event_id") % 19 == 0, F.concat(F.lit("e"), F.col("event_id").cast("string")))
    return events.latency_report(e.select(F.col("event_type").alias("scenario"), F.col("event_id").alias("iteration"), F.col("value").alias("latency_ms"), F.unix_millis(F.col("ts").cast("timestamp")).alias("started_ms"), error.alias("error")))


@query("SELECT event_type AS stream, count(*) AS n FROM fx_events GROUP BY event_type")
def d07_backlog(spark: SparkSession, d: str) -> DataFrame:
    return events.backlog(view(spark, d, "fx_events"))


@query("SELECT document_id, version_number, round(avg(confidence), 4) AS confidence FROM fx_versions GROUP BY document_id, version_number")
def d08_version_confidence(spark: SparkSession, d: str) -> DataFrame:
    return inbox.version_confidence(view(spark, d, "fx_versions"), "document_id", "version_number")


@query("""SELECT document_id, max(created_at) AS decision_date, max(CASE WHEN decision = 'approved' THEN created_at END) AS approved_at, max(CASE WHEN decision = 'rejected' THEN created_at END) AS rejected_at,
  arg_max(notes, seq) FILTER (WHERE decision = 'rejected') AS rejection_notes FROM fx_decisions GROUP BY document_id""")
def e01_latest_decisions(spark: SparkSession, d: str) -> DataFrame:
    return inbox.latest_decisions(view(spark, d, "fx_decisions"))


@query("""SELECT d.id AS document_id, v.active_version, coalesce(v.top, 0) + 1 AS next_number, CASE WHEN v.top IS NULL THEN 'INITIAL_EXTRACTION' ELSE 'REPROCESSING' END AS source_type
FROM fx_documents AS d LEFT JOIN (SELECT document_id, max(version_number) AS top, max(version_number) FILTER (WHERE is_active) AS active_version FROM fx_versions GROUP BY document_id) AS v ON d.id = v.document_id""")
def e02_next_version(spark: SparkSession, d: str) -> DataFrame:
    return versions.next_version(view(spark, d, "fx_documents"), view(spark, d, "fx_versions"))


@query("SELECT event_id, min(stream_offset) AS stream_offset FROM fx_events GROUP BY event_id")
def e03_dedupe_events(spark: SparkSession, d: str) -> DataFrame:
    return events.dedupe_events(view(spark, d, "fx_events")).select("event_id", "stream_offset")


@query("SELECT id, row_number() OVER (PARTITION BY tenant_id, sha256 ORDER BY received_at, id) > 1 AS is_duplicate FROM fx_documents")
def e04_dedupe_content(spark: SparkSession, d: str) -> DataFrame:
    return events.dedupe_content(view(spark, d, "fx_documents"), ["tenant_id", "sha256"], ["received_at", "id"]).select("id", "is_duplicate")


@query("""WITH a AS (SELECT document_id, max(version_number) AS active FROM fx_versions GROUP BY document_id), q AS (SELECT document_id, max(value) FILTER (WHERE name = 'quantidade') AS q, count(*) AS n FROM fx_versions WHERE is_active GROUP BY document_id)
SELECT a.document_id, e AS edit_no, CASE WHEN e = 1 AND active % 3 = 0 THEN 'conflict' WHEN e = 1 THEN 'saved' WHEN e = 2 AND active % 3 <> 0 THEN 'conflict' WHEN e = 2 THEN 'empty' ELSE 'conflict' END AS outcome, CASE WHEN e = 1 AND active % 3 <> 0 THEN active + 1 END AS new_version
FROM a CROSS JOIN (SELECT unnest([1, 2, 3]) AS e) AS t""")
def e06_apply_manual_edits(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "fx_versions")
    top = v.groupBy("document_id").agg(F.max("version_number").alias("top"))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), F.lit(value).alias("value"))
    edits = F.array(
        F.struct(F.lit(1).alias("edit_no"), F.when(F.col("top") % 3 == 0, F.col("top") - 1).otherwise(F.col("top")).alias("base_version"), F.array(pair(" novo ", "1"), pair("novo", "2"), pair(" ", "x")).alias("fields")),
        F.struct(F.lit(2).alias("edit_no"), F.col("top").alias("base_version"), F.array(pair("", "x")).alias("fields")),
        F.struct(F.lit(3).alias("edit_no"), (F.col("top") + 7).alias("base_version"), F.array(pair("a", "x")).alias("fields")),
    )
    return versions.apply_manual_edits(v, top.select("document_id", F.inline(edits))).select("document_id", "edit_no", "outcome", "new_version")


def _edits(spark: SparkSession, d: str) -> DataFrame:
    top = view(spark, d, "fx_versions").groupBy("document_id").agg(F.max("version_number").alias("top"))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), F.lit(value).alias("value"))
    base = F.when(F.col("top") % 3 == 0, F.col("top") - 1).otherwise(F.col("top")).alias("base_version")
    return top.select("document_id", F.lit(1).alias("edit_no"), base, F.array(pair(" novo ", "1"), pair("novo", "2"), pair(" ", "x")).alias("fields"))


_SAVED = "WITH t AS (SELECT document_id, max(version_number) AS top FROM fx_versions GROUP BY document_id), s AS (SELECT * FROM t WHERE top % 3 <> 0)"


@query(_SAVED + """ SELECT v.document_id, version_number, name, value, CAST(confidence AS DOUBLE) AS confidence, is_active AND s.top IS NULL AS is_active, CAST(NULL AS INT) AS previous_version, CAST(NULL AS VARCHAR) AS source_type FROM fx_versions AS v LEFT JOIN s ON v.document_id = s.document_id
UNION ALL SELECT document_id, top + 1, 'novo', '2', 1.0, true, top, 'MANUAL_EDIT' FROM s""")
def e06_saved_versions(spark: SparkSession, d: str) -> DataFrame:
    """All versions after one edit of each document."""
    v = view(spark, d, "fx_versions").withColumn("confidence", F.col("confidence").cast("double"))
    return versions.save_edits(v, _edits(spark, d), view(spark, d, "fx_results"))[0]


@query(_SAVED + """ SELECT r.document_id, CASE WHEN s.top IS NULL THEN fields ELSE '{"novo":{"value":"2","confidence":1.0}}' END AS fields, CASE WHEN s.top IS NULL THEN r.confidence ELSE 1.0 END AS confidence, requires_human_validation FROM fx_results AS r LEFT JOIN s ON r.document_id = s.document_id""")
def e06_synced_results(spark: SparkSession, d: str) -> DataFrame:
    """The results in step with the edited versions."""
    v = view(spark, d, "fx_versions").withColumn("confidence", F.col("confidence").cast("double"))
    return versions.save_edits(v, _edits(spark, d), view(spark, d, "fx_results"))[1].select("document_id", "fields", F.col("confidence").cast("double").alias("confidence"), "requires_human_validation")


_CORRECTED = """WITH o AS (SELECT c.document_id, c.seq, CASE WHEN decision = 'corrected' OR (decision = 'approved' AND seq % 2 = 0) THEN CAST(CAST(corrected_value AS INT) % 3 AS VARCHAR) END AS q, CASE WHEN decision = 'approved' AND seq % 2 = 0 THEN '5' END AS i
  FROM fx_decisions AS c JOIN fx_documents AS d ON c.document_id = d.id JOIN fx_results AS r ON r.document_id = d.id WHERE decision IN ('approved', 'corrected') OR (decision = 'rejected' AND trim(notes) <> '')),
a AS (SELECT document_id, max(value) FILTER (WHERE name = 'quantidade') AS q0, max(value) FILTER (WHERE name = 'imposto') AS i0, max(confidence) FILTER (WHERE name = 'quantidade') AS qc, max(confidence) FILTER (WHERE name = 'imposto') AS ic, max(version_number) AS top FROM fx_versions WHERE is_active GROUP BY document_id),
e AS (SELECT document_id, seq, q, i FROM o WHERE q IS NOT NULL UNION ALL SELECT document_id, -1, q0, i0 FROM a),
g AS (SELECT *, q IS DISTINCT FROM lag(q) OVER w OR i IS DISTINCT FROM lag(i) OVER w AS fresh FROM e WINDOW w AS (PARTITION BY document_id ORDER BY seq)),
m AS (SELECT document_id, q, i, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS step FROM g WHERE seq >= 0 AND fresh),
n AS (SELECT m.*, a.*, bool_and(q = q0) OVER w AS own_q, bool_and(i IS NOT NULL AND i0 IS NOT NULL AND i = i0) OVER w AS own_i, max(step) OVER (PARTITION BY m.document_id) AS last FROM m JOIN a ON m.document_id = a.document_id WINDOW w AS (PARTITION BY m.document_id ORDER BY step)),
l AS (SELECT document_id, top + step AS version_number, 'quantidade' AS name, q AS value, CASE WHEN own_q THEN qc ELSE 1.0 END AS confidence, step = last AS is_active, top + step - 1 AS previous_version FROM n
  UNION ALL SELECT document_id, top + step, 'imposto', i, CASE WHEN own_i THEN ic ELSE 1.0 END, step = last, top + step - 1 FROM n WHERE i IS NOT NULL)"""


def _corrected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = view(spark, d, "fx_decisions")
    both, q = (F.col("decision") == "approved") & (F.col("seq") % 2 == 0), (F.col("corrected_value").cast("int") % 3).cast("string")
    fields = F.when(both, F.create_map(F.lit(" quantidade"), q, F.lit("imposto"), F.lit("5"))).when(F.col("decision") == "corrected", F.create_map(F.lit("quantidade"), q))
    v = view(spark, d, "fx_versions").withColumn("confidence", F.col("confidence").cast("double"))
    return events.apply_corrections(view(spark, d, "fx_documents"), view(spark, d, "fx_results"), v, c.withColumn("corrected_fields", fields))


@query(_CORRECTED + """ SELECT v.document_id, version_number, name, value, CAST(confidence AS DOUBLE) AS confidence, is_active AND n.document_id IS NULL AS is_active, CAST(NULL AS BIGINT) AS previous_version, CAST(NULL AS VARCHAR) AS source_type FROM fx_versions AS v LEFT JOIN (SELECT DISTINCT document_id FROM n) AS n ON v.document_id = n.document_id
UNION ALL SELECT document_id, version_number, name, value, CAST(confidence AS DOUBLE), is_active, previous_version, 'MANUAL_EDIT' FROM l""")
def b13_corrected_versions(spark: SparkSession, d: str) -> DataFrame:
    """All versions after the corrections of all accepted decisions in turn."""
    return _corrected(spark, d)[0]


@query(_CORRECTED + """ SELECT r.document_id, requires_human_validation AND NOT EXISTS (SELECT 1 FROM o WHERE q IS NOT NULL AND o.document_id = r.document_id) AS requires_human_validation, coalesce(c.confidence, r.confidence) AS confidence
FROM fx_results AS r LEFT JOIN (SELECT document_id, round(avg(CAST(confidence AS DOUBLE)), 4) AS confidence FROM l WHERE is_active GROUP BY document_id) AS c ON r.document_id = c.document_id""")
def b13_settled_results(spark: SparkSession, d: str) -> DataFrame:
    """The results that the corrections leave."""
    return _corrected(spark, d)[1].select("document_id", "requires_human_validation", F.col("confidence").cast("double").alias("confidence"))


@query("""SELECT d.id, coalesce(CASE WHEN template <> 7 THEN raw_text END, '') AS full_transcription, CASE WHEN template < 4 THEN 'f' ELSE '' END AS full_transcription_formatted, CASE WHEN template <> 7 AND template % 2 = 0 THEN 'docling' ELSE '' END AS engine_used, r.schema_id
FROM fx_documents AS d LEFT JOIN fx_invoices AS i ON d.o_orderkey = i.doc_id LEFT JOIN fx_results AS r ON r.document_id = d.id""")
def c02_transcription(spark: SparkSession, d: str) -> DataFrame:
    """Details with the recognised texts; some documents have none."""
    i, t = view(spark, d, "fx_invoices").where("template <> 7"), F.col("template")
    texts = i.select(F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("document_id"), "raw_text", F.when(t < 4, "f").alias("raw_text_formatted"), F.lit(None).cast("string").alias("document_type"), F.when(t % 2 == 0, "docling").alias("engine_used"))
    rows = inbox.detail(view(spark, d, "fx_documents"), view(spark, d, "fx_results"), view(spark, d, "fx_versions"), view(spark, d, "fx_events"), texts)
    return rows.select("id", "full_transcription", "full_transcription_formatted", "ocr_metadata.engine_used", "schema_id")


@query("""WITH v AS (SELECT document_id, version_number, name, value FROM fx_versions), t AS (SELECT document_id, max(version_number) AS top FROM v GROUP BY document_id)
SELECT coalesce(n.document_id, w.document_id) AS document_id, coalesce(n.version_number, w.version_number + 1) AS version_number, coalesce(n.name, w.name) AS name,
  CASE WHEN w.document_id IS NULL THEN 'added' WHEN n.document_id IS NULL THEN 'removed' WHEN n.value = w.value THEN 'same' ELSE 'changed' END AS change
FROM v AS n FULL JOIN v AS w ON n.document_id = w.document_id AND n.version_number = w.version_number + 1 AND n.name = w.name JOIN t ON t.document_id = coalesce(n.document_id, w.document_id) WHERE coalesce(n.version_number, w.version_number + 1) <= top""")
def e07_version_diff(spark: SparkSession, d: str) -> DataFrame:
    return versions.version_diff(view(spark, d, "fx_versions"))


STATE = f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY stream_offset) AS k FROM ({VALID}) AS x WHERE error IS NULL), b AS (SELECT document_id, min(occurred_at) AS born FROM v WHERE k = 1 AND event_type = 'document.received' GROUP BY document_id),
w AS (SELECT v.* FROM v JOIN b ON v.document_id = b.document_id WHERE k = 1 AND occurred_at >= born)
SELECT document_id, coalesce(arg_max(CASE event_type WHEN 'ocr.completed' THEN 'OCR_COMPLETED' WHEN 'extraction.completed' THEN CASE WHEN requires_human_validation THEN 'VALIDATION_PENDING' ELSE 'EXTRACTION_COMPLETED' END WHEN 'erp.sent' THEN 'ERP_SENT' WHEN 'erp.failed' THEN 'ERP_FAILED' END, occurred_at) FILTER (WHERE event_type <> 'document.received'), 'RECEIVED') AS status,
  count(*) AS n_events, min(occurred_at) FILTER (WHERE event_type = 'document.received') AS received_at, max(occurred_at) FILTER (WHERE event_type = 'ocr.completed') AS ocr_at, max(occurred_at) FILTER (WHERE event_type = 'extraction.completed') AS extracted_at,
  arg_max(requires_human_validation, occurred_at) FILTER (WHERE event_type = 'extraction.completed') AS needs_review, arg_max(event_type, occurred_at) FILTER (WHERE event_type LIKE 'erp.%') AS erp_status FROM w GROUP BY document_id"""


@query(STATE)
def e08_document_state(spark: SparkSession, d: str) -> DataFrame:
    return events.document_state(view(spark, d, "fx_events"))


@query(f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY stream_offset) AS k FROM ({VALID}) AS x WHERE error IS NULL), b AS (SELECT document_id, min(occurred_at) AS born FROM v WHERE k = 1 AND event_type = 'document.received' GROUP BY document_id)
SELECT event_type || '.dlq' AS stream, stream_offset AS event_stream_id, event_type, event_id, 'LookupError' AS error_type, 'document not found: ' || v.document_id AS error, tenant_id AS payload_tenant, value AS payload_value
FROM v LEFT JOIN b ON v.document_id = b.document_id WHERE k = 1 AND (born IS NULL OR occurred_at < born)""")
def e08_orphan_events(spark: SparkSession, d: str) -> DataFrame:
    """Dead letters of events before their document, with what their payload holds."""
    rows = view(spark, d, "fx_events")
    letters = events.orphan_events(rows)
    again = letters.select("stream", "event_stream_id", "error_type", "error", F.from_json("payload", rows.schema, events.JSON_TIMES).alias("e"))
    return again.select("stream", "event_stream_id", "e.event_type", "e.event_id", "error_type", "error", F.col("e.tenant_id").alias("payload_tenant"), F.col("e.value").alias("payload_value"))


@query("SELECT id, received_at FROM fx_documents WHERE status = 'APPROVED' ORDER BY received_at DESC, id LIMIT 25 OFFSET 25")
def f01_paginate(spark: SparkSession, d: str) -> DataFrame:
    return inbox.paginate(inbox.filter_status(view(spark, d, "fx_documents"), "APPROVED"), "2", 100)[0].select("id", "received_at")


@query("SELECT count(*) AS count, 3 AS page, 10 AS page_size, CAST(ceil(count(*) / 10.0) AS BIGINT) AS total_pages FROM fx_documents")
def f01_envelope(spark: SparkSession, d: str) -> DataFrame:
    return inbox.paginate(view(spark, d, "fx_documents"), 3, 10)[1]


@query("SELECT id, lower(coalesce(nullif(original_filename, ''), id)) AS sort_key FROM fx_documents")
def f02_sort_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = inbox.sort_documents(view(spark, d, "fx_documents"), "arquivo", descending=True)
    return rows.select("id", F.lower(F.coalesce(F.nullif("original_filename", F.lit("")), F.col("id"))).alias("sort_key"))


@query(f"""SELECT tenant_id || ':' || document_id || ':erp:v1' AS idempotency_key, arg_max(document_id, occurred_at) AS document_id, CASE WHEN arg_max(event_type, occurred_at) = 'erp.sent' THEN 'sent' ELSE 'failed' END AS status,
  CASE WHEN arg_max(event_type, occurred_at) = 'erp.sent' THEN arg_max(event_id, occurred_at) END AS external_id, CASE WHEN arg_max(event_type, occurred_at) <> 'erp.sent' THEN 'erp error' END AS reason, count(DISTINCT event_id) AS answers FROM fx_events WHERE event_type IN ('erp.sent', 'erp.failed') GROUP BY 1""")
def s06_erp_attempts(spark: SparkSession, d: str) -> DataFrame:
    return events.erp_attempts(view(spark, d, "fx_events"))


@query("SELECT tenant_id, id AS document_id, status, json_extract_string(r.fields, '$.cliente') AS cliente FROM fx_documents JOIN nation ON tenant_id = n_name LEFT JOIN fx_results AS r ON r.document_id = id WHERE status = 'APPROVED' AND n_nationkey % 2 = 0")
def a06_export_approved(spark: SparkSession, d: str) -> DataFrame:
    rows = events.export_approved(view(spark, d, "fx_documents"), view(spark, d, "fx_results"), settings(spark, d))
    return rows.select("tenant_id", "document_id", "status", F.get_json_object("payload", "$.fields.cliente").alias("cliente"))


@query("SELECT stream_offset, event_id FROM fx_events WHERE event_type = 'ocr.completed' AND stream_offset > 100 ORDER BY stream_offset LIMIT 25")
def a03_scan_events(spark: SparkSession, d: str) -> DataFrame:
    return events.scan_events(view(spark, d, "fx_events"), "ocr.completed", 100, 25).select("stream_offset", "event_id")


@query("SELECT event_id, stream_offset, 'documents/' || trim(tenant_id) || '/' || document_id || '/original' AS key, 'local://documents/' || trim(tenant_id) || '/' || document_id || '/original' AS uri FROM fx_events")
def x19_object_keys(spark: SparkSession, d: str) -> DataFrame:
    key = X.object_key(F.trim("tenant_id"), F.col("document_id"))
    return view(spark, d, "fx_events").select("event_id", "stream_offset", key.alias("key"), X.object_uri(key).alias("uri"))


QUERIES, SQL = query.queries, query.sql
