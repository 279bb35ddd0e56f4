"""Lists, searches, pages and counts over documents and their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .extract import PLACEHOLDER

# What the words of a search name, and who may be where.
PENDING = ["RECEIVED", "OCR_COMPLETED", "EXTRACTION_COMPLETED", "VALIDATION_PENDING"]
STATUS_WORDS = {"aprovado": ["APPROVED"], "aprovados": ["APPROVED"], "rejeitado": ["REJECTED"], "rejeitados": ["REJECTED"], "pendente": PENDING, "pendentes": PENDING}
PAGE, LIMIT, MOST = 25, 50, 500
LEGACY = "legacy_ocr"


def filter_status(df: DataFrame, csv: str | None) -> DataFrame:
    """Rows of the statuses listed; all if none is."""
    wanted = [s.strip() for s in (csv or "").split(",") if s.strip()]
    return df.where(F.col("status").isin(wanted)) if wanted else df


def search_documents(df: DataFrame, term: str | None) -> DataFrame:
    """Rows with the term, in any case, in the name, status, type, channel or fields, or whose status it names."""
    word = (term or "").strip().lower()
    if not word:
        return df
    hit = F.lit(False)
    for c in ("original_filename", "status", "document_type", "channel", "fields"):
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(word))
    return df.where(hit | F.col("status").isin(STATUS_WORDS.get(word, [])))


def filter_tenant(df: DataFrame, slug: str | None) -> DataFrame:
    return df.where(F.col("tenant_id") == slug) if slug else df


def status_label(status: Column) -> Column:
    return F.when(status == "APPROVED", "Aprovado").when(status == "REJECTED", "Rejeitado").otherwise("Pendente")


def clean_fields(fields: Column) -> Column:
    """A map without blank, null and empty values, and without a retention text of over 300 characters."""
    return F.map_filter(fields, lambda k, v: ~F.coalesce(v.isin("", "[]", "{}", "null"), F.lit(True)) & ~((k == "retencao") & (F.length(v) > 300)))


def field_rows(results: DataFrame) -> DataFrame:
    """(document_id, name, value, confidence) of the JSON column fields, whose entries are plain or {value, confidence}."""
    rows = results.where(F.col("schema_id") != LEGACY).select("document_id", F.explode(F.from_json("fields", "map<string,string>")).alias("name", "entry"))
    nested = F.col("entry").rlike(r"^\s*\{")
    rows = rows.select(
        "document_id", "name", F.when(nested, F.get_json_object("entry", "$.value")).otherwise(F.col("entry")).alias("value"), F.when(nested, F.get_json_object("entry", "$.confidence").try_cast("double")).alias("confidence")
    )
    return rows.where((X.strip_space(F.col("value")) != "") & (F.lower("value") != PLACEHOLDER.lower()))


def canonical_payload(docs: DataFrame, results: DataFrame) -> DataFrame:
    """(document_id, payload): what leaves for other systems, as JSON with keys in order, nulls too; no fields without an extraction.

    docs may have file_uri and raw_text_uri, else they are null.
    """
    r = results.select(F.col("document_id").alias("r_id"), "schema_id", "schema_version", "fields")
    rows = docs.join(r, F.col("id") == F.col("r_id"), "left")
    fields = F.coalesce(F.from_json("fields", "map<string,string>"), F.create_map().cast("map<string,string>"))
    uris = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("file_uri", "raw_text_uri")]
    payload = F.struct(F.col("id").alias("document_id"), fields.alias("fields"), "schema_id", "schema_version", F.struct("channel", *uris).alias("source"), "tenant_id")
    return rows.select(F.col("id").alias("document_id"), F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))


def merge_metadata(left: Column, right: Column) -> Column:
    """Two flat JSON objects as one; the right one wins; keys in order."""
    a, b = (F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")) for c in (left, right))
    kept = F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, b)))))


def channel_metadata(metadata: Column) -> Column:
    return F.nullif(F.get_json_object(metadata, "$.metadata_channel"), F.lit(""))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Per document the last decision's time, the last approval's and rejection's, and the rejection's notes; seq settles ties."""
    order = F.struct("created_at", "seq")
    last = lambda kind: F.max(F.when(F.col("decision") == kind, F.struct("created_at", "seq", "notes")))
    rows = decisions.groupBy("document_id").agg(F.max(order).alias("l"), last("approved").alias("a"), last("rejected").alias("r"))
    return rows.select("document_id", F.col("l.created_at").alias("decision_date"), F.col("a.created_at").alias("approved_at"), F.col("r.created_at").alias("rejected_at"), F.col("r.notes").alias("rejection_notes"))


def inbox(docs: DataFrame, results: DataFrame, decisions: DataFrame) -> DataFrame:
    """docs with their extraction and last decisions, newest first, ids in order among equals."""
    r = results.select(F.col("document_id").alias("r_id"), "schema_id", "fields", "confidence")
    e = latest_decisions(decisions).withColumnRenamed("document_id", "d_id")
    rows = docs.join(r, F.col("id") == F.col("r_id"), "left").join(e, F.col("id") == F.col("d_id"), "left").drop("r_id", "d_id")
    return rows.orderBy(F.desc("received_at"), "id")


def detail(docs: DataFrame, results: DataFrame, versions: DataFrame, events: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """docs with schema, active version, events in order (n_events, event_types, events), and of texts the transcription.

    texts has document_id, raw_text, raw_text_formatted, document_type and
    engine_used, as sources.files.scan_raw_text reads them; a document without
    one has empty transcriptions and an engine and a class of "".
    """
    v = versions.where("is_active").select(F.col("document_id").alias("v_id"), "version_number").distinct()
    whole = F.array_sort(F.collect_list(F.struct("stream_offset", "event_type", "event_id", "occurred_at")))
    e = events.groupBy(F.col("document_id").alias("e_id")).agg(F.count("*").alias("n_events"), whole.alias("events")).withColumn("event_types", F.array_join(F.transform("events", lambda x: x["event_type"]), ","))
    r = results.select(F.col("document_id").alias("r_id"), "schema_id")
    out = docs.join(r, F.col("id") == F.col("r_id"), "left").join(v, F.col("id") == F.col("v_id"), "left").join(e, F.col("id") == F.col("e_id"), "left").drop("r_id", "v_id", "e_id")
    if texts is None:
        return out
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    t = texts.select(F.col("document_id").alias("t_id"), text("raw_text").alias("t_raw"), text("raw_text_formatted").alias("t_formatted"), text("engine_used").alias("t_engine"), text("document_type").alias("t_class"))
    out = out.join(t, F.col("id") == F.col("t_id"), "left")
    ocr = F.struct(text("t_engine").alias("engine_used"), text("t_class").alias("classification"), F.lit("").alias("preprocessing_hint"))
    return out.withColumn("full_transcription", text("t_raw")).withColumn("full_transcription_formatted", text("t_formatted")).withColumn("ocr_metadata", ocr).drop("t_id", "t_raw", "t_formatted", "t_engine", "t_class")


def _number(value, least: int, default: int, most: int | None = None) -> int:
    try:
        n = int(str(value))
    except (TypeError, ValueError):
        return default
    return max(least, n if most is None else min(most, n))


def paginate(df: DataFrame, page=1, size=PAGE, order: tuple[Column, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of one page, and one row (count, page, page_size, total_pages); a page past the end is empty."""
    page, size = _number(page, 1, 1), _number(size, 1, PAGE, PAGE)
    rows = df.orderBy(*(order or (F.desc("received_at"), F.col("id")))).offset((page - 1) * size).limit(size)
    total = F.count("*")
    return rows, df.agg(total.alias("count"), F.lit(page).alias("page"), F.lit(size).alias("page_size"), F.ceil(total / size).cast("long").alias("total_pages"))


def bounded_limit(value) -> int:
    return _number(value, 1, LIMIT, MOST)


def sort_documents(df: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """By arquivo, status, canal, tipo or atualizado; what is missing counts as empty."""
    name = F.coalesce(F.nullif("original_filename", F.lit("")), F.col("id"))
    keys = {"arquivo": name, "status": F.col("status"), "canal": F.col("channel"), "tipo": F.col("document_type"), "atualizado": F.coalesce("updated_at", "received_at").cast("string")}
    c = F.lower(F.coalesce(keys[key], F.lit("")))
    return df.orderBy(c.desc() if descending else c.asc(), "id")


def dashboard_metrics(docs: DataFrame) -> DataFrame:
    total, approved, failed = F.count("*"), F.count_if(F.col("status") == "APPROVED"), F.count_if(F.col("status") == "REJECTED")
    return docs.agg(total.alias("total"), approved.alias("approved"), failed.alias("failed"), F.greatest(total - approved - failed, F.lit(0)).alias("pending"))


def status_counts(docs: DataFrame, bucket: str | None = None) -> DataFrame:
    return filter_status(docs, bucket).groupBy("status").agg(F.count("*").alias("n"))


def version_confidence(fields: DataFrame, *keys: str) -> DataFrame:
    """Mean of the confidences of each group, to 4 places; 0 without one."""
    return fields.groupBy(*keys).agg(F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("confidence"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    row, at = F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(row, at).alias("_first")).select("_first.*")
