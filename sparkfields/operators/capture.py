"""What arrives: attachments, media, mailbox rules and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

# Channels, types and size that are let in, and file endings of types.
CHANNELS = ["manual", "email", "whatsapp"]
TYPES = ["application/pdf", "image/png", "image/jpeg", "image/tiff", "image/webp"]
ENDINGS = {"application/pdf": ".pdf", "image/png": ".png", "image/jpeg": ".jpg", "image/tiff": ".tiff", "image/webp": ".webp"}
MOST = 20 * 1024 * 1024


def validate_ingest(df: DataFrame) -> DataFrame:
    """df (tenant_id, channel, filename, size_bytes, content_type) with reject_reason, null if it is let in."""
    blank = lambda c: F.coalesce(X.strip_space(F.col(c)) == "", F.lit(True))
    reason = (
        F.when(blank("tenant_id"), "tenant_id").when(~F.coalesce(F.col("channel").isin(CHANNELS), F.lit(False)), "channel").when(blank("filename"), "filename")
        .when(F.coalesce("size_bytes", F.lit(0)) == 0, "empty").when(F.col("size_bytes") > MOST, "too large").when(~F.coalesce(F.col("content_type").isin(TYPES), F.lit(False)), "content_type")
    )
    return df.withColumn("reject_reason", reason)


def explode_attachments(messages: DataFrame) -> DataFrame:
    """A row for each attachment: tenant_id, provider, message_id, sender, subject, attachment_index, filename, content_type, size_bytes, sha256."""
    rows = messages.select("tenant_id", "provider", "message_id", "sender", "subject", F.posexplode("attachments").alias("attachment_index", "a"))
    return rows.select("tenant_id", "provider", "message_id", "sender", "subject", "attachment_index", "a.*")


def _listed(c: str):
    return F.filter(F.transform(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[,\n]"), X.strip_space), lambda x: x != "")


def apply_mailbox_policy(attachments: DataFrame, policy: DataFrame) -> DataFrame:
    """attachments with outcome: blocked sender, skipped by type or size, or accepted; without a policy all are accepted."""
    p = policy.where("is_active").select(F.col("tenant_id").alias("p_t"), _listed("accepted_content_types").alias("types"), _listed("blocked_senders").alias("blocked"), "max_attachment_mb")
    rows = attachments.join(p, F.col("tenant_id") == F.col("p_t"), "left")
    outcome = (
        F.when(F.array_contains("blocked", F.lower(X.sender_address(F.col("sender")))), "blocked")
        .when((F.size("types") > 0) & ~F.array_contains("types", F.lower("content_type")), "skipped_type").when(F.col("size_bytes") > F.col("max_attachment_mb") * 1024 * 1024, "skipped_size").otherwise("accepted")
    )
    return rows.withColumn("outcome", outcome).drop("p_t", "types", "blocked", "max_attachment_mb")


def ingest_receipt(attachments: DataFrame, *keys: str) -> DataFrame:
    """Counts by outcome: processed (not blocked), accepted, skipped, duplicates."""
    o = F.col("outcome")
    return attachments.groupBy(*keys).agg(F.count_if(o != "blocked").alias("processed"), F.count_if(o == "accepted").alias("accepted"), F.count_if(o.startswith("skipped")).alias("skipped"), F.count_if(o == "duplicate").alias("duplicates"))


def attachment_counts(attachments: DataFrame) -> DataFrame:
    return attachments.groupBy("message_id").agg(F.count_if(~F.col("is_inline")).alias("attachments"), F.count_if(F.col("is_inline")).alias("inline_images"))


def media_form_to_rows(forms: DataFrame) -> DataFrame:
    """(message_sid, sender, media_index, url, content_type, filename, content): form fields MediaUrl0, MediaContentType0 and so on as rows."""
    rows = forms.where("num_media > 0").select("message_sid", F.regexp_replace("from", "^whatsapp:", "").alias("sender"), "fields", F.explode(F.sequence(F.lit(0), F.col("num_media") - 1)).alias("media_index"))
    of = lambda name: F.try_element_at("fields", F.concat(F.lit(name), F.col("media_index").cast("string")))
    name = F.coalesce(X.blank_to_null(of("MediaFilename")), F.concat(F.lit("whatsapp-media-"), (F.col("media_index") + 1).cast("string")))
    return rows.select("message_sid", "sender", "media_index", of("MediaUrl").alias("url"), of("MediaContentType").alias("content_type"), name.alias("filename"), F.unbase64(of("MediaContent")).alias("content"))


def media_list_to_rows(messages: DataFrame) -> DataFrame:
    """(sid, media_sid, content_type, filename) of the allowed media of messages that have some."""
    rows = messages.where("num_media > 0").select("sid", F.explode("media").alias("m")).where(F.col("m.content_type").isin(TYPES))
    ending = F.lit("")
    for kind, end in ENDINGS.items():
        ending = F.when(F.col("m.content_type") == kind, end).otherwise(ending)
    name = F.coalesce(X.disposition_filename(F.col("m.disposition")), F.concat(F.lit("whatsapp-"), "sid", F.lit("-"), "m.media_sid", ending))
    return rows.select("sid", "m.media_sid", "m.content_type", name.alias("filename"))


def import_legacy(existing: DataFrame, incoming: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New documents by id, the first of equal ids by created_at, and the results whose document is known; the last of a document counts."""
    have = existing.select(F.col("id").alias("h"))
    n = F.row_number().over(Window.partitionBy("id").orderBy("created_at"))
    fresh = incoming.join(have, F.col("id") == F.col("h"), "left_anti").withColumn("_n", n).where("_n = 1").drop("_n")
    known = have.unionByName(fresh.select(F.col("id").alias("h"))).distinct()
    kept = results.join(known, F.col("document_id") == F.col("h"), "left_semi")
    last = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("schema_id")))
    return fresh, kept.withColumn("_n", last).where("_n = 1").drop("_n")
