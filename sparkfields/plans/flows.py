"""Queries of capture, configuration, pages and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admin, capture, events, extract, pages, quality
from ..sources import files
from ..sources import log as log_files
from ..streaming import jobs, runs
from . import records
from .fixtures import table, view
from .registry import Registry

query = Registry()

_ATT = """SELECT n_name AS tenant_id, concat('m', cast(floor(o_orderkey / 3) as bigint)) AS message_id, CASE WHEN o_orderkey % 7 = 0 THEN 'Spam <BAD@x.com>' ELSE concat('a', cast(o_custkey as string), '@x.com') END AS sender, o_orderkey % 3 AS attachment_index,
  CASE o_orderkey % 4 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/png' ELSE 'application/pdf' END AS content_type, o_orderkey * 7919 % 30000000 AS size_bytes, CASE WHEN o_orderkey % 23 = 0 THEN ' ' ELSE concat('f', cast(o_orderkey as string), '.pdf') END AS filename,
  CASE WHEN o_orderkey % 19 = 0 THEN 'fax' ELSE 'email' END AS channel, o_orderkey, o_orderkey % 5 = 0 AS is_inline FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def _attachments(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return spark.sql(_ATT.replace("FROM orders JOIN customer", "FROM {o} JOIN {c}").replace("JOIN nation", "JOIN {n}"), o=o, c=c, n=n)


@query(f"""SELECT o_orderkey, CASE WHEN channel = 'fax' THEN 'channel' WHEN trim(filename) = '' THEN 'filename' WHEN size_bytes = 0 THEN 'empty' WHEN size_bytes > 20971520 THEN 'too large' WHEN content_type = 'text/plain' THEN 'content_type' END AS reject_reason FROM ({_ATT}) AS a""")
def b01_validate_ingest(spark: SparkSession, d: str) -> DataFrame:
    return capture.validate_ingest(_attachments(spark, d)).select("o_orderkey", "reject_reason")


_OUTCOME = f"""SELECT *, CASE WHEN n_nationkey % 2 = 1 THEN 'accepted' WHEN o_orderkey % 7 = 0 THEN 'blocked' WHEN content_type = 'text/plain' THEN 'skipped_type' WHEN size_bytes > 10485760 THEN 'skipped_size' ELSE 'accepted' END AS outcome FROM ({_ATT}) AS a JOIN nation AS p ON a.tenant_id = p.n_name"""


def _policy(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select(F.col("n_name").alias("tenant_id"), F.lit("application/pdf, image/png").alias("accepted_content_types"), F.lit(10).alias("max_attachment_mb"), F.lit("bad@x.com\nother@x.com").alias("blocked_senders"), (F.col("n_nationkey") % 2 == 0).alias("is_active"))


@query(f"SELECT o_orderkey, outcome FROM ({_OUTCOME}) AS t")
def b02_apply_mailbox_policy(spark: SparkSession, d: str) -> DataFrame:
    return capture.apply_mailbox_policy(_attachments(spark, d), _policy(spark, d)).select("o_orderkey", "outcome")


@query(f"SELECT tenant_id, count(*) FILTER (WHERE outcome <> 'blocked') AS processed, count(*) FILTER (WHERE outcome = 'accepted') AS accepted, count(*) FILTER (WHERE outcome LIKE 'skipped%') AS skipped, CAST(0 AS BIGINT) AS duplicates FROM ({_OUTCOME}) AS t GROUP BY tenant_id")
def d11_ingest_receipt(spark: SparkSession, d: str) -> DataFrame:
    return capture.ingest_receipt(capture.apply_mailbox_policy(_attachments(spark, d), _policy(spark, d)), "tenant_id")


@query(f"SELECT message_id, count(*) FILTER (WHERE NOT is_inline) AS attachments, count(*) FILTER (WHERE is_inline) AS inline_images FROM ({_ATT}) AS a GROUP BY message_id")
def d16_attachment_counts(spark: SparkSession, d: str) -> DataFrame:
    return capture.attachment_counts(_attachments(spark, d))


@query(f"SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY o_orderkey) - 1 AS attachment_index, filename FROM ({_ATT}) AS a")
def a09_explode_attachments(spark: SparkSession, d: str) -> DataFrame:
    rows = _attachments(spark, d).groupBy("message_id").agg(F.min("tenant_id").alias("tenant_id"), F.min("sender").alias("sender"), F.array_sort(F.collect_list(F.struct("o_orderkey", "filename", "content_type", "size_bytes", F.lit("h").alias("sha256")))).alias("attachments"))
    out = capture.explode_attachments(rows.withColumns({"provider": F.lit("imap"), "subject": F.lit("s")}))
    return out.select("message_id", F.col("attachment_index").cast("long").alias("attachment_index"), "filename")


@query("""SELECT concat('s', conv_id) AS message_sid, CAST(CASE WHEN k = 0 THEN 0 ELSE 1 END AS INT) AS media_index, CASE WHEN k = 0 THEN 'u0' ELSE 'u1' END AS url, CASE WHEN k = 0 THEN 'whatsapp-media-1' ELSE 'nome.pdf' END AS filename, '+55' AS sender
FROM (SELECT DISTINCT conv_id FROM conversations) AS c CROSS JOIN (SELECT unnest([0, 1]) AS k) AS t WHERE k = 0 OR conv_id % 2 = 1""")
def a10_media_form_to_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id").distinct()
    fields = F.create_map(*[F.lit(x) for x in ("MediaUrl0", "u0", "MediaUrl1", "u1", "MediaFilename1", "nome.pdf", "MediaContent0", "YWJj")])
    forms = c.select(F.concat(F.lit("s"), "conv_id").alias("message_sid"), F.lit("whatsapp:+55").alias("from"), (1 + F.col("conv_id") % 2).cast("int").alias("num_media"), fields.alias("fields"))
    return capture.media_form_to_rows(forms).select("message_sid", "media_index", "url", "filename", "sender")


@query("""SELECT concat('s', conv_id) AS sid, concat('m', conv_id) AS media_sid, CASE WHEN conv_id % 3 = 0 THEN 'conta água.pdf' WHEN conv_id % 3 = 1 THEN 'x.pdf' ELSE concat('whatsapp-s', conv_id, '-m', conv_id, '.pdf') END AS filename FROM (SELECT DISTINCT conv_id FROM conversations) AS c""")
def a11_media_list_to_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id").distinct()
    name = F.when(F.col("conv_id") % 3 == 0, "attachment; filename*=UTF-8''conta%20%C3%A1gua.pdf").when(F.col("conv_id") % 3 == 1, 'attachment; filename="x.pdf"')
    item = lambda kind: F.struct(F.concat(F.lit("m"), "conv_id").alias("media_sid"), F.lit(kind).alias("content_type"), name.alias("disposition"))
    rows = c.select(F.concat(F.lit("s"), "conv_id").alias("sid"), F.lit(2).alias("num_media"), F.array(item("application/pdf"), item("video/mp4")).alias("media"))
    return capture.media_list_to_rows(rows).select("sid", "media_sid", "filename")


@query("""SELECT id FROM fx_documents WHERE o_orderkey % 3 <> 0""")
def a07_import_legacy(spark: SparkSession, d: str) -> DataFrame:
    docs = view(spark, d, "fx_documents").withColumn("created_at", F.col("received_at"))
    r = view(spark, d, "fx_results").withColumn("created_at", F.lit(0))
    return capture.import_legacy(docs.where("o_orderkey % 3 = 0"), docs.unionByName(docs), r)[0].select("id")


@query("SELECT c_mktsegment AS schema_id, c_nationkey AS version, CASE WHEN max(CASE WHEN c_custkey % 2 = 1 THEN c_custkey END) IS NOT NULL THEN max(CASE WHEN c_custkey % 2 = 1 THEN c_custkey END) ELSE max(c_custkey) END AS seq FROM customer GROUP BY 1, 2")
def a08_upsert_config(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("schema_id"), F.col("c_nationkey").alias("version"), F.col("c_custkey").alias("seq"))
    return admin.upsert_config(c.where("seq % 2 = 0"), c.where("seq % 2 = 1"), ["schema_id", "version"])


_CFG = "SELECT p_partkey AS config_id, CASE p_partkey % 4 WHEN 0 THEN 'boleto_caixa' WHEN 1 THEN 'boleto_bb' WHEN 2 THEN 'fatura_energia' ELSE 'outro' END AS layout, CASE WHEN p_size % 2 = 0 THEN 'digital_pdf' ELSE 'scanned_image' END AS document_type, concat('schema_', cast(p_size as string)) AS schema_id, p_size / 50.0 AS confidence_threshold, p_partkey % 7 <> 0 AS is_active, CASE WHEN p_partkey % 5 = 0 THEN '{}' ELSE '{\"f\":1}' END AS definition, concat('NATION_', cast(p_partkey % 25 as string)) AS tenant_id FROM part"


def _configs(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_CFG.replace("FROM part", "FROM {part}").replace("{}'", "{{}}'").replace("{\"f\":1}", "{{\"f\":1}}"), part=table(spark, d, "part"))


@query(f"""WITH ok AS (SELECT * FROM ({_CFG}) AS c WHERE is_active AND definition <> '{{}}'), e AS (SELECT layout, document_type, arg_min(schema_id, config_id) AS s, arg_min(confidence_threshold, config_id) AS t FROM ok GROUP BY 1, 2), l AS (SELECT layout, arg_min(schema_id, config_id) AS s, arg_min(confidence_threshold, config_id) AS t FROM ok GROUP BY 1)
SELECT d.id, coalesce(e.s, l.s) AS config_schema, CAST(coalesce(e.t, l.t, 0.75) AS DOUBLE) AS threshold FROM fx_documents AS d LEFT JOIN e ON d.layout = e.layout AND d.document_type = e.document_type LEFT JOIN l ON d.layout = l.layout""")
def c03_resolve_layout_config(spark: SparkSession, d: str) -> DataFrame:
    rows = admin.resolve_layout_config(view(spark, d, "fx_documents"), _configs(spark, d))
    return rows.select("id", "config_schema", F.col("threshold").cast("double").alias("threshold"))


@query(f"""WITH n AS (SELECT * FROM ({_CFG}) AS c WHERE is_active), a AS (SELECT tenant_id, layout, arg_min(schema_id, config_id) AS s FROM n GROUP BY 1, 2), b AS (SELECT tenant_id, document_type, arg_min(schema_id, config_id) AS s FROM n GROUP BY 1, 2), c AS (SELECT DISTINCT schema_id FROM n WHERE config_id % 2 = 0)
SELECT d.id, coalesce(a.s, c.schema_id, b.s, 'pending_no_schema') AS schema, CASE WHEN a.s IS NOT NULL THEN 'layout' WHEN c.schema_id IS NOT NULL THEN 'text' WHEN b.s IS NOT NULL THEN 'document_type' ELSE 'none' END AS tier
FROM fx_documents AS d LEFT JOIN a ON d.tenant_id = a.tenant_id AND d.layout = a.layout LEFT JOIN c ON c.schema_id = concat('schema_', o_orderkey % 60) LEFT JOIN b ON d.tenant_id = b.tenant_id AND d.document_type = b.document_type""")
def c04_resolve_schema(spark: SparkSession, d: str) -> DataFrame:
    c = _configs(spark, d)
    docs = view(spark, d, "fx_documents").withColumn("text_schema", F.concat(F.lit("schema_"), (F.col("o_orderkey") % 60).cast("string")))
    return admin.resolve_schema(docs, c, c.where("config_id % 2 = 0")).select("id", "schema", "tier")


_USERS = "SELECT c_custkey AS user_id, c_custkey % 9 <> 0 AS is_active, CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE c_nationkey END AS role_id FROM customer"
_RP = "SELECT n_nationkey AS role_id, 'docs.view' AS code FROM nation UNION ALL SELECT n_nationkey, 'users.manage' FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_nationkey, 'roles.manage' FROM nation WHERE n_nationkey % 2 = 0"


def _users(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_USERS.replace("FROM customer", "FROM {c}"), c=table(spark, d, "customer"))


def _rp(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_RP.replace("FROM nation", "FROM {n}"), n=table(spark, d, "nation"))


def _roles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("role_id"), F.col("n_name").alias("name"))


@query(f"SELECT user_id, coalesce(role_id % 3 = 0, false) AS entitled FROM ({_USERS}) AS u")
def c06_entitled(spark: SparkSession, d: str) -> DataFrame:
    return admin.entitled(_users(spark, d), _rp(spark, d), "users.manage").select("user_id", "entitled")


@query("SELECT DISTINCT concat('schema_', p_size) AS schema_id, CASE WHEN p_size <= 25 THEN 'conflict' ELSE 'ok' END AS outcome FROM part UNION ALL SELECT 'nota_fiscal_default', 'forbidden'")
def c13_deletable_schemas(spark: SparkSession, d: str) -> DataFrame:
    c = _configs(spark, d)
    schemas = c.select("schema_id").distinct().unionByName(spark.sql("select 'nota_fiscal_default' as schema_id"))
    return admin.deletable_schemas(schemas, c.where("confidence_threshold <= 0.5"))


@query(f"SELECT n_nationkey AS role_id, n_name AS name, count(user_id) AS n FROM nation LEFT JOIN ({_USERS}) AS u ON role_id = n_nationkey GROUP BY 1, 2")
def d03_role_user_counts(spark: SparkSession, d: str) -> DataFrame:
    return admin.role_user_counts(_roles(spark, d), _users(spark, d))


@query(f"WITH u AS ({_USERS}), a AS (SELECT user_id FROM u WHERE is_active AND role_id % 6 = 0) SELECT u.user_id, (SELECT count(*) FROM a) - CASE WHEN a.user_id IS NULL THEN 0 ELSE 1 END = 0 AS is_last_admin FROM u LEFT JOIN a ON u.user_id = a.user_id")
def d04_last_admin_guard(spark: SparkSession, d: str) -> DataFrame:
    return admin.last_admin_guard(_users(spark, d), _rp(spark, d))


@query(f"SELECT user_id, n_name AS role, coalesce(p.permissions, '') AS permissions FROM ({_USERS}) AS u LEFT JOIN nation ON role_id = n_nationkey LEFT JOIN (SELECT role_id AS r, string_agg(code, ',' ORDER BY code) AS permissions FROM ({_RP}) AS x GROUP BY 1) AS p ON p.r = u.role_id")
def d18_user_permissions(spark: SparkSession, d: str) -> DataFrame:
    return admin.user_permissions(_users(spark, d), _roles(spark, d), _rp(spark, d))


@query(f"SELECT config_id, schema_id FROM ({_CFG}) AS c")
def f04_list_configs(spark: SparkSession, d: str) -> DataFrame:
    return admin.list_configs(_configs(spark, d).withColumn("version", F.col("config_id"))).select("config_id", "schema_id")


_TWO = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END AS primary_text, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN text ELSE concat(text, ' ', text) END AS fallback_text, 'a' AS primary_engine, 'b' AS fallback_engine FROM documents"""


@query(f"""WITH t AS (SELECT doc_id, coalesce(primary_text, '') AS p, coalesce(fallback_text, '') AS f FROM ({_TWO}) AS x), c AS (SELECT *, trim(regexp_replace(p, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS pc, trim(regexp_replace(f, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS fc FROM t),
u AS (SELECT *, fc <> '' AND length(f) >= floor(length(p) * 0.6) AND CASE WHEN fc = '' THEN 0 ELSE len(string_split(fc, ' ')) END >= greatest(3, floor(CASE WHEN pc = '' THEN 0 ELSE len(string_split(pc, ' ')) END * 0.6)) AS used FROM c)
SELECT doc_id, used AS used_fallback_text, CASE WHEN used THEN 'a+b' ELSE 'a' END AS engine, sha256(CASE WHEN used THEN f ELSE p END) AS text_sha256 FROM u""")
def c07_merge_ocr_results(spark: SparkSession, d: str) -> DataFrame:
    both = spark.sql(_TWO.replace("FROM documents", "FROM {t}"), t=table(spark, d, "documents"))
    return quality.merge_ocr_results(both).select("doc_id", "used_fallback_text", "engine", F.sha2("raw_text", 256).alias("text_sha256"))


@query("""WITH t AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN '{}' ELSE first END AS p, coalesce(second, '{}') AS f FROM fx_ocr), u AS (SELECT *, coalesce(json_extract_string(p, '$.raw_text'), '') AS pt, coalesce(json_extract_string(f, '$.raw_text'), '') AS ft FROM t),
w AS (SELECT *, CASE WHEN trim(pt) = '' THEN 0 ELSE len(string_split(trim(pt), ' ')) END AS pw, CASE WHEN trim(ft) = '' THEN 0 ELSE len(string_split(trim(ft), ' ')) END AS fw FROM u), b AS (SELECT *, trim(ft) <> '' AND length(ft) >= floor(length(pt) * 0.6) AND fw >= greatest(3, floor(pw * 0.6)) AS better FROM w)
SELECT doc_id, better AS used_fallback_text, CASE WHEN better AND ft <> '' THEN ft ELSE json_extract_string(p, '$.raw_text') END AS raw_text, CASE WHEN better THEN nullif(json_extract_string(f, '$.raw_text_fallback'), '') END AS raw_text_fallback,
  coalesce(json_extract_string(f, '$.totals.grand_total'), json_extract_string(p, '$.totals.grand_total')) AS total, json_extract_string(f, '$.document_info.number') AS number, json_extract_string(p, '$.entities.a') AS entity, json_extract_string(p, '$.tables[0]') AS first_table,
  json_extract_string(p, '$._meta.x') AS meta_x, coalesce(json_extract_string(f, '$._meta.y'), json_extract_string(p, '$._meta.y')) AS meta_y, 'one' AS engine, CAST(better AS VARCHAR) AS replaced, CAST(NULL AS VARCHAR) AS more FROM b""")
def c07_merge_ocr_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole JSON results of two engines as one, with where they come from."""
    rows = view(spark, d, "fx_ocr").select("doc_id", F.col("first").alias("primary"), F.col("second").alias("fallback"), F.lit("one").alias("primary_engine"), F.lit("two").alias("fallback_engine"), F.lit(61.5).alias("primary_avg_confidence"))
    get = lambda path, name: F.get_json_object("merged", path).alias(name)
    paths = {"raw_text": "$.raw_text", "raw_text_fallback": "$.raw_text_fallback", "total": "$.totals.grand_total", "number": "$.document_info.number", "entity": "$.entities.a", "first_table": "$.tables[0]", "meta_x": "$._meta.x", "meta_y": "$._meta.y", "engine": "$._meta.primary_engine", "replaced": "$._meta.fallback_raw_text_replaced", "more": "$.more"}
    return quality.merge_ocr_documents(rows).select("doc_id", "used_fallback_text", *[get(p, n) for n, p in paths.items()])


@query("""WITH v AS (SELECT document_id AS doc_id, name, value, confidence FROM fx_versions WHERE version_number = 1), w AS (SELECT document_id AS doc_id, name, value, confidence, value <> '0' AS ok FROM fx_versions WHERE version_number = 2),
m AS (SELECT coalesce(v.doc_id, w.doc_id) AS doc_id, coalesce(v.name, w.name) AS name, w.value IS NOT NULL AND (w.ok OR v.value IS NULL) AS t, v.value AS pv, v.confidence AS pc, w.value AS wv, w.confidence AS wc FROM v FULL JOIN w ON v.doc_id = w.doc_id AND v.name = w.name)
SELECT doc_id, name, CASE WHEN t THEN wv ELSE pv END AS value, CASE WHEN t THEN wc ELSE pc END AS confidence, t AS from_fallback FROM m UNION ALL SELECT doc_id, 'valor', '', 0.0, false FROM (SELECT DISTINCT doc_id FROM m) AS x""")
def c08_merge_fields(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "fx_versions").withColumnRenamed("document_id", "doc_id").select("doc_id", "version_number", "name", "value", "confidence")
    return quality.merge_fields(v.where("version_number = 1"), v.where("version_number = 2").withColumn("is_valid", F.col("value") != "0"), ["valor"])


@query("""SELECT concat(document_id, '/', version_number) AS doc_id, round(avg(CASE WHEN name = 'quantidade' AND value <> '0' THEN 1.0 ELSE 0.0 END) FILTER (WHERE name = 'quantidade') / 2, 2) AS schema_confidence FROM fx_versions GROUP BY document_id, version_number""")
def d09_schema_confidence(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "fx_versions").select(F.concat_ws("/", "document_id", "version_number").alias("doc_id"), F.lit("s").alias("schema_id"), "name", F.when((F.col("name") == "quantidade") & (F.col("value") != "0"), F.col("value")).otherwise("").alias("value"))
    spec = spark.sql("select 's' as schema_id, 'quantidade' as name, true as required union all select 's', 'imposto', true union all select 's', 'obs', false")
    return quality.schema_confidence(v, spec)


_WORDS = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents), w0 AS (SELECT doc_id, line, unnest(string_split(t, ' ')) AS text, generate_subscripts(string_split(t, ' '), 1) - 1 AS k FROM l),
w AS (SELECT doc_id, CAST(line // 40 AS INT) AS page, line * 100000 + k AS seq, text, ((k * 7 + line * 3) % 100) / 100.0 AS conf FROM w0 WHERE text <> '')"""


def _words(spark: SparkSession, d: str) -> DataFrame:
    """The words of documents, whose texts are dealt by document before they become words: groups by document then shuffle no words, each of which is a row several times its size."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pages.words_of(docs.repartition(max(spark.sparkContext.defaultParallelism, 16 * docs.rdd.getNumPartitions()), "doc_id"))


@query(_WORDS + "SELECT doc_id, page, string_agg(text, ' ' ORDER BY seq) AS text, round(avg(conf * 100), 4) AS confidence FROM w GROUP BY doc_id, page")
def d12_words_to_text(spark: SparkSession, d: str) -> DataFrame:
    return pages.words_to_text(_words(spark, d))


@query(_WORDS + "SELECT doc_id, page, seq, round(30.0 * length(text) / sum(length(text)) OVER (PARTITION BY doc_id, page), 6) AS seconds FROM w")
def d13_term_time_share(spark: SparkSession, d: str) -> DataFrame:
    return pages.term_time_share(_words(spark, d), F.lit(30.0)).select("doc_id", "page", "seq", "seconds")


@query(_WORDS + """, g AS (SELECT doc_id, CAST(line // 40 AS INT) AS page, round_even(line % 40 * 18 / 4.0, 0) AS y, k, k * 45 % 900 AS x, CAST(floor(k * 45 % 900 * (CAST(120 AS DOUBLE) / 900)) AS BIGINT) AS col, text FROM w0 WHERE text <> ''),
c AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id, page, y ORDER BY x, k) - length(text) - 1 AS before FROM g),
s AS (SELECT *, max(col - before) OVER (PARTITION BY doc_id, page, y ORDER BY x, k) + before AS start FROM c),
p AS (SELECT *, start - coalesce(lag(start + length(text)) OVER (PARTITION BY doc_id, page, y ORDER BY x, k), 0) AS gap FROM s),
r AS (SELECT doc_id, page, y, regexp_replace(string_agg(repeat(' ', CAST(gap AS BIGINT)) || text, '' ORDER BY x, k), '\\s+$', '') AS line FROM p GROUP BY doc_id, page, y)
SELECT doc_id, page, string_agg(line, chr(10) ORDER BY y) AS text FROM r GROUP BY doc_id, page""")
def d15_layout_text(spark: SparkSession, d: str) -> DataFrame:
    return pages.layout_text(_words(spark, d))


@query(_WORDS + """, b AS (SELECT doc_id, CAST(line // 40 AS INT) AS page, CAST(line * 100000 + k AS INT) AS seq, line, ((k * 7 + line * 3) % 100) / 100.0 AS conf, k * 45 % 900 AS x0 FROM w0 WHERE text <> ''),
t AS (SELECT * FROM b WHERE conf >= 0.55), h AS (SELECT doc_id, page, seq, line, x0 + 15 * (seq % 5) AS x0 FROM b),
o AS (SELECT h.doc_id, h.seq, max(40 - abs(h.x0 - t.x0)) AS w FROM h JOIN t ON h.doc_id = t.doc_id AND h.line = t.line AND abs(h.x0 - t.x0) < 40 GROUP BY h.doc_id, h.seq)
SELECT doc_id, page, seq, 'typed' AS engine FROM t UNION ALL SELECT h.doc_id, h.page, h.seq, 'handwritten' FROM h LEFT JOIN o ON h.doc_id = o.doc_id AND h.seq = o.seq WHERE coalesce(o.w / (80.0 - o.w), 0) < 0.25""")
def c10_non_overlapping_words(spark: SparkSession, d: str) -> DataFrame:
    w = _words(spark, d)
    hand = w.withColumn("x0", F.col("x0") + 15 * (F.col("seq") % 5)).withColumn("x1", F.col("x0") + 40)
    return pages.non_overlapping_words(w, hand)


@query("""SELECT conv_id, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (WHERE trim(text) <> '') AS text, round(avg(turn % 10 / 10.0) * 100, 2) AS confidence, bool_or(role = 'user') AS handwritten FROM conversations GROUP BY conv_id""")
def d10_merge_pages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", "text", (F.col("turn") % 10 / 10).alias("confidence"), (F.col("role") == "user").alias("with_handwritten_text"), F.lit("").alias("error"))
    return pages.merge_pages(c, "conv_id", "turn").select("conv_id", "text", "confidence", "handwritten")


@query("""SELECT conv_id AS doc_id, turn AS seq FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY (turn % 3 + 1) * greatest(length(text), 1) DESC, turn) AS k FROM conversations) AS t WHERE k = 1""")
def d14_best_variant(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "text", (F.col("turn") % 3 + 1).alias("avg_confidence"))
    return pages.best_variant(c).select("doc_id", "seq")


@query("""SELECT o_custkey AS doc_id, count(DISTINCT o_orderkey % 5) AS nr_pages, count(*) FILTER (WHERE o_orderkey % 3 > 0) AS txtblocks, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS imgblocks, count(DISTINCT o_orderpriority) AS docfonts,
  CASE WHEN count(*) FILTER (WHERE o_orderkey % 3 > 0) > 0 AND count(*) FILTER (WHERE o_orderkey % 3 > 0) >= count(*) FILTER (WHERE o_orderkey % 3 = 0) THEN 'text' ELSE 'image' END AS mode FROM orders GROUP BY o_custkey""")
def d17_pdf_block_summary(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 5).alias("page"), F.when(F.col("o_orderkey") % 3 == 0, "image").otherwise("text").alias("kind"), F.col("o_orderpriority").alias("font"))
    return pages.pdf_block_summary(o)


@query(_WORDS + """, e AS (SELECT doc_id, (doc_id + seq) % 3 = 0 AS typed, conf FROM w), b AS (SELECT doc_id, coalesce(avg(conf) FILTER (WHERE typed), 0) AS t, coalesce(avg(conf) FILTER (WHERE NOT typed), 0) AS e, count(*) FILTER (WHERE typed) AS tn, count(*) FILTER (WHERE NOT typed) AS en FROM e GROUP BY doc_id)
SELECT doc_id, CASE WHEN t >= 0.55 AND tn >= 8 AND t - e >= 0.15 THEN 'typed' WHEN e >= 0.45 AND en >= 5 AND e - t >= 0.10 THEN 'handwritten' WHEN tn = 0 AND en > 0 THEN 'handwritten' WHEN en = 0 AND tn > 0 THEN 'typed' ELSE 'hybrid' END AS label FROM b""")
def p28_image_type_label(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import classify

    w = _words(spark, d).withColumn("engine", F.when((F.col("doc_id") + F.col("seq")) % 3 == 0, "typed").otherwise("handwritten"))
    return classify.image_type_label(w)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) ORDER BY line) AS k FROM l)
SELECT doc_id, string_agg(t, chr(10) ORDER BY line) AS unique_text FROM f WHERE k = 1 GROUP BY doc_id""")
def e05_dedupe_lines(spark: SparkSession, d: str) -> DataFrame:
    return pages.dedupe_lines(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"]).select("doc_id", "unique_text")


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, array_to_string(l[1:3], chr(10)) AS header, CASE WHEN len(l) > 2 THEN array_to_string(l[len(l) - 1:len(l)], chr(10)) ELSE '' END AS footer, array_to_string(CASE WHEN len(l) > 5 THEN l[4:len(l) - 2] ELSE l END, chr(10)) AS body, CAST(len(list_filter(l, lambda x: contains(x, '|'))) AS BIGINT) AS table_lines FROM l""")
def p23_page_blocks(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_blocks(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "header", "footer", "body", "table_lines")


@query()
def p21_truncate_loops(spark: SparkSession, d: str) -> DataFrame:
    return pages.truncate_loops(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.length("loop_free").cast("long").alias("n_chars"), F.sha2("loop_free", 256).alias("sha256"))


_SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 7200 SECOND THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
"""


@query(_SESSIONS + "SELECT user_id AS key, min(ts) AS started, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS items FROM n GROUP BY user_id, s")
def s05a_debounce(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.debounce(table(spark, d, "events"), "user_id", "ts", "event_id", 7200)
    return out.withColumn("items", F.array_join("items", ",")).withColumn("started", F.col("started").cast("timestamp_ntz"))


_GROUPS = """WITH RECURSIVE o AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT user_id, ts, event_id, r, ts AS first, CAST(1 AS BIGINT) AS g FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.ts, o.event_id, o.r, CASE WHEN o.ts - w.ts > INTERVAL 86400 SECOND OR o.ts - w.first >= INTERVAL 172800 SECOND THEN o.ts ELSE w.first END,
  CASE WHEN o.ts - w.ts > INTERVAL 86400 SECOND OR o.ts - w.first >= INTERVAL 172800 SECOND THEN w.g + 1 ELSE w.g END FROM w JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1)
"""


@query(_GROUPS + "SELECT user_id AS key, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS items FROM w GROUP BY user_id, g")
def s05b_debounce_max_wait(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.debounce_max_wait(table(spark, d, "events"), "user_id", "ts", "event_id", 86400, 172800)
    return out.select("key", "n", F.array_join("items", ",").alias("items"))


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")  # a pattern, as the table may be one file


@query(_GROUPS + "SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, CAST(event_id AS VARCHAR)) AS items FROM w GROUP BY user_id, g")
def s05b_debounce_stream(spark: SparkSession, d: str) -> DataFrame:
    out = runs.run_now(jobs.debounce_stream(runs.ended(_stream(spark, d, "events"), "ts"), "user_id", "ts", "event_id", 86400, 172800))
    return out.select("key", "n", F.array_join("items", ",").alias("items"))


@query(_SESSIONS + "SELECT user_id AS key, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS items FROM n GROUP BY user_id, s")
def s07_drain_stream(spark: SparkSession, d: str) -> DataFrame:
    """All sessions of the input there is: silence closes them, or the end mark."""
    out = runs.run_now(jobs.debounce(runs.ended(_stream(spark, d, "events"), "ts"), "user_id", "ts", "event_id", 7200))
    return out.select("key", "n", F.array_join("items", ",").alias("items"))


@query("SELECT event_id, event_type, ts FROM events")
def s02_dedupe_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream that brings every event twice."""
    twice = _stream(spark, d, "events").unionByName(_stream(spark, d, "events"))
    return runs.run_now(jobs.dedupe_stream(twice, "event_id", "ts", "1 hour")).select("event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


def _arrivals(spark: SparkSession, d: str, at: str, batches: int) -> DataFrame:
    """fx_events as a stream of so many batches of ranges of their offsets; a batch is as many files as there are cores, so that all of them write and read it."""
    rows, files = view(spark, d, "fx_events"), spark.sparkContext.defaultParallelism
    rows.repartitionByRange(batches * files, "stream_offset").write.parquet(f"{at}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in")


@query("SELECT DISTINCT event_id, event_type, occurred_at, document_id FROM fx_events")
def s02_dedupe_log(spark: SparkSession, d: str) -> DataFrame:
    """Ids that come again in a later batch, whenever that is."""
    at = runs.folder(spark)
    jobs.dedupe_log(_arrivals(spark, d, at, 3), f"{at}/out", f"{at}/log", f"{at}/checkpoint", buckets=8).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "event_type", "occurred_at", "document_id")


@query(records.STATE)
def s03_state_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The state after several batches, folded run by run."""
    at = runs.folder(spark)
    jobs.state_upsert(_arrivals(spark, d, at, 5), f"{at}/table", f"{at}/checkpoint", fanout=3, buckets=8).awaitTermination()
    times = ("received_at", "ocr_at", "extracted_at")
    return jobs.read_state(spark, f"{at}/table").withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


_KIND = "CASE template WHEN 2 THEN 'boleto' WHEN 3 THEN 'boleto' WHEN 4 THEN 'fatura' WHEN 5 THEN 'fatura' ELSE 'generic' END"


@query(f"""SELECT doc_id, CAST(doc_id AS VARCHAR) AS input_event_id, 'extraction.completed' AS event_type, {_KIND} AS schema_id, substr(raw_text, 1, 500) AS preview FROM fx_invoices""")
def s04_classify_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "fx_invoices").withColumn("event_id", F.col("doc_id").cast("string"))
    return jobs.classify_extract(rows).select("doc_id", "input_event_id", "event_type", "schema_id", "preview")


@query(f"SELECT coalesce(event_type, 'unknown') || '.dlq' AS stream, stream_offset AS event_stream_id, event_type, event_id, 'ValueError' AS error_type, error FROM ({records.VALID}) AS v WHERE error IS NOT NULL")
def s01_route_dlq(spark: SparkSession, d: str) -> DataFrame:
    """Dead letters of a stream, as its two sinks get them."""
    at = runs.folder(spark)
    jobs.route_stream(view(spark, d, "fx_events", events=_stream(spark, d, "events")), f"{at}/good", f"{at}/dead", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/dead").select("stream", "event_stream_id", "event_type", "event_id", "error_type", "error")


@query("SELECT CAST(user_id AS VARCHAR) AS document_id, CAST(event_id AS VARCHAR) AS input_event_id, 'ocr.failed' AS event_type, CASE event_id % 2 WHEN 0 THEN 'engine' ELSE 'timeout' END AS reason, true AS retryable, concat('local://', user_id) AS file_uri FROM events WHERE event_type = 'error'")
def s08_s09_failures(spark: SparkSession, d: str) -> DataFrame:
    why = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "engine").otherwise("timeout"))
    _, bad = jobs.flush_rows(table(spark, d, "events"), why)
    user = F.col("user_id").cast("string")
    rows = bad.select(F.lit("t").alias("tenant_id"), user.alias("document_id"), "error", F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("local://"), user).alias("file_uri"))
    return jobs.failure_events(rows).drop("tenant_id")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, value FROM events")
def a04_a05_event_files(spark: SparkSession, d: str) -> DataFrame:
    """Events appended to a stream's files and tailed from there."""
    at = runs.folder(spark)
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), "event_type", "value")
    files.append_events(e, at, "events")
    return runs.run_now(files.stream_events(spark, f"{at}/events", "event_id string, event_type string, value double"))


@query("SELECT event_type AS stream, row_number() OVER (PARTITION BY event_type ORDER BY seq % 3, stream_offset) AS offset, event_id FROM fx_events")
def a03_a05_event_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Three appends to the streams of a log, then a scan of each stream in two slices."""
    log, rows = log_files.EventLog(spark, runs.folder(spark)), view(spark, d, "fx_events")
    for k in range(3):
        log.append(rows.where(F.col("seq") % 3 == k), F.col("event_type"), [F.col("stream_offset")], k)
    out = None
    for stream, upto in sorted(log.next_offsets().items()):
        for part in (log.scan(stream, 0, upto // 2), log.scan(stream, upto // 2)):
            part = part.withColumn("stream", F.lit(stream))
            out = part if out is None else out.unionByName(part)
    return out.select("stream", "offset", F.get_json_object("value", "$.event_id").alias("event_id"))


_BLOBS = "SELECT concat('documents/t', CAST(doc_id % 5 AS STRING), '/d', CAST(doc_id AS STRING), '/original') AS key, coalesce(text, '') AS body FROM documents"
_NAMED = "SELECT concat('in/', CASE doc_id % 2 WHEN 0 THEN 'a' ELSE 'B' END, CAST(doc_id AS STRING), '.', CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'PNG' WHEN 2 THEN 'txt' WHEN 3 THEN 'tiff' WHEN 4 THEN 'docx' ELSE 'webp' END) AS key, coalesce(text, '') AS body FROM documents"


def _put(spark: SparkSession, d: str, sql: str) -> str:
    """A new folder with a file for each row of sql over documents."""
    rows = spark.sql(sql.replace("FROM documents", "FROM {t}"), t=table(spark, d, "documents"))
    at = runs.folder(spark)
    files.put_blobs(rows.select("key", F.col("body").cast("binary").alias("content")), at)
    return at


@query(f"SELECT key, split_part(key, '/', 2) AS tenant_id, split_part(key, '/', 3) AS document_id, strlen(body) AS size_bytes, sha256(body) AS sha256 FROM ({_BLOBS}) AS b")
def a01_scan_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts stored under their keys, and found there."""
    return files.scan_blobs(spark, _put(spark, d, _BLOBS)).select("key", "tenant_id", "document_id", "size_bytes", "sha256")


@query(f"SELECT split_part(key, '/', 2) AS name, strlen(body) AS size_bytes FROM ({_NAMED}) AS b WHERE NOT contains(key, '.txt') AND NOT contains(key, '.docx')")
def a12_scan_supported(spark: SparkSession, d: str) -> DataFrame:
    return files.scan_supported(spark, _put(spark, d, _NAMED)).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "size_bytes")


@query(f"""SELECT key, strlen(body) AS size_bytes, sha256(body) AS sha256 FROM ({_BLOBS}) AS b
UNION ALL SELECT split_part(key, '/', 2), strlen(body), NULL FROM ({_NAMED}) AS c WHERE NOT contains(key, '.txt') AND NOT contains(key, '.docx')""")
def a01_a12_scan_files(spark: SparkSession, d: str) -> DataFrame:
    """What the two scans give for files of all documents."""
    named = a12_scan_supported(spark, d).select(F.col("name").alias("key"), "size_bytes", F.lit(None).cast("string").alias("sha256"))
    return a01_scan_blobs(spark, d).select("key", "size_bytes", "sha256").unionByName(named)


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN coalesce(source, '') ELSE coalesce(text, '') END AS raw_text, CASE WHEN doc_id % 5 > 1 THEN 'tesseract' END AS engine_used FROM documents""")
def a02_scan_raw_text(spark: SparkSession, d: str) -> DataFrame:
    """Recognised texts in JSON files: missing (0), broken (1), with a fallback text (2), whole."""
    docs = table(spark, d, "documents")
    body = F.to_json(F.struct(F.when(F.col("doc_id") % 5 == 2, "").otherwise(F.col("text")).alias("raw_text"), F.col("source").alias("raw_text_fallback"), F.lit("tesseract").alias("engine_used")))
    body = F.when(F.col("doc_id") % 5 == 1, F.lit('{"raw_text": "cut of')).otherwise(body)
    at = runs.folder(spark)
    files.put_blobs(docs.where("doc_id % 5 > 0").select(F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("key"), body.cast("binary").alias("content")), at)
    found = files.scan_raw_text(spark, at, docs.select(F.col("doc_id").cast("string").alias("id")))
    return found.select(F.col("document_id").cast("long").alias("doc_id"), "raw_text", "engine_used")


@query("""SELECT tenant_id, id AS document_id, status, concat('c-', id) AS correlation_id, json_extract_string(r.fields, '$.cliente') AS cliente, '2024-01-02T03:04:05Z' AS exported_at, 'correlation_id,document_id,exported_at,payload,status' AS keys
FROM fx_documents JOIN nation ON tenant_id = n_name LEFT JOIN fx_results AS r ON r.document_id = id WHERE status = 'APPROVED' AND n_nationkey % 2 = 0""")
def a06_export_files(spark: SparkSession, d: str) -> DataFrame:
    """Approved documents as the files of each tenant hold them."""
    rows = events.export_approved(view(spark, d, "fx_documents"), view(spark, d, "fx_results"), records.settings(spark, d))
    at = runs.folder(spark)
    files.write_approved(rows.withColumn("correlation_id", F.concat(F.lit("c-"), "document_id")), at, F.lit("2024-01-02T03:04:05Z"))
    read = spark.read.text(at)
    get = lambda k: F.get_json_object("value", f"$.{k}")
    return read.select("tenant_id", get("document_id").alias("document_id"), get("status").alias("status"), get("correlation_id").alias("correlation_id"), F.get_json_object(get("payload"), "$.fields.cliente").alias("cliente"), get("exported_at").alias("exported_at"), F.array_join(F.json_object_keys("value"), ",").alias("keys"))


@query("SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(coalesce(text, '')) AS sha256 FROM documents")
def j02_extract_with(spark: SparkSession, d: str) -> DataFrame:
    """A user's own extractor over Arrow batches of whole texts."""
    import hashlib

    def own(frames):
        for frame in frames:
            texts = frame["text"].fillna("")
            frame = frame[["doc_id"]].copy()
            frame["n_chars"], frame["sha256"] = texts.str.len(), texts.map(lambda t: hashlib.sha256(t.encode()).hexdigest())
            yield frame

    return extract.extract_with(table(spark, d, "documents").select("doc_id", "text"), own, "doc_id bigint, n_chars bigint, sha256 string")


QUERIES, SQL = query.queries, query.sql
