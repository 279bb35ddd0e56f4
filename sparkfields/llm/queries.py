"""The registered queries of the corpus operators, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fill_in_middle, fingerprints, html_extraction, importance_resampling, language_id, lattice_lm, line_dedup, mixing, sharding, simhash_dedup, suffix_dedup, url_filter
from .common import id_mod, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontamination.mark(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return hits.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("hits.items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_next(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(id_mod(F.col("doc_id"), 4) != 2))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    spans = F.sha2(F.to_json("language.spans"), 256)
    return found.select("doc_id", (id_mod(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.size("language.spans").alias("n_spans"), spans.alias("spans_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("lines").alias("n_lines"), F.col("lines_kept").alias("n_kept"), F.length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The rules of this query, and the hosts whose pages its list holds.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
URL_HOSTS = [
    f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # the list: the canonical url of every page of those hosts, so it grows with the pages
    own = F.exists(F.lit(URL_HOSTS), lambda h: (F.col("h") == h) | F.endswith("h", F.concat(F.lit("."), h)))
    urls = pages.select(url_filter.canonical_host(F.col("url")).alias("h"), url_filter.canonical(F.col("url")).alias("key")).where(own)
    return url_filter.judge(pages, url_filter.entries(spark, URL_RULES), urls.select("key"))


def op6_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_lattice_lm(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    scored = lattice_lm.score(table(spark, sf_dir, "documents"), lattice_lm.teaches(), lattice_lm.vocabulary(vocabulary))
    return scored.select("doc_id", (id_mod(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fim = [F.col(f"fim.{c}").alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")]
    again = fill_in_middle.restored(F.col("fim.form"), F.col("fim.output"))
    return made.select("doc_id", *fim, F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("repeats.removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select("doc_id", F.col("repeats.n_bytes").alias("n_bytes"), n_removed.alias("n_removed"), F.size("repeats.removed").cast("long").alias("n_spans"), F.sha2("repeats.kept", 256).alias("kept_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_fingerprints, op3_language_id, op4_line_dedup, op5_url_filter, op6_simhash_pigeonring, op7_sharding, op8_html_extraction, op9_lattice_lm, op10_mixing, op11_fill_in_middle, op12_suffix_dedup, op13_importance_resampling)}

_OP1_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {_OP1_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_OP1_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item, CASE WHEN len(w) < 10 THEN len(w) ELSE 10 END AS n,
        array_to_string(w[s:s + 9], ' ') AS words
      FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM i WHERE len(w) > 0)),
p AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS words
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT p.doc_id, p.s, p.n, g.item FROM p JOIN g ON p.words = g.words AND p.n = g.n),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
""",
    "op5_url_filter": f"""
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}) AS t(rh, rp, v)),
l AS (SELECT * FROM (VALUES {", ".join(f"('{h}')" for h in URL_HOSTS)}) AS t(lh)),
w AS (SELECT p.host, p.path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
      FROM (SELECT DISTINCT host, path FROM p) AS p JOIN r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp) GROUP BY p.host, p.path)
SELECT p.page_id, p.host, p.path, w.rule,
  CASE WHEN w.rule IS NOT NULL THEN w.v WHEN m.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  w.rule IS NULL AND m.host IS NOT NULL AS listed
FROM p LEFT JOIN w ON p.host = w.host AND p.path = w.path
LEFT JOIN (SELECT DISTINCT host FROM (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), '[.]?(:(80|443)?)?$', '') AS c FROM p) JOIN l ON c = lh OR ends_with(c, '.' || lh)) AS m ON p.host = m.host
""",
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
l AS (SELECT doc_id, text, x, CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '[^\n]*\n|[^\n]+') END AS u FROM d),
h AS (SELECT *, len(u) AS n, [CAST('0x' || substr(x, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS h FROM l),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, n, form, text, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
""",
    "op12_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE doc_id > least),
g AS (SELECT doc_id, p, sum(CASE WHEN p - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
      FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT s.doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY s.doc_id ORDER BY a) AS before FROM s),
t AS (SELECT k.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS upto, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
      FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(upto, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
""",
    "op13_importance_resampling": f"""
WITH z AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) AS r(i)),
d AS (SELECT doc_id, {_OP1_WORDS} AS w FROM documents), b AS (SELECT {_OP1_WORDS} AS w FROM benchmark),
fd AS (SELECT doc_id, array_to_string(w[i:i + k], ' ') AS f FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 1)) AS i FROM d, range(3) AS r(k) WHERE len(w) > k)),
fb AS (SELECT array_to_string(w[i:i + k], ' ') AS f FROM (SELECT w, k, unnest(range(1, len(w) - k + 1)) AS i FROM b, range(3) AS r(k) WHERE len(w) > k)),
e AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM (SELECT f FROM fd UNION ALL SELECT f FROM fb))),
c AS (SELECT f, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT) FOR k IN range(length(x) // 2)]),
        lambda c, y: xor(c >> 8, tab[xor(c & 255, y) + 1])), 4294967295) % 10000 AS bucket FROM e, z),
cd AS (SELECT doc_id, bucket FROM fd JOIN c ON fd.f = c.f), cb AS (SELECT bucket FROM fb JOIN c ON fb.f = c.f),
s AS (SELECT bucket, count(*) AS s FROM cd GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM cb GROUP BY bucket),
g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM cd) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM cb) + 10000)::DOUBLE))) AS BIGINT) AS gain
      FROM s LEFT JOIN t ON s.bucket = t.bucket),
w AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM cd JOIN g ON cd.bucket = g.bucket GROUP BY doc_id),
n AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM d LEFT JOIN w ON d.doc_id = w.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM n WHERE n_words >= 20)
SELECT n.doc_id, n.n_features, n.weight, n.score, CASE WHEN rank <= (SELECT count(*) FROM r) * 5 // 100 THEN rank END AS rank
FROM n LEFT JOIN r ON n.doc_id = r.doc_id
""",
}
