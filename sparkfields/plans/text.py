"""Queries of the text rules, over documents made from orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import classify, context, extract, keywords, noisy, quality
from .fixtures import table, view, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return keep


def _sum(words: list, text: str) -> str:
    return " + ".join(f"CASE WHEN contains({text}, '{w}') THEN {x} ELSE 0.0 END" for w, x in words)


def _count(words: list[str], text: str) -> str:
    return " + ".join(f"CASE WHEN contains({text}, '{w}') THEN 1 ELSE 0 END" for w in words)


_SCORES = ", ".join(f"CAST({_sum(w, 'low')} AS DOUBLE)" + (" + CASE WHEN regexp_matches(low, '\\b\\d{44}\\b') THEN 0.25 ELSE 0.0 END" if n == "nota_fiscal" else "") + f" AS s{k}" for k, (n, w) in enumerate(classify.LAYOUTS.items()))
_BEST = "greatest(least(0.99, s0), s1, s2, s3, s4, s5)"
_CHOICE = " ".join(f"WHEN {'least(0.99, s0)' if k == 0 else f's{k}'} = best THEN '{n}'" for k, n in enumerate(classify.LAYOUTS))
_LAYOUT = f"""
WITH a AS (SELECT doc_id, trim(regexp_replace(lower(raw_text), '\\s+', ' ', 'g')) AS low FROM fx_invoices),
b AS MATERIALIZED (SELECT doc_id, low, {_SCORES} FROM a), c AS MATERIALIZED (SELECT *, {_BEST} AS best FROM b),
p01 AS MATERIALIZED (SELECT doc_id, CASE WHEN best < 0.45 THEN 'generic' ELSE CASE {_CHOICE} END END AS layout,
  round(CASE WHEN best < 0.45 THEN CASE WHEN low = '' THEN 0.0 ELSE 0.35 END ELSE least(0.99, best) END, 2) AS confidence,
  CASE WHEN best < 0.45 THEN true ELSE best < 0.7 END AS requires_human_validation FROM c)
"""


@query(_LAYOUT + "SELECT doc_id, layout, confidence, requires_human_validation FROM p01")
def p01_layout_classify(spark: SparkSession, d: str) -> DataFrame:
    return classify.layout_classify(view(spark, d, "fx_invoices")).select("doc_id", "layout", "confidence", "requires_human_validation")


@query(_LAYOUT + "SELECT layout, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(CASE WHEN requires_human_validation THEN 1.0 ELSE 0.0 END), 6) AS review_share FROM p01 GROUP BY layout")
def p01_layout_summary(spark: SparkSession, d: str) -> DataFrame:
    review = F.avg(F.col("requires_human_validation").cast("double"))
    return p01_layout_classify(spark, d).groupBy("layout").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(review, 6).alias("review_share"))




@query(f"""
WITH a AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS low FROM documents),
b AS MATERIALIZED (SELECT doc_id, low, {_SCORES} FROM a), c AS MATERIALIZED (SELECT *, {_BEST} AS best FROM b)
SELECT doc_id, CASE WHEN best < 0.45 THEN 'generic' ELSE CASE {_CHOICE} END END AS layout,
  round(CASE WHEN best < 0.45 THEN CASE WHEN low = '' THEN 0.0 ELSE 0.35 END ELSE least(0.99, best) END, 2) AS confidence FROM c""")
def p01_documents(spark: SparkSession, d: str) -> DataFrame:
    return classify.layout_classify(table(spark, d, "documents"), "text").select("doc_id", "layout", "confidence")


@query(f"""
WITH a AS (SELECT doc_id, trim(regexp_replace(lower(raw_text), '\\s+', ' ', 'g')) AS low FROM fx_invoices), n AS (SELECT DISTINCT lower(c_name) AS name FROM customer),
b AS MATERIALIZED (SELECT a.doc_id, low, {_SCORES}, CASE WHEN n.name IS NOT NULL THEN 0.46 ELSE 0.0 END AS s6 FROM a LEFT JOIN n ON n.name = regexp_extract(low, 'customer#[0-9]{{9}}')), c AS MATERIALIZED (SELECT *, greatest({_BEST}, s6) AS best FROM b)
SELECT doc_id, CASE WHEN best < 0.45 THEN 'generic' ELSE CASE {_CHOICE} WHEN s6 = best THEN 'cliente' END END AS layout,
  round(CASE WHEN best < 0.45 THEN CASE WHEN low = '' THEN 0.0 ELSE 0.35 END ELSE least(0.99, best) END, 2) AS confidence FROM c""")
def j01_layout_by_table(spark: SparkSession, d: str) -> DataFrame:
    """Layouts by a table of the literal rules and, under a label of their own, the names of all customers."""
    names = table(spark, d, "customer").select(F.lit("cliente").alias("label"), (F.lit(1_000_000) + F.col("c_custkey")).cast("long").alias("seq"), F.lower("c_name").alias("word"), F.lit(0.46).alias("weight"))
    rules = keywords.rule_rows(spark, classify.LAYOUTS).unionByName(names)
    return keywords.layout_by_table(view(spark, d, "fx_invoices"), rules).select("doc_id", "layout", "confidence")


@query("""WITH w AS (SELECT DISTINCT concat('l', length(word) % 4) AS label, word FROM (SELECT unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS word FROM benchmark) AS u WHERE length(word) >= 5)
SELECT doc_id, label, CAST(count(*) AS INT) AS n FROM documents JOIN w ON contains(lower(coalesce(text, '')), word) GROUP BY doc_id, label""")
def j01_word_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many of the benchmark's longer words each document contains, by labels."""
    words = table(spark, d, "benchmark").select(F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")).alias("word")).where("length(word) >= 5").distinct()
    rules = words.select(F.concat(F.lit("l"), F.length("word") % 4).alias("label"), F.xxhash64("word").alias("seq"), "word")
    rows = keywords.counts_by_table(table(spark, d, "documents").select("doc_id", "text"), rules, "text")
    return rows.select("doc_id", F.explode("counts").alias("label", "n"))


_SCHEMA = f"""
WITH s AS (SELECT doc_id, {_count(classify.NF_WORDS, "low")} + CASE WHEN regexp_matches(low, '\\b\\d{{44}}\\b') THEN 3 ELSE 0 END AS nf, {_count(classify.WATER_WORDS, "low")} AS water,
  {_count(classify.BOLETO_WORDS, "low")} + CASE WHEN regexp_matches(low, '{classify.LINHA}') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(low, '\\b\\d{{44}}\\b') THEN 2 ELSE 0 END AS slip
  FROM (SELECT doc_id, lower(raw_text) AS low FROM fx_invoices) AS t)
SELECT doc_id, CASE WHEN nf >= 4 THEN 'nota_fiscal_default' WHEN water >= 3 THEN 'conta_agua_default' WHEN slip >= 4 THEN 'boleto_default' END AS schema_id FROM s"""


@query(_SCHEMA)
def p02_schema_classify(spark: SparkSession, d: str) -> DataFrame:
    return classify.schema_classify(view(spark, d, "fx_invoices")).select("doc_id", "schema_id")


def _ex(pattern: str) -> str:
    p = pattern.replace("'", "''").replace("[aá]", "(?:a|á)")
    return f"nullif(trim(regexp_extract(raw_text, '{p}', 1)), '')"


def _have(*names: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {n} IS NOT NULL THEN 1 ELSE 0 END" for n in names) + f") / {len(names)}.0"


@query(f"""
WITH e AS (SELECT doc_id, {_ex(extract.LINHA)} AS linha_digitavel, {_ex(extract.DATE)} AS vencimento, {_ex(extract.AMOUNT)} AS valor, {_ex(extract.PAYEE)} AS beneficiario FROM fx_invoices)
SELECT *, CAST({_have("linha_digitavel", "vencimento", "valor", "beneficiario")} AS DOUBLE) AS confidence, {_have("linha_digitavel", "vencimento", "valor", "beneficiario")} < 0.75 AS requires_human_validation FROM e""")
def p03_extract_boleto(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_boleto(view(spark, d, "fx_invoices")).select("doc_id", "linha_digitavel", "vencimento", "valor", "beneficiario", "confidence", "requires_human_validation")


@query(f"""
WITH e AS (SELECT doc_id, {_ex(extract.DATE)} AS vencimento, {_ex(extract.AMOUNT)} AS valor, {_ex(extract.UNIT)} AS unidade, {_ex(extract.KWH)} AS consumo_kwh FROM fx_invoices)
SELECT *, CAST({_have("vencimento", "valor", "unidade", "consumo_kwh")} AS DOUBLE) AS confidence, {_have("vencimento", "valor", "unidade", "consumo_kwh")} < 0.75 AS requires_human_validation FROM e""")
def p04_extract_fatura(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_fatura(view(spark, d, "fx_invoices")).select("doc_id", "vencimento", "valor", "unidade", "consumo_kwh", "confidence", "requires_human_validation")


@query("SELECT doc_id, substr(t, 1, 500) AS texto, CASE WHEN t = '' THEN 0.0 ELSE 0.25 END AS confidence FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents) AS x")
def p04_extract_generic(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_generic(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "texto", "confidence")


@query()
def p05_field_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = extract.field_candidates(view(spark, d, "fx_invoices"))
    return rows.select("doc_id", *[F.array_join(c, "|").alias(c) for c in rows.columns if c.endswith("_candidates")])


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS pos FROM fx_invoices),
h AS (SELECT doc_id, pos, coalesce(nullif(trim(regexp_extract(line, '^[^:\\-]*[:\\-]\\s*(.*)$', 1)), ''), trim(regexp_extract(line, '(?i)(?:vencimento|valor|consumo)(.*)$', 1))) AS v FROM l WHERE regexp_matches(lower(line), 'vencimento|valor|consumo'))
SELECT i.doc_id, coalesce((SELECT arg_min(v, pos) FROM h WHERE h.doc_id = i.doc_id AND v <> ''), '') AS value FROM fx_invoices AS i""")
def p06_labelled_value(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "fx_invoices")
    return rows.select("doc_id", extract.labelled_value(X.lines(F.col("raw_text")), ["vencimento", "valor", "consumo"]).alias("value"))


# What the templates of fx_invoices hold, line by line, is what the rules must find.
_L = "WITH i AS (SELECT doc_id, template, cents, string_split(raw_text, chr(10)) AS l FROM fx_invoices)"
_ALL = "'" + ",".join(quality.FIELDS) + "'"


@query(_L + "SELECT doc_id, " + ", ".join(f"CASE WHEN template = 0 THEN array_to_string(l[{a}:{b}], '|') ELSE '' END AS {n}" for n, a, b in (("emitente", 4, 8), ("tomador", 9, 11), ("servico", 12, 14), ("municipal", 15, 19), ("federal", 20, 21))) + " FROM i")
def p07_slice_blocks(spark: SparkSession, d: str) -> DataFrame:
    return extract.slice_blocks(view(spark, d, "fx_invoices")).select("doc_id", *[F.array_join(f"{b}_block", "|").alias(b) for b in extract.BLOCKS])


def _by_template(**cases: str) -> str:
    return "CASE template " + " ".join(f"WHEN {k[1:]} THEN {v}" for k, v in cases.items()) + " ELSE "


_FOUND = f"""SELECT doc_id, {_by_template(t0="l[6]", t1="replace(l[2], 'Fornecedor: ', '')")} '' END AS fornecedor, CAST({_by_template(t0="0.95", t1="0.58")} 0.0 END AS DOUBLE) AS fornecedor_conf,
  {_by_template(t0="l[11]", t1="replace(l[3], 'Tomador: ', '')")} '' END AS tomador, CAST({_by_template(t0="0.95", t1="0.58")} 0.0 END AS DOUBLE) AS tomador_conf,
  {_by_template(t0="l[8]", t1="replace(l[4], 'CNPJ: ', '')", t2="lpad(CAST(doc_id AS VARCHAR), 14, '0')", t3="lpad(CAST(doc_id AS VARCHAR), 14, '0')")} '' END AS cnpj_fornecedor,
  CAST({_by_template(t0="0.97", t1="0.56", t2="0.56", t3="0.56")} 0.0 END AS DOUBLE) AS cnpj_fornecedor_conf, {_by_template(t0="l[3]")} '' END AS numero_nf, CAST({_by_template(t0="0.94")} 0.0 END AS DOUBLE) AS numero_nf_conf,
  {_by_template(t0="l[14]")} '' END AS descricao_servico, CAST({_by_template(t0="0.92")} 0.0 END AS DOUBLE) AS descricao_servico_conf,
  {_by_template(t0="replace(l[17], 'R$ ', '')", t4="replace(l[5], 'Total a pagar: R$ ', '')")} '' END AS valor_nf, CAST({_by_template(t0="0.92", t4="0.58")} 0.0 END AS DOUBLE) AS valor_nf_conf,
  {_by_template(t0="'ISSQN retido R$ 10,00'", t1="l[8]")} '' END AS retencao, CAST({_by_template(t0="0.82", t1="0.48")} 0.0 END AS DOUBLE) AS retencao_conf,
  {_by_template(t0="l[10]")} '' END AS cnpj_tomador, CAST({_by_template(t0="0.97", t1="0.56", t2="0.56", t3="0.56")} 0.0 END AS DOUBLE) AS cnpj_tomador_conf FROM i"""


@query(_L + _FOUND)
def p08_critical_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.critical_fields(view(spark, d, "fx_invoices"))
    return rows.select("doc_id", *[c for n in quality.FIELDS for c in (F.col(f"{n}.value").alias(n), F.col(f"{n}.conf").alias(f"{n}_conf"))])


@query()
def p09_noisy_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Off in the reference; here a fixed digit repair of lines that are mostly digits, and its best amount."""
    rows = view(spark, d, "fx_invoices")
    fixed = F.transform(X.lines(F.col("raw_text")), X.numeric_token_fix)
    amounts = F.flatten(F.transform(fixed, lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(\d{1,3}(?:\.\d{3})*,\d{2})"), F.lit(1)), lambda v: F.struct(
        (F.when(F.lower(x).contains("r$"), 10000).otherwise(0) + F.when(F.lower(x).rlike("total|valor"), 2500).otherwise(0) - F.when(F.lower(x).rlike("cpf|pix|fone"), 9000).otherwise(0)).alias("score"), v.alias("v")))))
    return rows.select("doc_id", F.array_join(fixed, "\n").alias("fixed"), F.get(F.sort_array(amounts, asc=False), 0)["v"].alias("amount"))


def _sum_sql(weights: list[int]) -> str:
    return " + ".join(f"{w} * CAST(substr(d, {k}, 1) AS INT)" for k, w in enumerate(weights, 1))


_CHECKED = "CAST(substr(d, 13, 1) AS INT) = (11 - (" + _sum_sql([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]) + ") % 11) % 11 % 10 AND CAST(substr(d, 14, 1) AS INT) = (11 - (" + _sum_sql([6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]) + ") % 11) % 11 % 10 AND d <> repeat(substr(d, 1, 1), 14)"
_SWAPS = ", ".join(f"('{a}', '{b}')" for a, others in noisy.LOOK_ALIKES.items() for b in others)


@query(f"""WITH n AS (SELECT doc_id, template, cnpj, regexp_replace(translate(read_cnpj, 'OoIlSsBQ', '00115580'), '[^0-9]', '', 'g') AS d FROM fx_noisy),
c AS (SELECT doc_id, d, true AS own FROM n UNION ALL SELECT doc_id, substr(d, 1, k - 1) || b || substr(d, k + 1) AS d, false FROM n, range(1, 15) AS r(k), (VALUES {_SWAPS}) AS s(a, b) WHERE substr(d, k, 1) = a),
v AS (SELECT doc_id, max(d) FILTER (WHERE own) AS own, CASE WHEN count(*) FILTER (WHERE NOT own) = 1 THEN max(d) FILTER (WHERE NOT own) END AS other FROM c WHERE {_CHECKED} GROUP BY doc_id)
SELECT doc_id, coalesce(own, other) AS digits, coalesce(coalesce(own, other) = cnpj, false) AS planted FROM n LEFT JOIN v USING (doc_id)""")
def p09_repaired_cnpj(spark: SparkSession, d: str) -> DataFrame:
    """Badly read tax numbers, and whether the repair gives the one that was there."""
    rows = view(spark, d, "fx_noisy").withColumn("digits", F.nullif(X.digits(noisy.repaired_cnpj(F.col("read_cnpj"))), F.lit("")))
    return rows.select("doc_id", "digits", F.coalesce(F.col("digits") == F.col("cnpj"), F.lit(False)).alias("planted"))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS pos FROM fx_noisy), k AS (SELECT doc_id, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos FROM l WHERE trim(line) <> ''),
w AS (SELECT doc_id, pos, line, concat_ws(' ', line, lead(line) OVER p, lead(line, 2) OVER p) AS near FROM k WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
t AS (SELECT doc_id, 'cnpj_fornecedor' AS field, pos, near FROM w WHERE regexp_matches(lower(line), '{noisy.CNPJ_LABELS["cnpj_fornecedor"]}') UNION ALL SELECT doc_id, 'cnpj_tomador', pos, near FROM w WHERE regexp_matches(lower(line), '{noisy.CNPJ_LABELS["cnpj_tomador"]}') UNION ALL SELECT doc_id, 'all', 0, raw_text FROM fx_noisy),
m AS (SELECT doc_id, field, pos, unnest(x) AS hit, generate_subscripts(x, 1) AS k FROM (SELECT *, regexp_extract_all(translate(near, 'OoIlSsBQ', '00115580'), '{noisy.CNPJ}') AS x FROM t) AS y),
v AS (SELECT doc_id, field, d, min(pos * 100 + k) AS spot FROM (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS d FROM m) AS z WHERE {_CHECKED} GROUP BY doc_id, field, d),
f AS (SELECT doc_id, arg_min(d, spot) FILTER (WHERE field = 'cnpj_fornecedor') AS one, arg_min(d, spot) FILTER (WHERE field = 'cnpj_tomador') AS two, list(d ORDER BY spot) FILTER (WHERE field = 'all') AS every FROM v GROUP BY doc_id)
SELECT n.doc_id, coalesce(one, every[1], '') AS cnpj_fornecedor, coalesce(two, CASE WHEN one IS NULL THEN every[2] END, '') AS cnpj_tomador FROM fx_noisy AS n LEFT JOIN f ON n.doc_id = f.doc_id""")
def p09_noisy_cnpjs(spark: SparkSession, d: str) -> DataFrame:
    """The parties' tax numbers of badly read texts."""
    rows = noisy.noisy_fields(view(spark, d, "fx_noisy"))
    return rows.select("doc_id", *[X.digits(F.col(f"noisy.{n}.value")).alias(n) for n in ("cnpj_fornecedor", "cnpj_tomador")])


@query()
def p09_noisy_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every field that can be read in badly read texts."""
    rows = noisy.noisy_fields(view(spark, d, "fx_noisy"))
    return rows.select("doc_id", *[c for n in noisy.SURE for c in (F.col(f"noisy.{n}.value").alias(n), F.col(f"noisy.{n}.conf").alias(f"{n}_conf"))])


# Template, line, name and what stands before the value, for each labelled line of fx_invoices.
_LABELLED = [
    (1, 0, "nota_fiscal_de_venda", "Nota Fiscal de venda - "), (1, 1, "fornecedor", "Fornecedor: "), (1, 2, "tomador", "Tomador: "), (1, 3, "cnpj", "CNPJ: "), (1, 4, "numero", "Numero: "),
    (1, 5, "descricao", "Descricao: "), (1, 6, "valor_total", "Valor total: "), (2, 3, "cedente", "Cedente: "), (3, 3, "beneficiario", "Beneficiario: "), (3, 5, "total", "Total: "),
    (4, 0, "energia_eletrica", "Energia eletrica - "), (4, 1, "unidade_consumidora", "Unidade consumidora: "), (4, 3, "vencimento", "Vencimento: "), (4, 4, "total_a_pagar", "Total a pagar: "),
    (5, 0, "condominio", "Condominio - "), (6, 1, "matricula", "Matricula: "), (6, 3, "consumo", "Consumo: "), (6, 4, "valor", "Valor - "),
]


@query(_L + f""" SELECT doc_id, CAST(place AS BIGINT) AS place, name, replace(l[place + 1], before, '') AS value FROM i JOIN (VALUES {", ".join(map(str, _LABELLED))}) AS v(t, place, name, before) ON template = t""")
def p10_label_value_fields(spark: SparkSession, d: str) -> DataFrame:
    return extract.label_value_fields(view(spark, d, "fx_invoices"))


@query("""
SELECT doc_id, name, value FROM (SELECT doc_id, 'numero_da_nfs_e' AS name, string_split(raw_text, chr(10))[3] AS value FROM fx_invoices WHERE template = 0
UNION ALL SELECT doc_id, 'nome', string_split(raw_text, chr(10))[6] FROM fx_invoices WHERE template = 0) AS t""")
def p11_stacked_label_fields(spark: SparkSession, d: str) -> DataFrame:
    labels = {"numero_da_nfs_e": r"n[úu]mero\s+da\s+nfs-?e", "nome": r"nome\s*/\s*nome\s*empresarial", "chave_de_acesso": r"chave\s+de\s+acesso"}
    return extract.stacked_label_fields(view(spark, d, "fx_invoices"), labels)


@query("SELECT document_id AS doc_id, 'cliente' AS name, json_extract_string(fields, '$.cliente') AS value FROM fx_results UNION ALL SELECT document_id, 'nota', json_extract_string(fields, '$.nota') FROM fx_results WHERE json_extract_string(fields, '$.nota') <> ''")
def p12_flatten_structured(spark: SparkSession, d: str) -> DataFrame:
    return extract.flatten_structured(view(spark, d, "fx_results"), "document_id", ("fields",))


def _digit(n: int) -> str:
    """Whether the check digit after the first n of 14 digits s is right."""
    weights = [k % 8 + 2 for k in range(n)][::-1]
    total = " + ".join(f"CAST(substr(s, {k + 1}, 1) AS INT) * {w}" for k, w in enumerate(weights))
    return f"CAST(substr(s, {n + 1}, 1) AS INT) = (11 - ({total}) % 11) % 11 % 10"


_FLAGS = f"""SELECT doc_id, template, template < 2 AS fornecedor_ok, template < 2 AS tomador_ok, template < 2 OR (template < 4 AND {_digit(12)} AND {_digit(13)}) AS cnpj_fornecedor_valido,
  template = 0 AND doc_id % 5 <> 0 AS cnpj_tomador_valido, template = 0 AS numero_nf_valido, template = 0 AS descricao_ok, template IN (0, 4) AND cents > 0 AS valor_valido, template < 2 AS retencao_ok,
  template = 0 AND doc_id % 5 <> 0 AS cnpj_tomador_validado, template > 0 AS required_missing FROM (SELECT *, lpad(CAST(doc_id AS VARCHAR), 14, '0') AS s FROM i) AS j"""
_PRESENT = {"fornecedor": (0, 1), "tomador": (0, 1), "cnpj_fornecedor": (0, 1, 2, 3), "numero_nf": (0,), "descricao_servico": (0,), "valor_nf": (0, 4), "retencao": (0, 1)}
_JSON = " || ',' || ".join(f"""'"{n}":' || CASE WHEN template IN ({", ".join(map(str, t))}) THEN 'true' ELSE 'false' END""" for n, t in _PRESENT.items())


@query(f"""{_L} SELECT * EXCLUDE (template), '{{' || {_JSON} || '}}' AS required_present FROM ({_FLAGS}) AS f""")
def p13_validate_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.validate_fields(quality.critical_fields(view(spark, d, "fx_invoices")))
    return rows.select("doc_id", *quality.FLAG.values(), "cnpj_tomador_validado", "required_missing", F.to_json("required_present").alias("required_present"))


_SHARE = " + ".join(f"CAST({f} AS INT)" for f in [*quality.FLAG.values(), "cnpj_tomador_validado"])


@query(f"""{_L}, q AS (SELECT doc_id, template, CAST({_SHARE} AS DOUBLE) / 9 AS fs, CAST({_by_template(t0="0.93", t1="0.275", t2="0.07", t3="0.07", t4="0.0725")} 0.0 END AS DOUBLE) AS oc FROM ({_FLAGS}) AS f), r AS (SELECT *, 0.4 * oc + 0.6 * fs AS fin FROM q)
SELECT doc_id, round(fs, 4) AS field_score, round(oc, 4) AS ocr_confidence, round(fin, 4) AS final_score, CASE WHEN template = 0 THEN '' ELSE {_ALL} END AS low_fields, template > 0 AS llm_should_run, template > 0 OR fin < 0.85 AS fallback_needed FROM r""")
def p14_field_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.field_quality(quality.validate_fields(quality.critical_fields(view(spark, d, "fx_invoices"))))
    return rows.select("doc_id", "field_score", "ocr_confidence", "final_score", F.array_join("low_fields", ",").alias("low_fields"), "llm_should_run", "fallback_needed")


_FEATURES = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 9 WHEN 0 THEN 'scan-nota.pdf' WHEN 1 THEN 'manuscrito.png' WHEN 2 THEN 'misto_scan.jpg' WHEN 3 THEN 'tabela.pdf' ELSE concat('doc', cast(o_orderkey as string), '.pdf') END AS filename,
  CASE WHEN o_orderkey % 9 IN (1) THEN 'png' WHEN o_orderkey % 9 = 2 THEN 'jpg' WHEN o_orderkey % 31 = 0 THEN 'doc' ELSE 'pdf' END AS ext, o_orderkey % 4 AS nr_pages, o_orderkey % 3 AS txtblocks, o_orderkey % 5 AS imgblocks,
  o_orderkey * 7 % 1200 AS text_chars, (o_orderkey % 50) / 1000.0 AS table_score, (o_custkey % 100) / 100.0 AS handwriting_score, (o_custkey % 7) / 7.0 AS image_like_ratio,
  CASE o_orderkey % 4 WHEN 0 THEN 'digital_pdf' WHEN 1 THEN 'scanned_image' WHEN 2 THEN 'handwritten_complex' ELSE 'other' END AS document_class,
  CASE o_orderkey % 7 WHEN 0 THEN ' PaddleOCR ' WHEN 1 THEN 'none' WHEN 2 THEN 'llama-parse' WHEN 3 THEN 'easyocr' WHEN 4 THEN '' ELSE 'tesseract' END AS selected_engine FROM orders"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return orders.sparkSession.sql(_FEATURES.replace("FROM orders", "FROM {orders}"), orders=orders)


@query(f"""WITH f AS ({_FEATURES}), g AS (SELECT *, nullif(nullif(nullif(lower(trim(selected_engine)), ''), 'none'), 'null') AS s FROM f)
SELECT doc_id, e AS engine, CASE WHEN document_class = 'digital_pdf' THEN CASE WHEN e = 'llamaparse' THEN 'docling' ELSE 'llamaparse' END WHEN document_class IN ('scanned_image', 'handwritten_complex') THEN CASE WHEN e = 'easyocr' THEN 'tesseract' ELSE 'easyocr' END ELSE 'tesseract' END AS fallback
FROM (SELECT *, coalesce(CASE s WHEN 'paddleocr' THEN 'paddle' WHEN 'llama-parse' THEN 'llamaparse' ELSE s END, CASE document_class WHEN 'digital_pdf' THEN 'docling' WHEN 'other' THEN 'tesseract' ELSE 'openrouter' END) AS e FROM g) AS t""")
def p15_p18_engines(spark: SparkSession, d: str) -> DataFrame:
    return classify.fallback_engine(classify.resolve_engine(_features(spark, d))).select("doc_id", "engine", "fallback")


@query("""
WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t, 60.0 + doc_id % 40 AS c, 1 + doc_id % 3 AS p FROM documents)
SELECT doc_id, c < 70 OR length(t) < 80 OR (p >= 2 AND length(t) / p < 90) OR len(string_split(t, ' ')) < 15 AS needs_fallback FROM t""")
def p16_needs_ocr_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "text", (F.lit(60.0) + F.col("doc_id") % 40).alias("avg_confidence"), (1 + F.col("doc_id") % 3).alias("page_count"))
    return quality.needs_ocr_fallback(rows, "text").select("doc_id", "needs_fallback")


@query(f"""WITH f AS ({_FEATURES}), g AS (SELECT *, regexp_matches(filename, '{"|".join(classify.NAME_SIGNALS["handwritten"])}') AS hn, regexp_matches(filename, '{"|".join(classify.NAME_SIGNALS["scanned"])}') AS sn,
  regexp_matches(filename, '{"|".join(classify.NAME_SIGNALS["table"])}') AS tn, regexp_matches(filename, '{"|".join(classify.NAME_SIGNALS["mixed"])}') AS mn FROM f)
SELECT doc_id, CASE WHEN ext = 'pdf' THEN CASE WHEN txtblocks > 0 AND txtblocks >= imgblocks AND NOT (hn AND NOT sn) THEN 'digital_pdf' WHEN nr_pages = 0 THEN 'scanned_image'
  WHEN text_chars >= 800 AND image_like_ratio <= 0.25 AND (table_score >= 0.015 OR tn) AND NOT hn THEN 'digital_pdf' WHEN (hn AND NOT sn) OR (handwriting_score >= 0.68 AND text_chars < 900) THEN 'handwritten_complex'
  WHEN text_chars >= 60 AND table_score >= 0.03 AND handwriting_score < 0.62 THEN 'digital_pdf' WHEN text_chars >= 120 AND handwriting_score < 0.58 THEN 'digital_pdf'
  WHEN sn AND text_chars < 80 THEN CASE WHEN mn OR handwriting_score >= 0.38 THEN 'handwritten_complex' ELSE 'scanned_image' END
  WHEN text_chars < 40 AND image_like_ratio >= 0.5 THEN CASE WHEN mn OR handwriting_score >= 0.62 THEN 'handwritten_complex' ELSE 'scanned_image' END
  WHEN (mn AND handwriting_score >= 0.56) OR handwriting_score >= 0.62 THEN 'handwritten_complex' ELSE 'digital_pdf' END
 WHEN ext IN ('png', 'jpg') THEN CASE WHEN hn AND NOT sn THEN 'handwritten_complex' WHEN mn AND handwriting_score >= 0.40 THEN 'handwritten_complex' WHEN handwriting_score >= 0.60 THEN 'handwritten_complex' ELSE 'scanned_image' END
 ELSE 'scanned_image' END AS document_class FROM g""")
def p17_route_by_features(spark: SparkSession, d: str) -> DataFrame:
    return classify.route_by_features(_features(spark, d)).select("doc_id", "document_class")


def _spec(spark: SparkSession) -> DataFrame:
    rows = [("boleto_default", 1, "valor", "decimal", "maior que zero", True), ("boleto_default", 2, "vencimento", "date", "", True), ("nota_fiscal_default", 1, "numero_nf", "string", "", True), ("nota_fiscal_default", 2, "obs", "string", None, False)]
    return spark.createDataFrame(rows, "schema_id string, seq int, name string, type string, rule string, required boolean")


_FIELDS = {"boleto_default": ("- valor* (decimal) — maior que zero\n- vencimento* (date)", ("valor", "vencimento")), "nota_fiscal_default": ("- numero_nf* (string)\n- obs (string)", ("numero_nf", "obs"))}
_FORMAT = {k: ",\n".join(f'  "{n}": {{"value": "", "confidence": 0.0}}' for n in names) for k, (_, names) in _FIELDS.items()}
_PROMPT = " ".join(
    f"WHEN '{k}' THEN 'Extraia os campos do documento e responda somente com JSON.\n\nCampos:\n{lines}\n\nTexto:\n' || raw_text || '\n\nFormato:\n{{\n{_FORMAT[k]}\n}}'" for k, (lines, _) in _FIELDS.items()
)


@query(f"""WITH p AS (SELECT c.doc_id, c.schema_id, CASE c.schema_id {_PROMPT} END AS prompt FROM ({_SCHEMA}) AS c JOIN fx_invoices AS i ON i.doc_id = c.doc_id WHERE c.schema_id IN ('boleto_default', 'nota_fiscal_default'))
SELECT doc_id, schema_id, length(prompt) AS n_chars, sha256(prompt) AS prompt_sha256 FROM p""")
def p19_render_prompts(spark: SparkSession, d: str) -> DataFrame:
    docs = classify.schema_classify(view(spark, d, "fx_invoices"))
    return extract.render_prompts(docs, _spec(spark)).select("doc_id", "schema_id", F.length("prompt").cast("long").alias("n_chars"), F.sha2("prompt", 256).alias("prompt_sha256"))


_FENCED = """CASE WHEN substr(document_id, 12, 1) = '5' THEN concat('```json', chr(10), fields, chr(10), '```') ELSE fields END"""
_ANSWERS = f"SELECT document_id AS doc_id, {_FENCED} AS response, fields, confidence FROM fx_results"
_BROKEN = f"SELECT document_id AS doc_id, CASE WHEN substr(document_id, 12, 1) = '3' THEN substr(fields, 1, 44) ELSE {_FENCED} END AS response, fields, confidence FROM fx_results"


def _answers(spark: SparkSession, d: str, sql: str) -> DataFrame:
    rows = view(spark, d, "fx_results")
    return rows.sparkSession.sql(sql.replace("FROM fx_results", "FROM {r}"), r=rows)


@query(f"""WITH a AS ({_ANSWERS})
SELECT doc_id, 'valor' AS name, json_extract_string(fields, '$.valor.value') AS value, CAST(json_extract_string(fields, '$.valor.confidence') AS DOUBLE) AS confidence FROM a
UNION ALL SELECT doc_id, 'nota', coalesce(nullif(json_extract_string(fields, '$.nota'), ''), '{extract.PLACEHOLDER}'), CASE WHEN json_extract_string(fields, '$.nota') = '' THEN 0.0 ELSE 0.5 END FROM a""")
def p20_parse_responses(spark: SparkSession, d: str) -> DataFrame:
    return extract.parse_responses(_answers(spark, d, _ANSWERS), ["valor", "nota"])


@query()
def p20_parse_broken_responses(spark: SparkSession, d: str) -> DataFrame:
    return extract.parse_responses(_answers(spark, d, _BROKEN), ["valor", "nota"])


@query("""SELECT document_id AS doc_id, CASE WHEN substr(document_id, 12, 1) IN ('1', '2') THEN concat('linha um', chr(10), document_id) ELSE concat('a: 1', chr(10), 'cliente: ', json_extract_string(fields, '$.cliente')) END AS text, false AS parse_error FROM fx_results""")
def p22_ocr_json_to_text(spark: SparkSession, d: str) -> DataFrame:
    name = F.get_json_object("fields", "$.cliente")
    text = F.when(F.substring("document_id", 12, 1) == "1", F.concat(F.lit('{"extracted_text":"linha um\\n'), "document_id", F.lit('","key_values":{}}')))
    text = text.when(F.substring("document_id", 12, 1) == "2", F.concat(F.lit('```json {"extracted_text": "linha um\\n'), "document_id"))
    text = text.otherwise(F.concat(F.lit('{"extracted_text":"","key_values":{"cliente":"'), name, F.lit('","a":1}}')))
    rows = view(spark, d, "fx_results").select(F.col("document_id").alias("doc_id"), text.alias("response"))
    return extract.ocr_json_to_text(rows).select("doc_id", "text", "parse_error")


@query("""
WITH s AS (SELECT doc_id, length(raw_text) AS n, regexp_matches(raw_text, '\\d{2}/\\d{2}/\\d{4}') AS a, regexp_matches(raw_text, 'R\\$\\s*[\\d.]+,\\d{2}|\\d+,\\d{2}') AS b, regexp_matches(raw_text, '\\d{6,}') AS c FROM fx_invoices),
r AS (SELECT *, round(0.4 * least(100.0, CAST(n AS DOUBLE) / 40) + 0.6 * (CAST(CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) AS DOUBLE) / 3) * 100, 2) AS signal_score FROM s)
SELECT doc_id, signal_score, signal_score < 70 OR NOT (a AND b AND c) AS signal_fallback FROM r""")
def p24_text_signal_score(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_signal_score(view(spark, d, "fx_invoices")).select("doc_id", "signal_score", "signal_fallback")


_RULES = [
    ("s", "valor", "decimal", None, None, 0.01, 400000.0, True), ("s", "vencimento", "date", None, None, None, None, True), ("s", "cnpj", "cnpj", None, None, None, None, False),
    ("s", "linha", "digits", r"^\d{47}$", None, None, None, False), ("s", "retido", "boolean", None, None, None, None, False),
]


@query("""
WITH v AS (SELECT doc_id, cents, cnpj_two, doc_id % 3 AS k FROM fx_invoices)
SELECT doc_id, 'valor' AS name, CASE WHEN k = 0 THEN NULL ELSE concat(CAST(cents // 100 AS VARCHAR), '.', lpad(CAST(cents % 100 AS VARCHAR), 2, '0')) END AS normalised,
  CASE WHEN k = 0 THEN 'required' WHEN cents > 40000000 OR cents < 1 THEN 'out of range' END AS reason FROM v
UNION ALL SELECT doc_id, 'cnpj', CASE WHEN doc_id % 5 <> 0 THEN cnpj_two END, CASE WHEN doc_id % 5 = 0 THEN 'not a cnpj' END FROM v
UNION ALL SELECT doc_id, 'retido', CASE k WHEN 0 THEN 'true' WHEN 1 THEN 'false' END, CASE k WHEN 2 THEN 'not a boolean' END FROM v
UNION ALL SELECT doc_id, 'livre', 'x', NULL FROM v""")
def p25_apply_post_processing(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "fx_invoices").withColumn("k", F.col("doc_id") % 3)
    money = F.concat((F.expr("cents div 100")).cast("string"), F.lit(","), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    parts = F.array(
        F.struct(F.lit("valor").alias("name"), F.when(F.col("k") == 0, F.lit("-")).otherwise(F.concat(F.lit("R$ "), money)).alias("value")),
        F.struct(F.lit("cnpj").alias("name"), X.cnpj_format(F.col("cnpj_two")).alias("value")),
        F.struct(F.lit("retido").alias("name"), F.when(F.col("k") == 0, "Retido").when(F.col("k") == 1, "Não retido").otherwise("talvez").alias("value")),
        F.struct(F.lit("livre").alias("name"), F.lit("x").alias("value")),
    )
    fields = rows.select("doc_id", F.lit("s").alias("schema_id"), F.inline(parts))
    rules = spark.createDataFrame(_RULES, "schema_id string, name string, kind string, pattern string, allowed string, least double, most double, required boolean")
    out = quality.apply_post_processing(fields, rules)
    return out.select("doc_id", "name", "normalised", "reason")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
c AS (SELECT doc_id, pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM l), n AS (SELECT 'the_thing' AS name, 'the thing' AS word UNION ALL SELECT 'that', 'that')
SELECT d.doc_id, n.name, arg_min(c.line, c.pos) AS line, CASE WHEN count(c.pos) > 0 THEN 0.5 ELSE 0.0 END AS confidence, CASE WHEN count(c.pos) > 0 THEN 'candidate' ELSE 'missing' END AS state
FROM documents AS d CROSS JOIN n LEFT JOIN c ON c.doc_id = d.doc_id AND c.line <> '' AND contains(lower(c.line), n.word) GROUP BY d.doc_id, n.name""")
def p26_source_line_preview(spark: SparkSession, d: str) -> DataFrame:
    return extract.source_line_preview(table(spark, d, "documents"), ["the_thing", "that"], text_col="text")


@query("""SELECT doc_id, array_to_string(regexp_extract_all(raw_text, '\\d{2}\\.\\d{3}\\.\\d{3}/\\d{4}-\\d{2}'), '|') AS cnpjs, array_to_string(regexp_extract_all(raw_text, '\\d{2}/\\d{2}/\\d{4}'), '|') AS dates,
  array_to_string(regexp_extract_all(raw_text, 'R\\$\\s*[\\d.]+,\\d{2}'), '|') AS amounts FROM fx_invoices""")
def p27_find_invoice_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = extract.find_invoice_tokens(view(spark, d, "fx_invoices"))
    return rows.select("doc_id", *[F.array_join(c, "|").alias(c) for c in ("cnpjs", "dates", "amounts")])


@query("""
WITH a AS (SELECT doc_id, lower(raw_text) AS t, raw_text FROM fx_invoices), p AS (
  SELECT doc_id, 'pagamento' AS section, least(nullif(strpos(t, 'vencimento'), 0), nullif(strpos(t, 'linha digitavel'), 0)) AS first, raw_text FROM a
  UNION ALL SELECT doc_id, 'consumo', nullif(strpos(t, 'consumo'), 0), raw_text FROM a)
SELECT doc_id, section, first, substr(raw_text, first, coalesce(lead(first) OVER (PARTITION BY doc_id ORDER BY first, section), length(raw_text) + 1) - first) AS text FROM p WHERE first IS NOT NULL""")
def p29_segment_sections(spark: SparkSession, d: str) -> DataFrame:
    return extract.segment_sections(view(spark, d, "fx_invoices"), {"pagamento": ["vencimento", "linha digitavel"], "consumo": ["consumo"]})


#: Phrases that an amount of fx_invoices should be near, and those that speak against it.
_AMOUNTS = {"valor": (["vencimento", "total a pagar", "valor total", "Valor do Serviço"], ["retencao", "retido", "consumo"]), "retencao": (["retencao", "retido"], ["valor total", "total a pagar", "tributacao federal"])}


def _amounts_sql() -> str:
    folded = {f: [[w.lower().replace("ç", "c") for w in words] for words in both] for f, both in _AMOUNTS.items()}
    phrases = ", ".join(f"('{f}', '{w}', {side})" for f, both in folded.items() for side, words in enumerate(both) for w in words)
    return f"""WITH t AS (SELECT doc_id, translate(lower(raw_text), '{X.ACCENTS[0]}', '{X.ACCENTS[1]}') AS t FROM fx_invoices), p AS (SELECT doc_id, t, unnest(range(1, length(t) + 1)) AS p FROM t),
a AS (SELECT doc_id, p - 1 AS spot, regexp_extract(substr(t, p, 20), '^\\d{{1,3}}(\\.\\d{{3}})*,\\d{{2}}') AS value FROM p WHERE substr(t, p, 1) BETWEEN '0' AND '9' AND (p = 1 OR NOT regexp_matches(substr(t, p - 1, 1), '[0-9.,]')) AND regexp_matches(substr(t, p, 20), '^\\d{{1,3}}(\\.\\d{{3}})*,\\d{{2}}([^0-9]|$)')),
w(field, word, side) AS (VALUES {phrases}), h AS (SELECT doc_id, field, side, p - 1 AS first, p - 1 + length(word) AS last FROM p JOIN w ON substr(t, p, 1) = substr(word, 1, 1) AND substr(t, p, length(word)) = word),
g AS (SELECT a.doc_id, f.field, a.spot, a.value, min(CASE WHEN h.last <= a.spot THEN a.spot - h.last ELSE h.first - a.spot - length(a.value) END) FILTER (WHERE side = 0) AS good, min(CASE WHEN h.last <= a.spot THEN a.spot - h.last ELSE h.first - a.spot - length(a.value) END) FILTER (WHERE side = 1) AS bad
  FROM a CROSS JOIN (SELECT DISTINCT field FROM w) AS f LEFT JOIN h ON h.doc_id = a.doc_id AND h.field = f.field GROUP BY ALL),
n AS (SELECT doc_id, field, spot, value, CASE WHEN good <= 120 THEN good END AS good, CASE WHEN bad <= 120 THEN bad END AS bad FROM g)
SELECT doc_id, field, arg_min(value, coalesce(good, 1000) * 1000000 + spot) AS value, min(good) AS distance FROM n WHERE NOT (bad IS NOT NULL AND (good IS NULL OR bad < good)) GROUP BY doc_id, field"""


@query(_amounts_sql())
def p29_chosen_amounts(spark: SparkSession, d: str) -> DataFrame:
    """The amount nearest to the right phrases and not to the wrong ones."""
    return context.chosen_amounts(view(spark, d, "fx_invoices"), _AMOUNTS)


@query(r"""
SELECT doc_id, trim(regexp_replace(raw_text, '\s+', ' ', 'g')) AS clean, regexp_replace(raw_text, '[^0-9]', '', 'g') AS digits, doc_id % 5 <> 0 AS valid_two, true AS valid_one,
  concat(substr(cnpj, 1, 2), '.', substr(cnpj, 3, 3), '.', substr(cnpj, 6, 3), '/', substr(cnpj, 9, 4), '-', substr(cnpj, 13, 2)) AS formatted,
  CAST(cents AS DOUBLE) / 100 AS loose, CASE WHEN cents > 0 THEN CAST(cents AS DOUBLE) / 100 END AS strict
FROM fx_invoices""")
def x_scalars(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "fx_invoices")
    money = F.concat(F.lit("R$ "), F.expr("cents div 100").cast("string"), F.lit(","), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    c = F.col
    return rows.select(
        "doc_id", X.clean_line(c("raw_text")).alias("clean"), X.digits(c("raw_text")).alias("digits"), X.cnpj_valid(c("cnpj_two")).alias("valid_two"), X.cnpj_valid(c("cnpj")).alias("valid_one"),
        X.cnpj_format(c("cnpj")).alias("formatted"), X.currency_loose(money).alias("loose"), X.currency_strict(money).alias("strict"),
    )


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS pos FROM fx_noisy)
SELECT doc_id, string_agg(array_to_string(list_transform(string_split(line, ' '), lambda x: CASE WHEN length(x) >= 2 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '^[0-9/.,\-OoIlSBZ]+$') THEN translate(x, 'OoIlSBZ', '0011582') ELSE x END), ' '), chr(10) ORDER BY pos) AS fixed FROM l GROUP BY doc_id""")
def x20_numeric_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Badly read tokens of numbers set right, line by line."""
    fixed = F.transform(F.split("raw_text", "\n"), X.numeric_token_fix)
    return view(spark, d, "fx_noisy").select("doc_id", F.array_join(fixed, "\n").alias("fixed"))


@query(f"""
WITH t AS (SELECT doc_id, text, translate(lower(coalesce(text, '')), '{X.ACCENTS[0]}', '{X.ACCENTS[1]}') AS low FROM documents),
k AS (SELECT *, regexp_replace(regexp_replace(low, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS k FROM t)
SELECT doc_id, left(CASE WHEN regexp_matches(k, '^[0-9]') THEN concat('campo_', k) ELSE k END, 64) AS key, trim(regexp_replace(low, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS norm,
  translate(text, 'OoIlSsBQ', '00115580') AS fixed FROM k""")
def x_text_keys(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.snake_key(t).alias("key"), X.search_norm(t).alias("norm"), X.ocr_digit_fix(t).alias("fixed"))


@query(f"""
WITH t AS (SELECT doc_id, text, length(regexp_replace(coalesce(text, ''), '[^A-Za-zÀ-ÿ]', '', 'g')) AS letters, length(regexp_replace(coalesce(text, ''), '[^A-Za-zÀ-ÿ0-9]', '', 'g')) AS known FROM documents)
SELECT doc_id, doc_id % 3 = 1 AS is_date, letters < 10 OR letters / greatest(1, known) < 0.45 AS is_low_quality,
  CASE doc_id % 4 WHEN 0 THEN 50.0 WHEN 1 THEN 88.0 WHEN 2 THEN 100.0 ELSE 0.0 END AS confidence,
  CASE doc_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.88 WHEN 2 THEN 1.0 ELSE 0.0 END AS ratio,
  trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) = '' AS is_blank FROM t""")
def x_checks(spark: SparkSession, d: str) -> DataFrame:
    """X07, X13, X14, X15 over whole texts and values made of their ids."""
    t, k = F.col("text"), F.col("doc_id")
    day = F.when(k % 3 == 0, "31/12/199").when(k % 3 == 1, F.format_string(" %02d/99/2024 ", k % 100)).otherwise("2024-01-01")
    first = F.when(k % 4 == 0, "0.5").when(k % 4 == 1, "n/a").when(k % 4 == 2, "250")
    second = F.when(k % 4 == 1, F.lit(88.0)).when(k % 4 == 3, F.lit(-3.0))
    conf = X.avg_confidence(first, second)
    return table(spark, d, "documents").select("doc_id", X.is_date_text(day).alias("is_date"), X.is_low_quality_text(t).alias("is_low_quality"), conf.alias("confidence"), X.confidence_ratio(conf / 100).alias("ratio"), X.is_blank(t).alias("is_blank"))
