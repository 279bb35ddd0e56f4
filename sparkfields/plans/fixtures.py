"""Tables of documents, events and fields derived from the given tables.

Each is one SQL text that Spark and other engines read alike, so that the same
text serves the queries and their oracles.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _money(cents: str) -> str:
    whole = f"cast(floor({cents} / 100) as bigint)"
    high = f"cast(floor({cents} / 100000) as bigint)"
    return (
        f"concat(case when {high} > 0 then concat(cast({high} as string), '.', lpad(cast({whole} % 1000 as string), 3, '0')) "
        f"else cast({whole} as string) end, ',', lpad(cast({cents} % 100 as string), 2, '0'))"
    )


def _check(total: str) -> str:
    """Check digit of a weighted sum: 11 less the rest of 11, and 0 for 10 and 11."""
    return f"(11 - ({total}) % 11) % 11 % 10"


def _cnpj(lead: int, last: str) -> str:
    """SQL of 14 digits: lead, 0, the digits a, b, c, 000000, lead, and two check digits."""
    return f"concat('{lead}0', cast(a as string), cast(b as string), cast(c as string), '000000', '{lead}', cast(d as string), cast({last} as string))"


def _formatted(c: str) -> str:
    return f"concat(substr({c}, 1, 2), '.', substr({c}, 3, 3), '.', substr({c}, 6, 3), '/', substr({c}, 9, 4), '-', substr({c}, 13, 2))"


def _text(*lines: str) -> str:
    parts = []
    for k, line in enumerate(lines):
        parts += (["chr(10)"] if k else []) + [line]
    return f"concat({', '.join(parts)})"


_LINHA = "concat('12345.', lpad(cast(o_orderkey as string), 5, '0'), ' 12345.123456 12345.123456 1 ', lpad(cast(o_orderkey as string), 14, '0'))"

INVOICES = f"""
SELECT o_orderkey AS doc_id, o_orderkey % 8 AS template, cents, cnpj, cnpj_two,
  CASE o_orderkey % 8
  WHEN 0 THEN {_text("'DANFSE Documento auxiliar da NFS-e'", "'Numero da NFS-e'", "cast(o_orderkey as string)", "'Emitente da NFS-e'", "'Nome / Nome Empresarial'",
    "concat('SERVICOS GERAIS ', upper(c_mktsegment), ' LTDA')", "'CNPJ / CPF / NIF'", "cnpj_text", "'Tomador do Servico'", "cnpj_two_text",
    "concat('CONDOMINIO EDIFICIO ', upper(n_name))", "'Servico Prestado'", "'Descricao do Servico'", "concat('Manutencao predial do mes, pedido ', cast(o_orderkey as string))",
    "'Tributacao Municipal'", "'Valor do Servico'", "concat('R$ ', money)", "'ISSQN retido'", "'R$ 10,00'", "'Tributacao Federal'", "'sem valores'", "'Informacoes complementares'")}
  WHEN 1 THEN {_text("'Nota Fiscal de venda - NFE'", "concat('Fornecedor: Comercio ', c_mktsegment, ' Ltda')", "concat('Tomador: ', c_name, ' ', n_name)", "concat('CNPJ: ', cnpj_text)",
    "concat('Numero: ', cast(1000 + o_orderkey as string))", "concat('Descricao: entrega de produtos do pedido ', cast(o_orderkey as string))", "concat('Valor total: R$ ', money)",
    "'ICMS e IPI inclusos, retencao: 10,00'", "concat('Chave de acesso ', repeat('1234', 11))")}
  WHEN 2 THEN {_text("'Caixa Economica Federal 104'", "'boleto'", "concat('linha digitavel ', linha)", "concat('Cedente: Loja ', c_mktsegment)", "concat('Vencimento ', day_text)", "concat('Valor R$ ', money)")}
  WHEN 3 THEN {_text("'Banco do Brasil 001 boleto'", "concat('Linha digitavel ', linha)", "'nosso numero 123 pagador'", "concat('Beneficiario: Loja ', c_mktsegment)", "concat('Vencimento ', day_text)", "concat('Total: ', money)")}
  WHEN 4 THEN {_text("'Energia eletrica - distribuidora local'", "concat('Unidade consumidora: UC ', cast(o_custkey as string))", "concat('Consumo ', cast(o_orderkey % 900 as string), ' kWh')", "concat('Vencimento: ', day_text)", "concat('Total a pagar: R$ ', money)")}
  WHEN 5 THEN {_text("'Condominio - rateio mensal'", "concat('Unidade ', cast(o_custkey as string))", "'sindico e assembleia'", "concat('Vencimento ', day_text)", "concat('boleto, valor: ', money)")}
  WHEN 6 THEN {_text("'Fatura de agua e esgoto'", "concat('Matricula: ', cast(o_custkey as string))", "'leitura do hidrometro'", "concat('Consumo: ', cast(o_orderkey % 90 as string), ' m3')", "concat('Valor - R$ ', money)")}
  ELSE CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('recibo simples de ', c_name, '  pedido', chr(9), cast(o_orderkey as string)) END
  END AS raw_text
FROM (
  SELECT o_orderkey, o_custkey, c_mktsegment, c_name, n_name, cents, {_money("cents")} AS money, cnpj, cnpj_two, {_formatted("cnpj")} AS cnpj_text, {_formatted("cnpj_two")} AS cnpj_two_text,
    {_LINHA} AS linha, concat(lpad(cast(day(o_orderdate) as string), 2, '0'), '/', lpad(cast(month(o_orderdate) as string), 2, '0'), '/', cast(year(o_orderdate) as string)) AS day_text
  FROM (
    SELECT o_orderkey, o_custkey, o_orderdate, c_mktsegment, c_name, n_name, cents, {_cnpj(1, "e")} AS cnpj, {_cnpj(2, "CASE WHEN o_orderkey % 5 = 0 THEN (f + 1) % 10 ELSE f END").replace("(d as", "(g as")} AS cnpj_two
    FROM (
      SELECT *, {_check("9 + 4 * a + 3 * b + 2 * c + 2 * d")} AS e, {_check("18 + 4 * a + 3 * b + 2 * c + 2 * g")} AS f
      FROM (
        SELECT *, {_check("7 + 3 * a + 2 * b + 9 * c")} AS d, {_check("14 + 3 * a + 2 * b + 9 * c")} AS g
        FROM (
          SELECT o.*, c.c_mktsegment, c.c_name, n.n_name, cast(round(o_totalprice * 100) as bigint) AS cents,
            o_custkey % 10 AS a, cast(floor(o_custkey / 10) as bigint) % 10 AS b, cast(floor(o_custkey / 100) as bigint) % 10 AS c
          FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey
        ) AS q
      ) AS r
    ) AS s
  ) AS u
) AS t
"""

DOCUMENTS = """
SELECT concat('doc-', lpad(cast(o_orderkey as string), 8, '0')) AS id, n_name AS tenant_id,
  CASE WHEN o_orderkey % 11 = 0 THEN 'OCR_FAILED' WHEN o_orderkey % 13 = 0 THEN 'RECEIVED' WHEN o_orderstatus = 'F' THEN 'APPROVED' WHEN o_orderstatus = 'P' THEN 'REJECTED'
    WHEN o_orderkey % 3 = 0 THEN 'EXTRACTION_COMPLETED' ELSE 'VALIDATION_PENDING' END AS status,
  CASE WHEN o_orderpriority < '3' THEN 'email' WHEN o_orderpriority < '5' THEN 'whatsapp' ELSE 'manual' END AS channel,
  CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE concat('Pedido-', cast(o_orderkey % 1000 as string), '.pdf') END AS original_filename,
  'application/pdf' AS content_type, o_orderkey * 37 % 5000000 AS size_bytes, concat('h', cast(o_custkey as string)) AS sha256,
  CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' WHEN o_orderkey % 4 = 1 THEN 'digital_pdf' ELSE 'scanned_image' END AS document_type,
  CASE o_orderkey % 5 WHEN 0 THEN 'boleto_caixa' WHEN 1 THEN 'boleto_bb' WHEN 2 THEN 'fatura_energia' WHEN 3 THEN 'generic' ELSE '' END AS layout,
  o_orderdate AS received_at, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS updated_at,
  concat('{"metadata_channel":"', CASE WHEN o_orderkey % 2 = 0 THEN 'web' ELSE '' END, '","ocr":"', cast(o_orderkey % 7 as string), '"}') AS metadata, o_orderkey, o_custkey
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

RESULTS = """
SELECT concat('doc-', lpad(cast(o_orderkey as string), 8, '0')) AS document_id, CASE o_orderkey % 3 WHEN 0 THEN 'nota_fiscal_default' WHEN 1 THEN 'boleto_default' ELSE 'legacy_ocr' END AS schema_id, 'v1' AS schema_version,
  concat('{"valor":{"value":"', cast(cast(round(o_totalprice * 100) as bigint) as string), '","confidence":0.', cast(1 + o_orderkey % 9 as string), '},"cliente":"', c_name,
    '","nota":"', CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN 'Valor não encontrado' ELSE o_orderpriority END, '"}') AS fields,
  (1 + o_orderkey % 9) / 10.0 AS confidence, o_orderkey % 3 = 0 AS requires_human_validation
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 <> 9
"""

DECISIONS = """
SELECT concat('doc-', lpad(cast(l_orderkey as string), 8, '0')) AS document_id, seq, CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE CASE WHEN seq % 5 = 0 THEN 'maybe' ELSE 'corrected' END END AS decision,
  CASE WHEN seq % 4 = 0 THEN '  ' ELSE concat('nota ', cast(l_partkey as string)) END AS notes, l_shipdate AS created_at, cast(l_partkey as string) AS corrected_value
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax, l_discount) AS seq FROM lineitem) AS t
"""

VERSIONS = """
SELECT concat('doc-', lpad(cast(l_orderkey as string), 8, '0')) AS document_id, cast(v as int) AS version_number, name, value, confidence,
  v = max(v) OVER (PARTITION BY l_orderkey) AS is_active
FROM (
  SELECT l_orderkey, v, 'quantidade' AS name, cast(cast(l_quantity % 4 as bigint) as string) AS value, 1.0 - l_discount AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax, l_discount) AS v FROM lineitem) AS a
  UNION ALL
  SELECT l_orderkey, v, 'imposto', cast(cast(round(l_tax * 100) as bigint) as string), 0.5 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax, l_discount) AS v FROM lineitem) AS b WHERE l_linenumber % 2 = 0
) AS t
"""

EVENTS = """
SELECT event_id * 2 + copy AS stream_offset, concat('evt-', cast(event_id as string)) AS event_id,
  CASE event_type WHEN 'view' THEN 'document.received' WHEN 'click' THEN 'ocr.completed' WHEN 'signup' THEN 'extraction.completed' WHEN 'purchase' THEN 'erp.sent' ELSE CASE WHEN event_id % 6 = 0 THEN 'bogus.event' ELSE 'erp.failed' END END AS event_type,
  CASE WHEN event_id % 41 = 0 THEN 'v2' ELSE 'v1' END AS event_version, ts AS occurred_at, CASE WHEN event_id % 29 = 0 THEN ' ' ELSE concat('tenant-', cast(user_id % 5 as string)) END AS tenant_id,
  concat('doc-', cast(user_id as string)) AS document_id, 'bus' AS source, CASE WHEN event_id % 37 = 0 THEN 1.0 + value ELSE (event_id % 100) / 100.0 END AS confidence,
  event_id % 3 = 0 AS requires_human_validation, value, event_id AS seq
FROM (SELECT *, 0 AS copy FROM events UNION ALL SELECT *, 1 AS copy FROM events WHERE event_id % 7 = 0) AS e
"""

_UUID = "concat('00000000-0000-4000-8000-', lpad(cast({} as string), 12, '0'))"
_DATA = {
    "document.received": """'{"channel":"email","file":{"uri":"local://a","content_type":"application/pdf","filename":"f.pdf","size_bytes":', cast(seq % 9000 as string), ',"sha256":"', repeat('a', 64), '"},"received_at":"2024-01-02T03:04:05","metadata":{"k":[1]}}'""",
    "ocr.completed": """'{"raw_text_uri":"local://t","document_type":"digital_pdf","engine_used":"one","confidence":0.', cast(seq % 100 as string), ',"processing_time_seconds":1.5,"artifacts":{"a":"b"},"metadata":{}}'""",
    "ocr.failed": """'{"reason":"timeout","retryable":true,"engine_used":null}'""",
    "layout.classified": """'{"layout":"boleto_bb","confidence":0.', cast(seq % 100 as string), ',"document_type":"unknown","requires_human_validation":false}'""",
    "extraction.completed": """'{"schema_id":"boleto","schema_version":"v1","fields":{"valor":"', cast(seq as string), '"},"confidence":0.5,"requires_human_validation":true,"metadata":{}}'""",
    "erp.integration.requested": """'{"connector":"erp-1","payload":{"valor":', cast(seq as string), '},"idempotency_key":"k"}'""",
    "erp.sent": """'{"connector":"erp-1","external_id":null,"idempotency_key":"k","response_metadata":{}}'""",
    "erp.failed": """'{"connector":"erp-1","reason":"refused","retryable":false,"idempotency_key":"k"}'""",
}
#: What is changed in a whole event, by turns: (old, new) texts; the last ones are whole events.
_FAULTS = [
    ('"v1","occ', '"v2","occ'), ('"tenant_id":"t1",', ""), ('"tenant_id":"t1"', '"tenant_id":""'), ("05Z", "05"), ('{"event_id"', '{"more":1,"event_id"'), ('"data":{', '"data":{"more":1,'), ('"file":{', '"file":{"more":1,'), ('"confidence":0.', '"confidence":7.'),
    ('"confidence":0.', '"confidence":"0.'), ('aaaa"', 'aaa"'), ('"size_bytes":', '"size_bytes":-1'), ('"metadata":{', '"metadata":[1],"x":{'), ('"document_id":"0', '"document_id":"g'), ('"retryable":', '"retryable":"no","retryable2":'), ('"requires_human_validation":', '"requires_human_validation":3,"other":'),
    ('"source":"bus"', '"source":null'), ('"channel":"email"', '"channel":"fax"'), ('{"a":"b"}', '{"a":1}'), ('"connector":"erp-1",', ""), ("2024-01-02T03:04:05Z", "2024-13-02T03:04:05Z"), ('"data":{', '"data":[],"data2":{'), ('"event_type":"', '"event_type":"x'), ('"reason":"', '"reason":5,"why":"'),
    ('"received_at":"2024', '"received_at":"today'), ('"schema_id":"boleto"', '"schema_id":null'), ('"idempotency_key":"k"', '"idempotency_key":""'), ('"processing_time_seconds":1.5', '"processing_time_seconds":-1'), ('"processing_time_seconds":1.5', '"processing_time_seconds":"1.5"'),
]


def _payloads() -> str:
    names = list(_DATA)
    kind = "CASE seq % 8 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"
    data = "CASE seq % 8 " + " ".join(f"WHEN {k} THEN concat({_DATA[n]})" for k, n in enumerate(names)) + " END"
    whole = f"""concat('{{"event_id":"', {_UUID.format("seq")}, '","event_type":"', {kind}, '","event_version":"v1","occurred_at":"2024-01-02T03:04:05Z","tenant_id":"t1","document_id":"', {_UUID.format("user_id")}, '","correlation_id":"', {_UUID.format("seq")}, '","source":"bus","data":', {data}, '}}')"""
    faults = " ".join(f"WHEN {k + 1} THEN replace(whole, '{a}', '{b}')" for k, (a, b) in enumerate(_FAULTS))
    n = len(_FAULTS) + 1
    return f"""SELECT seq, CASE fault {faults} WHEN {n} THEN substr(whole, 2) WHEN {n + 1} THEN concat('[', whole, ']') WHEN {n + 2} THEN NULL ELSE whole END AS payload
FROM (SELECT seq, cast(floor(seq / 8) as bigint) % {n + 3} AS fault, {whole} AS whole FROM (SELECT event_id AS seq, user_id FROM events) AS e) AS w"""


PAYLOADS = _payloads()

#: Invoices whose tax numbers are badly read: letters for digits, or one digit for another, and the amount's marks lost.
NOISY = f"""
SELECT doc_id, template, cnpj, kind, CASE kind WHEN 0 THEN translate(mark, '0158', 'OISB') WHEN 1 THEN concat(substr(mark, 1, 3), translate(substr(mark, 4, 1), '0123456789', '8778965134'), substr(mark, 5)) ELSE mark END AS read_cnpj,
  replace(replace(raw_text, mark, CASE kind WHEN 0 THEN translate(mark, '0158', 'OISB') WHEN 1 THEN concat(substr(mark, 1, 3), translate(substr(mark, 4, 1), '0123456789', '8778965134'), substr(mark, 5)) ELSE mark END), CASE WHEN doc_id % 2 = 0 THEN 'R$' ELSE '#' END, 'RS') AS raw_text
FROM (SELECT doc_id, template, cnpj, raw_text, doc_id % 3 AS kind, {_formatted("cnpj")} AS mark FROM ({INVOICES}) AS i) AS j
"""

#: Results of two engines as JSON; some are broken or missing.
OCR = """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'oops' ELSE concat('{"raw_text":"', repeat('uma palavra ', cast(n_chars % 7 as int)), '","totals":{"grand_total":', cast(n_chars as string), '},"entities":{"a":"', coalesce(lang, ''), '"},"tables":[1],"_meta":{"x":1,"y":"', coalesce(source, ''), '"}}') END AS first,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE concat('{"raw_text":"', repeat('outra palavra ', cast(n_chars % 5 as int)), '","raw_text_fallback":"', CASE WHEN n_chars % 2 = 0 THEN '' ELSE 'f' END, '","totals":', CASE n_chars % 3 WHEN 0 THEN '{}' WHEN 1 THEN 'null' ELSE '{"grand_total":1}' END, ',"document_info":{"number":', cast(doc_id as string), '},"more":1,"_meta":{"y":2,"primary_engine":"old"}}') END AS second
FROM documents"""

VIEWS = {"fx_ocr": OCR, "fx_noisy": NOISY, "fx_payloads": PAYLOADS, "fx_invoices": INVOICES, "fx_documents": DOCUMENTS, "fx_results": RESULTS, "fx_decisions": DECISIONS, "fx_versions": VERSIONS, "fx_events": EVENTS}


def with_views(sql: str) -> str:
    """sql with the derived tables that it names in front."""
    named = [f"{name} AS ({text})" for name, text in VIEWS.items() if name in sql]
    body = sql.strip()
    if named and body.upper().startswith("WITH "):
        return f"WITH {', '.join(named)}, {body[5:]}"
    return f"WITH {', '.join(named)} {body}" if named else body


def view(spark: SparkSession, sf_dir: str, name: str, **streams: DataFrame) -> DataFrame:
    """One derived table over the tables of sf_dir, or over streams of them given by name."""
    if name in _BY_ORDER and not streams:
        return _BY_ORDER[name](spark, sf_dir)
    text = VIEWS[name]
    prefix = f"fx_{zlib.crc32(sf_dir.encode())}_" + "stream_" * bool(streams)
    for t in TABLES:
        if (changed := re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {prefix}{t}", text)) != text:
            read = streams[t] if t in streams else table(spark, sf_dir, t)
            (_dealt(read) if t == "orders" and t not in streams else read).createOrReplaceTempView(prefix + t)
            text = changed
    return spark.sql(text)


def _dealt(rows: DataFrame) -> DataFrame:
    """rows dealt to all cores, where their files make fewer tasks: what is read from their texts costs far more than dealing them out."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Lines of an order in the order of DECISIONS and VERSIONS, and the document of an order.
_TURN = "l_shipdate l_linenumber l_partkey l_suppkey l_extendedprice l_quantity l_tax l_discount".split()
_DOC = "concat('doc-', lpad(cast(l_orderkey as string), 8, '0'))"


def _numbered(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Lines with document_id, their number in the order, and whether they are its last.

    They are dealt by document once, to so many tasks that one sorts a part of a
    file's lines; what goes on by document then shuffles none of the rows that
    are made of them.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *_TURN, *more)
    n = max(spark.sparkContext.defaultParallelism, 32 * lines.rdd.getNumPartitions())
    order = Window.partitionBy("document_id", "l_orderkey").orderBy(*_TURN)
    dealt = lines.repartition(n, F.expr(_DOC)).withColumn("document_id", F.expr(_DOC))
    return dealt.withColumns({"n": F.row_number().over(order), "is_last": F.lead(F.lit(True)).over(order).isNull()})


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of DECISIONS."""
    lines = _numbered(spark, sf_dir, "l_returnflag")
    decision = "CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE CASE WHEN n % 5 = 0 THEN 'maybe' ELSE 'corrected' END END AS decision"
    notes = "CASE WHEN n % 4 = 0 THEN '  ' ELSE concat('nota ', cast(l_partkey as string)) END AS notes"
    return lines.selectExpr("document_id", "n AS seq", decision, notes, "l_shipdate AS created_at", "cast(l_partkey as string) AS corrected_value")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of VERSIONS: an order's last line is its highest version, as each line has a quantity."""
    lines = _numbered(spark, sf_dir)
    fields = """inline(filter(array(
      named_struct('name', 'quantidade', 'value', cast(cast(l_quantity % 4 as bigint) as string), 'confidence', 1.0 - l_discount),
      CASE WHEN l_linenumber % 2 = 0 THEN named_struct('name', 'imposto', 'value', cast(cast(round(l_tax * 100) as bigint) as string), 'confidence', cast(0.5 as double)) END), x -> x is not null))"""
    return lines.selectExpr("document_id", "cast(n as int) AS version_number", "is_last AS is_active", fields).select("document_id", "version_number", "name", "value", "confidence", "is_active")


#: Tables of order lines that Spark makes by document; the rows are those of their SQL.
_BY_ORDER = {"fx_decisions": _decisions, "fx_versions": _versions}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
