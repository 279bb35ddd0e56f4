"""Rules over literal rows: what each operator makes of them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkfields.functions import exprs as X
from sparkfields.operators import classify, events, extract, inbox, pages, quality, versions
from sparkfields.streaming import jobs

LAYOUTS = [
    ("Caixa Economica Federal 104 boleto linha digitavel cedente vencimento", "boleto_caixa"), ("Banco do Brasil 001 boleto linha digitavel cedente vencimento", "boleto_bb"),
    ("Bradesco 237 boleto linha digitavel beneficiario vencimento", "boleto_bradesco"), ("Energia eletrica kWh unidade consumidora consumo distribuidora vencimento", "fatura_energia"),
    ("Condominio unidade rateio assembleia sindico vencimento boleto", "fatura_condominio"), ("recibo simples sem layout conhecido", "generic"), ("", "generic"), (None, "generic"),
]


def test_layouts(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(LAYOUTS)], "doc_id int, raw_text string")
    out = {r.doc_id: r for r in classify.layout_classify(rows).collect()}
    assert [out[k].layout for k in range(len(LAYOUTS))] == [x for _, x in LAYOUTS]
    assert (out[5].confidence, out[5].requires_human_validation, out[6].confidence) == (0.35, True, 0.0)


def test_slip_and_bill(spark):
    texts = ["Beneficiario: ACME LTDA Vencimento 10/05/2026 Valor R$ 123,45 Linha digitavel 12345.12345 12345.123456 12345.123456 1 12345678901234", "Unidade 42 consumo 150 kWh vencimento 11/05/2026 total R$ 222,10"]
    rows = spark.createDataFrame([(t,) for t in texts], "raw_text string")
    slip, bill = extract.extract_boleto(rows).first(), extract.extract_fatura(rows).collect()[1]
    assert slip.valor == "R$ 123,45" and slip.confidence >= 0.75 and not slip.requires_human_validation
    assert (bill.consumo_kwh, bill.vencimento, bill.valor) == ("150", "11/05/2026", "R$ 222,10")


def check_digits(base):
    for weights in ([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]):
        rest = sum(int(d) * w for d, w in zip(base, weights, strict=True)) % 11
        base += str(0 if rest < 2 else 11 - rest)
    return base


def test_tax_numbers(spark):
    rng = random.Random(1)
    good = ["08.629.869/0001-01", "02.315.237/0001-97", "09769035000164"] + [check_digits("".join(rng.choices("0123456789", k=12))) for _ in range(40)]
    bad = ["12.345.678/0001-90", "11111111111111", "", None, "123"] + [g[:-1] + str((int(g[-1]) + 1) % 10) for g in good]
    rows = spark.createDataFrame([(g, True) for g in good] + [(b, False) for b in bad], "c string, ok boolean")
    assert rows.where(X.cnpj_valid(F.col("c")) != F.col("ok")).count() == 0


@pytest.mark.parametrize("text,loose,strict", [("1.234,56", 1234.56, 1234.56), ("R$ 10,5", 10.5, 10.5), ("1.234", 1.234, 1.234), ("-5", -5.0, None), ("0", 0.0, None), ("abc", None, None), ("NaN", None, None), ("1e3", None, None)])
def test_money(spark, text, loose, strict):
    r = spark.createDataFrame([(text,)], "t string").select(X.currency_loose(F.col("t")).alias("a"), X.currency_strict(F.col("t")).alias("b")).first()
    assert (r.a, r.b) == (loose, strict)


def test_text_scalars(spark):
    c = F.col("t")
    one = lambda text, e: spark.createDataFrame([(text,)], "t string").select(e.alias("x")).first().x
    assert one("Valor Líquido (R$)", X.snake_key(c)) == "valor_liquido_r" and one("13 salário", X.snake_key(c)) == "campo_13_salario"
    assert one("total l0O,5B texto", X.numeric_token_fix(c)) == "total 100,58 texto"
    assert one("Nome <a@b.c>", X.sender_address(c)) == "a@b.c" and one("a@b.c ", X.sender_address(c)) == "a@b.c"
    assert one("attachment; filename*=UTF-8''a%20b.pdf", X.disposition_filename(c)) == "a b.pdf"
    assert one("CNPJ / CPF / NIF", X.is_header_like(c)) and one("", X.is_header_like(c)) and not one("ACME LTDA", X.is_header_like(c))
    assert one("CONDOMINIO EDIFICIO SOL", X.name_score(c)) == pytest.approx(0.95) and one("12", X.name_score(c)) == 0


INVOICE = """DANFSE NFS-e
Número da NFS-e
123
Emitente da NFS-e
Nome / Nome Empresarial
SERVICOS GERAIS SOL LTDA
CNPJ / CPF / NIF
08.629.869/0001-01
Tomador do Serviço
02.315.237/0001-97
CONDOMINIO EDIFICIO LUA
Serviço Prestado
Descrição do Serviço
Manutenção predial do mês
Tributação Municipal
Valor do Serviço
R$ 1.234,56
ISSQN retido
R$ 10,00
Tributação Federal
Informações complementares"""


def test_critical_fields_and_quality(spark):
    rows = spark.createDataFrame([(1, INVOICE), (2, ""), (3, None), (4, "Fornecedor: Loja Azul\nTomador: Casa Verde\nNF nº 77\nTotal a pagar: R$ 5,00")], "doc_id int, raw_text string")
    out = {r.doc_id: r for r in quality.field_quality(quality.validate_fields(quality.critical_fields(rows))).collect()}
    a = out[1]
    assert (a.fornecedor.value, a.tomador.value, a.cnpj_fornecedor.value, a.cnpj_tomador.value) == ("SERVICOS GERAIS SOL LTDA", "CONDOMINIO EDIFICIO LUA", "08.629.869/0001-01", "02.315.237/0001-97")
    assert (a.numero_nf.value, a.numero_nf.conf, a.valor_nf.value, a.descricao_servico.value) == ("123", 0.94, "1.234,56", "Manutenção predial do mês")
    assert a.retencao.value == "ISSQN retido R$ 10,00" and a.field_score == 1.0 and not a.fallback_needed
    assert out[2].field_score == 0 and out[3].fallback_needed and out[4].fornecedor.value == "Loja Azul" and out[4].tomador.conf == 0.58 and out[4].valor_nf.value == "5,00"


def test_label_values(spark):
    text = "Cliente: Ana\nCliente: Ana\nCliente: Bia\nCNPJ: 123\nNFS-e: x\nValor - 10\nchave de acesso: 12\nA: b"
    out = extract.label_value_fields(spark.createDataFrame([(1, text)], "doc_id int, raw_text string")).orderBy("place").collect()
    assert [(r.name, r.value) for r in out] == [("cliente", "Ana"), ("cliente_2", "Bia"), ("valor", "10")]


def test_answers(spark):
    rows = [(1, '{"a":"x","b":null}'), (2, '```json\n{"a":{"value":"y","confidence":90}}\n```'), (3, '{"a":{"value":"z","confidence":0.4},"b":"cut o'), (4, None)]
    out = {(r.doc_id, r.name): (r.value, r.confidence) for r in extract.parse_responses(spark.createDataFrame(rows, "doc_id int, response string"), ["a", "b"]).collect()}
    assert out[1, "a"] == ("x", 0.5) and out[1, "b"] == (extract.PLACEHOLDER, 0.0) and out[2, "a"] == ("y", 0.9) and out[3, "a"] == ("z", 0.4) and out[4, "a"][1] == 0.0


def test_candidates(spark):
    text = "Prestador: Loja Azul\nCliente - Ana Maria\nNota fiscal 12345\nValor R$ 1.234,56 e 10.50\nCNPJ 08.629.869/0001-01 12.345.678/0001-90\nISS retido: 3,00"
    r = extract.field_candidates(spark.createDataFrame([(text,)], "raw_text string")).first()
    assert (r.fornecedor_candidates, r.tomador_candidates, r.numero_nf_candidates) == (["Loja Azul"], ["Ana Maria"], ["12345"])
    assert r.valor_nf_candidates == ["1234,56", "3,00"] and r.cnpj_fornecedor_candidates == ["08.629.869/0001-01"] and r.retencao_candidates == ["3,00"]


def test_versions(spark):
    v = spark.createDataFrame([("d", 1, "valor", "100", 0.8, True)], "document_id string, version_number int, name string, value string, confidence double, is_active boolean")
    kind = "document_id string, edit_no int, base_version int, fields array<struct<name:string,value:string>>"
    def run(*edits):
        return [(r.outcome, r.new_version, r.confidence) for r in versions.apply_manual_edits(v, spark.createDataFrame([("d", k, b, f) for k, (b, f) in enumerate(edits)], kind)).orderBy("edit_no").collect()]

    assert run((1, [("valor", "200")])) == [("saved", 2, 1.0)] and run((1, [(" valor ", "100"), ("x", "1")])) == [("saved", 2, 0.9)]
    assert run((1, [("valor", "100")])) == [("no_changes", None, None)] and run((1, [(" ", "x")])) == [("empty", None, None)] and run((0, [("valor", "1")])) == [("conflict", None, None)]
    assert [x[0] for x in run((1, [("a", "1")]), (1, [("b", "1")]))] == ["saved", "conflict"]


def test_paging(spark):
    rows = spark.range(30).select(F.format_string("doc-%03d", "id").alias("id"), F.lit(1).alias("received_at"))
    page, total = inbox.paginate(rows, 1, 100)
    assert page.count() == 25 and tuple(total.first()) == (30, 1, 25, 2) and inbox.paginate(rows, "2", "x")[0].count() == 5 and inbox.paginate(rows, 9)[0].count() == 0
    assert [inbox.bounded_limit(v) for v in (None, "x", 0, 700, "7")] == [50, 50, 1, 500, 7]


def test_payload_contract(spark):
    good = '{"event_id":"1","event_type":"ocr.completed","event_version":"v1","occurred_at":"2026-01-01T00:00:00Z","tenant_id":"t","document_id":"d","data":{}}'
    bad = [good.replace("00Z", "00"), good.replace('"data"', '"other"'), good.replace("ocr.completed", "x"), "no", good.replace('"data":{}', '"data":{"confidence":1.2}'), good.replace('"data":{}', '"data":{"file":{"sha256":"ab"}}'), good.replace('"tenant_id":"t",', "")]
    out = [r.error for r in events.validate_payloads(spark.createDataFrame([(k, p) for k, p in enumerate([good, *bad])], "k int, payload string")).orderBy("k").collect()]
    assert out == [None, "occurred_at", "unknown key", "unknown event type", "not an object", "range", "sha256", "missing key"]


def test_loops():
    def brute(t, least):
        for size in range(least, len(t) // 3 + 1):
            for i in range(len(t) - 3 * size + 1):
                if t[i : i + 3 * size] == t[i : i + size] * 3:
                    return t[: i + size].rstrip(", \n")
        return t

    rng = random.Random(3)
    for _ in range(300):
        t = "".join("".join(rng.choices("ab ", k=rng.randrange(1, 20))) * rng.randrange(1, 6) for _ in range(3))
        assert pages.cut_loops(t, 5) == brute(t, 5)


def test_debounce(spark):
    rows = [("c1", 0.0, "a"), ("c1", 2.0, "b"), ("c1", 9.0, "c"), ("c2", 1.0, "x")] + [("c3", float(k), str(k)) for k in range(8)]
    df = spark.createDataFrame(rows, "key string, t double, item string").withColumn("ts", F.timestamp_seconds("t"))
    out = lambda d: sorted((r.key, tuple(r["items"])) for r in d.collect())
    assert out(jobs.debounce(df.where("key != 'c3'"), "key", "ts", "item", 3)) == [("c1", ("a", "b")), ("c1", ("c",)), ("c2", ("x",))]
    assert out(jobs.debounce_max_wait(df.where("key = 'c3'"), "key", "ts", "item", 2, 4)) == [("c3", ("0", "1", "2", "3")), ("c3", ("4", "5", "6", "7"))]
    with pytest.raises(ValueError):
        jobs.debounce_max_wait(df, "key", "ts", "item", 4, 4)


def test_blank_and_weak_texts_without_rewriting_them(spark):
    texts = [None, "", " \t\n\x0b\f\r", " ", " a ", "abcdefghij", "abcdefghi", "abcdefghij" + "1" * 12, "abcdefghij" + "1" * 13, "çãÀÿ-abcdef 12"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", X.is_blank(F.col("t")).alias("blank"), (X.clean_line(F.col("t")) == "").alias("old"), X.is_low_quality_text(F.col("t")).alias("weak"))
    out = sorted(rows.collect())
    assert [r.blank for r in out] == [True, True, True] + [False] * 7 == [r.old for r in out]
    assert [r.weak for r in out] == [True] * 5 + [False, True, False, True, False]


def test_candidates_of_a_text_without_labels_cost_no_search_for_them(spark):
    """Letters that only a (?iu) pattern folds are found all the same, and no digit is a row of an array."""
    rows = spark.createDataFrame([(1, "Preſtador: ACME\nNome\tEmpresarial : Outra"), (2, "Beneficıário: Ana"), (3, "so texto 09769035000164")], "k int, raw_text string")
    out = extract.field_candidates(rows)
    got = {r.k: r for r in out.collect()}
    assert got[1].fornecedor_candidates == ["ACME", "Outra"] and got[2].tomador_candidates == ["Ana"] and got[3].cnpj_fornecedor_candidates == ["09769035000164"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(_low" in plan and "zip_with" not in plan and "aggregate(" not in plan


def test_critical_fields_search_lines_only_where_the_text_has_their_words(spark):
    rows = spark.createDataFrame([(1, "Fornecedor: ACME LTDA\nCNPJ: 09.769.035/0001-64\nISS retido 3,00"), (2, "nada mais")], "k int, raw_text string")
    out = quality.critical_fields(rows)
    got = {r.k: r for r in out.collect()}
    assert (got[1].fornecedor.value, got[1].cnpj_fornecedor.value, got[1].retencao.value, got[2].retencao.value) == ("ACME LTDA", "09.769.035/0001-64", "ISS retido 3,00", "")
    assert "Contains(_low" in out._jdf.queryExecution().optimizedPlan().toString() and set(out.columns) == {"k", "raw_text", *quality.FIELDS}
