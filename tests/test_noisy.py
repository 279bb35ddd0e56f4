"""Fields of badly read texts against plain Python, and single cases."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from sparkfields.functions import exprs as X
from sparkfields.operators import noisy
from sparkfields.plans.fixtures import view

SMALL = "/root/testdata/sf0.001"
DIGITS = str.maketrans("OoIlSsBQ", "00115580")


def holds(number):
    d = re.sub(r"\D", "", number)
    if len(d) != 14 or len(set(d)) == 1:
        return False
    for n in (12, 13):
        rest = sum(int(c) * (2 + (n - 1 - k) % 8) for k, c in enumerate(d[:n])) % 11
        if int(d[n]) != (0 if rest < 2 else 11 - rest):
            return False
    return True


def marked(d):
    return f"{d[:2]}.{d[2:5]}.{d[5:8]}/{d[8:12]}-{d[12:]}"


def numbers(text):
    found = (re.sub(r"\D", "", m[0]) for m in re.finditer(noisy.CNPJ, text.translate(DIGITS), re.A))
    return list(dict.fromkeys(marked(d) for d in found if holds(d)))


def worth(v):
    v = v.replace(".", "") if "," in v else v
    return float(v.replace(",", "."))


def amount(text):
    text, best, score = text.translate(DIGITS), "", -1.0
    for m in re.finditer(noisy.AMOUNT, text, re.A):
        near, s = text[max(0, m.start() - 40) : m.end() + 40].lower(), worth(m[1])
        if s > 0:
            s += 10000 * bool(re.search(noisy.MONEY, near)) + 2500 * bool(re.search(noisy.TOTAL, near)) - 9000 * bool(re.search(noisy.OTHER, near))
            if s > score:
                best, score = m[1], s
    return best


def by_hand(text, names, headings):
    lines = [x for x in (re.sub(r"\s+", " ", y).strip() for y in text.splitlines()) if x]
    out = {}
    for field, label in noisy.NAME_LABELS.items():
        tried = [re.sub(r"^[^:\-]*[:\-]\s*", "", near).strip() if re.search(label, near, re.I) else near for k, x in enumerate(lines) if re.search(label, x.lower()) for near in lines[k : k + 4]]
        out[field] = next((t for t in tried + lines if t in names), "")
    for field, label in noisy.CNPJ_LABELS.items():
        out[field] = next((n[0] for k, x in enumerate(lines) if re.search(label, x.lower()) for n in [numbers(" ".join(lines[k : k + 3]))] if n), "")
    every = numbers(text)
    if not out["cnpj_fornecedor"] and every:
        out["cnpj_fornecedor"] = every[0]
        out["cnpj_tomador"] = out["cnpj_tomador"] or (every[1] if len(every) > 1 else "")
    if not out["tomador"] and (m := re.search(r"(condom[íi]nio[^,\n]{5,140})", text, re.I)):
        out["tomador"] = re.sub(r"\s+", " ", m[1]).strip()
    tried = [m[1] for t in [*lines, text] for p in noisy.NUMBERS for m in [re.search(p, t.translate(DIGITS))] if m]
    out["numero_nf"] = next((t for t in tried if re.search(r"\d", t) and len(t) <= 25 and t not in headings), "")
    out["valor_nf"] = amount(text)
    out["retencao"] = " | ".join([x for x in lines if re.search(noisy.RETENTION, x.lower())][:3])
    return out


def test_noisy_fields_equal_plain_python(spark):
    rng = random.Random(4)
    texts = [r.raw_text for r in view(spark, SMALL, "fx_noisy").orderBy("doc_id").limit(300).collect()]
    parts = [x for t in texts for x in t.split("\n")] + ["", "Cliente - Maria da Silva Souza", "Pagador:", "valor R5 l.O0O,50", "cpf 12.345,00", "RS 7,90", "TELEFONE 99999.99", "Numero do recibo: A-77", "ISS retido", "Condomínio Bela Vista de Cima, 9"]
    texts += ["\n".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(300)] + [None, "", "x" * 30_000, "1,00 " * 2_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, raw_text string")
    lines = df.select(F.explode(X.lines(F.col("raw_text"))).alias("x")).select(F.explode(F.array("x", X.strip_space(F.regexp_replace("x", r"^[^:\-]*[:\-]\s*", "")))).alias("x")).distinct()
    names = {r.x for r in lines.where(X.is_name_line(F.col("x"))).collect()}  # tests/test_rules.py holds this rule
    tried = {m[1] for t in texts if t for s in [*t.split("\n"), t] for p in noisy.NUMBERS for m in [re.search(p, s.translate(DIGITS))] if m}
    headings = {r.x for r in spark.createDataFrame([(t,) for t in tried], "x string").where(X.is_header_like(F.col("x"))).collect()}
    found = {r.k: r.noisy for r in noisy.noisy_fields(df).collect()}
    for k, text in enumerate(texts):
        want = by_hand(text or "", names, headings)
        assert {n: found[k][n].value for n in want} == want, text
    assert sum(f.cnpj_fornecedor.conf == 0.9 for f in found.values()) > 50 and {f.valor_nf.conf for f in found.values()} == {0.0, 0.86}


def test_description_and_retention(spark):
    rows = [
        ("Recibo\nReferente a: reparo de bombas e quadros do predio, CPF 123", "reparo de bombas e quadros do predio,"),
        ("Manutencao geral do elevador social", "Manutencao geral do elevador social"),
        ("curto\numa linha com muitas letras aqui\noutra linha com letras e mais letras", "outra linha com letras e mais letras"),
        ("curto", ""),
    ]
    out = [r.noisy for r in noisy.noisy_fields(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, raw_text string")).orderBy("k").collect()]
    assert [r.descricao_servico.value for r in out] == [w for _, w in rows] and [r.descricao_servico.conf for r in out] == [0.62, 0.62, 0.62, 0.0]


def test_repair_of_a_tax_number(spark):
    good = "11222333000181"
    tried = {good: marked(good), "11.222.333/OOO1-8l": marked(good), good[:-1] + "7": None, "112223330001": None, "": None, None: None}
    one = ["".join([good[:k], c, good[k + 1 :]]) for k in range(14) for c in "0123456789" if good[k] in noisy.LOOK_ALIKES[c] and c != good[k]]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate([*tried, *one])], "k int, v string")
    out = [r.got for r in rows.orderBy("k").select(noisy.repaired_cnpj(F.col("v")).alias("got")).collect()]
    assert out[:2] == list(tried.values())[:2] and out[3:6] == [None] * 3
    again = out[len(tried) :]
    assert again.count(marked(good)) / len(one) > 0.6 and all(holds(x) for x in again if x)


def test_enrichment_takes_what_is_better(spark):
    text = "Prestador: Casa das Tintas Ltda\n11.222.333/0001-81\nTotal R$ 90,00"
    schema = "k int, raw_text string, c string, e string, fornecedor struct<value:string,conf:double>, cnpj_fornecedor struct<value:string,conf:double>, valor_nf struct<value:string,conf:double>"
    rows = [
        (0, text, "digital_pdf", "docling", ("", 0.0), ("", 0.0), ("", 0.0)), (1, text, "Scanned_Image", None, ("", 0.0), ("11.222.333/0001-80", 0.95), ("80,00", 0.9)),
        (2, text, None, " tesseract", ("Casa Velha e Filhos", 0.1), ("11.444.777/0001-61", 0.1), ("95,00", 0.1)), (3, None, None, "easyocr", (None, 0.0), None, ("x", 0.2)),
    ]
    out = {r.k: (r.fornecedor.value, r.cnpj_fornecedor and r.cnpj_fornecedor.value, r.valor_nf.value, r.valor_nf.conf) for r in noisy.enrich(spark.createDataFrame(rows, schema), ["fornecedor", "cnpj_fornecedor", "valor_nf"], "c", "e").collect()}
    assert out == {0: ("", "", "", 0.0), 1: ("Casa das Tintas Ltda", "11.222.333/0001-81", "90,00", 0.9), 2: ("Casa Velha e Filhos", "11.444.777/0001-61", "95,00", 0.1), 3: (None, None, "x", 0.2)}


def test_texts_of_one_small_file_are_read_by_all_cores(spark):
    assert view(spark, "/root/testdata/sf0.001", "fx_noisy").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_lines_after_the_first_name_are_not_looked_at(spark):
    """Searches end at the first line that fits, and what has no word of a rule isn't searched: the walk names its values once."""
    row = spark.range(1).select(noisy._first_of(F.array(F.lit(1), F.lit(2)), lambda v: v != "", lambda k: F.when(k == 1, "Casa das Tintas").otherwise(F.raise_error(F.lit("looked at")).cast("string"))).alias("v")).first()
    assert row.v == "Casa das Tintas"
    plan = noisy.noisy_fields(spark.createDataFrame([("a",)], "raw_text string")).select("noisy.valor_nf")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(noisy.AMOUNT) == 1


def test_rough_texts_equal_plain_python_where_numbers_cross_lines(spark):
    spaces = ["11.222.333\n\n0001-81", "11\t222 \n 333/0001\r\n81", "11 222 333 0001 81", "IIzzz", "11222333\x010001-81", "11.\n222.333/0001-81"]
    texts = [f"{a}{b}\nTotal R$ 10,00 \x01 20,50\x02 7.25" for a in ("Emitente: ", "PAGADOR\n", "CLIENTE ", "BENEFICI\u00c1RIO\n", "") for b in spaces]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, raw_text string")
    for r in noisy.noisy_fields(df).collect():
        want = by_hand(texts[r.k].replace("\r", "\n"), set(), set())
        assert r.noisy.cnpj_fornecedor.value == want["cnpj_fornecedor"] and r.noisy.cnpj_tomador.value == want["cnpj_tomador"], texts[r.k]
        assert r.noisy.valor_nf.value == amount(texts[r.k].replace("\x01", " ").replace("\x02", " "))
