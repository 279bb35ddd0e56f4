"""Critical fields with confidence, their validation and scores, and the merging of two extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .extract import PLACEHOLDER, labelled_value, slice_blocks

REQUIRED = ["fornecedor", "tomador", "cnpj_fornecedor", "numero_nf", "descricao_servico", "valor_nf", "retencao"]
FIELDS = [*REQUIRED, "cnpj_tomador"]
# Least confidence of each field, which flag tells that it is valid, and shares of scores.
LEAST = {"fornecedor": 0.65, "tomador": 0.75, "cnpj_fornecedor": 0.85, "cnpj_tomador": 0.80, "numero_nf": 0.70, "descricao_servico": 0.65, "valor_nf": 0.75, "retencao": 0.55}
FLAG = {"fornecedor": "fornecedor_ok", "tomador": "tomador_ok", "cnpj_fornecedor": "cnpj_fornecedor_valido", "cnpj_tomador": "cnpj_tomador_valido", "numero_nf": "numero_nf_valido", "descricao_servico": "descricao_ok", "valor_nf": "valor_valido", "retencao": "retencao_ok"}
LOW, FINAL = 0.75, 0.85
ISSUER_LABELS, RECIPIENT_LABELS = ["fornecedor", "prestador", "emitente", "emissor"], ["tomador", "destinatário", "destinatario", "cliente"]
RETENTION_TERMS = ["reten", "iss", "inss", "pis", "cofins", "csll", "irrf"]
# Patterns of numbers and amounts in plain texts.
NUMBER = [r"(?iu)(?:n[úu]mero\s*(?:da\s*)?(?:nfs-?e|nfse|nota\s*fiscal)|n[º°o]?\s*(?:da\s*)?(?:nfs-?e|nfse|nota\s*fiscal))\s*[:#\-]?\s*([A-Za-z0-9./-]+)", r"(?iu)(?:nota\s*fiscal\s*n[º°o]?|nf\s*n[º°o]?)\s*[:#\-]?\s*([A-Za-z0-9./-]+)"]
TOTAL = [r"(?iu)(?:valor\s*(?:total)?\s*(?:da\s*)?nota|valor\s*(?:da\s*)?nfs-?e)\s*[:\-]?\s*(?:R\$\s*)?([\d\.]+,\d{2}|\d+\.\d{2}|\d+)", r"(?iu)(?:total\s*a\s*pagar|valor\s*líquido)\s*[:\-]?\s*(?:R\$\s*)?([\d\.]+,\d{2}|\d+\.\d{2}|\d+)"]
# Patterns of headings and values in the blocks of a service invoice.
NAME_HEADING = r"nome\s*/\s*nome\s*empresarial"
NUMBER_HEADING = r"n[úu]mero\s+da\s+nfs-?e"
NUMBER_LINE = r"^[A-Za-z0-9./-]{1,25}$"
SERVICE_HEADING = r"descri[çc][ãa]o\s+do\s+servi[çc]o"
SERVICE_STOP = r"(?iu)tributa[çc][ãa]o|valor\s+do\s+servi[çc]o|valor\s+total"
PRICE_HEADING = r"(?iu)valor\s+total\s+da\s+nfs-?e|valor\s+l[íi]quido\s+da\s+nfs-?e|valor\s+do\s+servi[çc]o"
TAX_HEADING = "reten|retido|issqn"
TAX_VALUE = r"(?iu)^(?:n[ãa]o\s+retido|retido)$"
TAX_STOP = r"(?iu)^tributa[çc][ãa]o|^informa[çc][õo]es\s+complementares"
TAX_EVIDENCE = r"(?iu)n[ãa]o\s+retido|retido|R\$\s*[\d\.]+,\d{2}|\d+,\d{2}"
MONEY = r"(?i)R\$\s*([\d\.]+,\d{2}|\d+\.\d{2}|\d+)"


def _first(values: Column) -> Column:
    return F.coalesce(F.get(values, 0), F.lit(""))


def _tail(lines: Column, pattern: str, n: int | Column) -> Column:
    """Up to n lines after the first that matches."""
    at = F.array_min(F.transform(lines, lambda x, i: F.when(x.rlike(f"(?iu){pattern}"), i + 1)))
    return F.when(at.isNull(), F.array().cast("array<string>")).otherwise(F.slice(lines, at + 1, n))


def _with_next(lines: Column) -> Column:
    """(line, next line) of each line."""
    return F.arrays_zip(lines.alias("x"), F.concat(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.lit(""))).alias("y"))


def _best_name(lines: Column) -> Column:
    """struct(name, score) of the line that looks most like a name, the first of equals."""
    ranked = F.filter(F.transform(lines, lambda x, i: F.struct((-X.line_score(x)).alias("s"), i.alias("i"), x.alias("x"))), lambda r: r["s"] < 0)
    best = X.let(F.array_min(ranked), lambda top: F.struct(F.coalesce(top["x"], F.lit("")).alias("name"), F.coalesce(-top["s"], F.lit(0.0)).alias("score")))
    return F.coalesce(best, F.struct(F.lit("").alias("name"), F.lit(0.0).alias("score")))


def _names(rows: DataFrame, block: str, issuer: bool) -> DataFrame:
    """rows with the best names of a party's block in columns of their own, so that each is computed once."""
    lines = F.col(f"{block}_block")
    found = {f"_{block}_near": _best_name(_tail(lines, X.CNPJ, 6)), f"_{block}_any": _best_name(lines)}
    if issuer:
        named = _first(F.filter(_tail(lines, NAME_HEADING, 3), X.named))
        found[f"_{block}_named"] = X.let(named, lambda x: F.struct(x.alias("name"), X.line_score(x).alias("score")))
    for name, value in found.items():
        rows = rows.withColumn(name, value)
    return rows


def _party(block: str, issuer: bool) -> list[tuple[Column, Column]]:
    """(name, confidence) candidates from the block of a party, best first."""
    least = ({"named": 0.92} if issuer else {}) | {"near": 0.75, "any": 0.62}
    return [(F.col(f"_{block}_{k}.name"), F.greatest(F.lit(c), F.col(f"_{block}_{k}.score"))) for k, c in least.items()]


def critical_fields(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """df with a struct(value, conf) for each of FIELDS.

    Blocks of a service invoice come before the optional columns entities,
    document_info and totals (maps of strings), and those before labelled lines
    of the text. A recipient's number equal to the issuer's is blank.
    """
    empty = F.create_map().cast("map<string,string>")
    given = {c: F.coalesce(F.col(c), empty) if c in df.columns else empty for c in ("entities", "document_info", "totals")}
    rows = _names(_names(slice_blocks(df, text_col), "emitente", True), "tomador", False)
    rows = rows.withColumns({f"_{c}": m for c, m in given.items()}).withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_low", F.lower("_text"))
    of = lambda m, *keys: F.coalesce(*[F.nullif(F.try_element_at(f"_{m}", F.lit(k)), F.lit("")) for k in keys], F.lit(""))
    lines, text, low = F.col("lines"), F.col("_text"), F.col("_low")
    # lines are searched only where the text has what one of them must have
    lines_with = lambda words: F.when(X.has_any(low, words), lines).otherwise(F.array().cast("array<string>"))
    own = lines_with(["nfs-e", "danfse", "nfse"])
    rows = rows.withColumn("_cnpj", F.regexp_extract("_text", f"({X.CNPJ})", 1))
    cnpj_of = lambda block: F.regexp_extract(_first(F.filter(block, lambda x: x.rlike(X.CNPJ))), f"({X.CNPJ})", 1)

    def cnpj_by(labels: list[str]) -> Column:
        near = F.filter(lines_with(labels), lambda x: X.let(F.lower(x), lambda y: X.has_any(y, labels)) & x.rlike(X.CNPJ))
        return F.when(F.col("_cnpj") == "", "").otherwise(F.coalesce(F.regexp_extract(F.get(near, 0), f"({X.CNPJ})", 1), F.col("_cnpj")))

    number = _first(F.filter(_tail(own, NUMBER_HEADING, 3), lambda x: x.rlike(NUMBER_LINE) & ~X.heading(x)))
    found = [F.when(X.has_any(low, ["nf", "nota"]), F.nullif(F.regexp_extract(text, p, 1), F.lit(""))) for p in NUMBER]
    service = F.col("servico_block")
    after = _tail(service, SERVICE_HEADING, F.size(service))
    stop = F.array_min(F.transform(after, lambda x, i: F.when(x.rlike(SERVICE_STOP), i)))
    body = F.filter(F.slice(after, F.lit(1), F.coalesce(stop, F.size(after))), lambda x: ~X.heading(x))
    described = F.aggregate(body, F.lit(""), lambda a, x: F.when(F.length(a) >= 450, a).otherwise(F.trim(F.concat(a, F.lit(" "), x))))
    plain_at = F.filter(_with_next(lines_with(["descrição"])), lambda p: F.contains(F.lower(p["x"]), F.lit("descrição")) & F.contains(F.lower(p["x"]), F.lit("serv")))
    plain = F.transform(plain_at, lambda p: F.when(F.regexp_extract(p["x"], r"^[^:\-]*[:\-]\s*(.+)$", 1) != "", F.regexp_extract(p["x"], r"^[^:\-]*[:\-]\s*(.+)$", 1)).otherwise(p["y"]))
    priced = F.filter(_with_next(F.concat("municipal_block", own)), lambda p: p["x"].rlike(PRICE_HEADING))
    prices = F.filter(F.transform(priced, lambda p: F.regexp_extract(F.concat(p["x"], F.lit(" "), p["y"]), MONEY, 1)), lambda v: v != "")
    totals = [F.when(X.has_any(low, words), F.nullif(F.regexp_extract(text, p, 1), F.lit(""))) for p, words in zip(TOTAL, (["valor"], ["total", "valor"]), strict=True)]
    taxes = F.filter(_with_next(F.concat("municipal_block", "federal_block")), lambda p: F.lower(p["x"]).rlike(TAX_HEADING) & ~p["x"].rlike(TAX_VALUE) & ~X.heading(p["x"]))
    joined = F.transform(taxes, lambda p: F.when(p["y"].rlike(TAX_STOP), p["x"]).otherwise(F.concat(p["x"], F.lit(" "), p["y"])))
    evidence = F.filter(joined, lambda x: x.rlike(TAX_EVIDENCE))
    terms = F.filter(lines_with(RETENTION_TERMS), lambda x: X.let(F.lower(x), lambda y: X.has_any(y, RETENTION_TERMS)))
    candidates = {
        "fornecedor": [*_party("emitente", True), (of("entities", "issuer", "fornecedor", "prestador"), 0.84), (labelled_value(lines_with(ISSUER_LABELS), ISSUER_LABELS), 0.58)],
        "tomador": [*_party("tomador", False), (of("entities", "recipient", "tomador", "destinatario"), 0.84), (labelled_value(lines_with(RECIPIENT_LABELS), RECIPIENT_LABELS), 0.58)],
        "cnpj_fornecedor": [(cnpj_of(F.col("emitente_block")), 0.97), (of("entities", "cnpj_fornecedor", "issuer_cnpj"), 0.88), (cnpj_by(ISSUER_LABELS), 0.56)],
        "cnpj_tomador": [(cnpj_of(F.col("tomador_block")), 0.97), (of("entities", "cnpj_tomador", "recipient_cnpj"), 0.88), (cnpj_by(RECIPIENT_LABELS), 0.56)],
        "numero_nf": [(number, 0.94), (of("document_info", "number"), 0.86), (F.coalesce(*found, F.lit("")), 0.60)],
        "descricao_servico": [(described, 0.92), (_first(F.filter(plain, lambda v: v != "")), 0.62)],
        "valor_nf": [(_first(prices), 0.92), (of("totals", "grand_total"), 0.86), (F.coalesce(*totals, F.lit("")), 0.58)],
        "retencao": [(F.array_join(F.slice(evidence, 1, 3), " | "), 0.82), (F.array_join(F.slice(terms, 1, 4), " | "), 0.48)],
    }

    def sure(value: Column, conf: Column | float) -> Column:
        conf = (conf if isinstance(conf, Column) else F.lit(conf)).cast("double")
        return X.let(X.clean_line(value), lambda x: F.when(~X.heading(x), F.struct(x.alias("value"), conf.alias("conf"))))

    for name, options in candidates.items():  # a step each, so that none repeats another's work; what comes after a good one isn't looked for
        rows = rows.withColumn(f"_c_{name}", F.coalesce(*[sure(v, c) for v, c in options], F.struct(F.lit("").alias("value"), F.lit(0.0).alias("conf"))))
    rows = rows.withColumns({n: F.col(f"_c_{n}") for n in candidates})
    same = (F.col("cnpj_tomador.value") != "") & (X.digits(F.col("cnpj_tomador.value")) == X.digits(F.col("cnpj_fornecedor.value")))
    rows = rows.withColumn("cnpj_tomador", F.when(same, F.struct(F.lit("").alias("value"), F.col("cnpj_tomador.conf").alias("conf"))).otherwise(F.col("cnpj_tomador")))
    blocks = [c for c in rows.columns if c.endswith("_block") and c not in df.columns]
    names = [f"_{b}_{k}" for b in ("emitente", "tomador") for k in ("near", "any", "named")]
    return rows.drop("_text", "_low", "_cnpj", "_entities", "_document_info", "_totals", *names, *[f"_c_{n}" for n in candidates], *blocks, *(["lines"] if "lines" not in df.columns else []))


def validate_fields(df: DataFrame) -> DataFrame:
    """df, with a column (value, conf) or text for each of FIELDS, with a flag for each and required_missing.

    required_present tells it for each required field, and cnpj_tomador_validado
    repeats cnpj_tomador_valido, which so counts twice in the score.
    """
    kinds = dict(df.dtypes)
    v = {n: X.strip_space(F.coalesce(F.col(f"{n}.value") if kinds[n].startswith("struct") else F.col(n), F.lit(""))) for n in FIELDS}
    text = lambda n, least: (F.length(v[n]) > least) & ~X.is_header_like(v[n])
    flags = {
        "fornecedor_ok": text("fornecedor", 2), "tomador_ok": text("tomador", 2), "cnpj_fornecedor_valido": X.cnpj_valid(v["cnpj_fornecedor"]), "cnpj_tomador_valido": X.cnpj_valid(v["cnpj_tomador"]),
        "numero_nf_valido": text("numero_nf", 0), "descricao_ok": text("descricao_servico", 10), "valor_valido": F.coalesce(X.currency_loose(v["valor_nf"]) > 0, F.lit(False)), "retencao_ok": text("retencao", 0),
    }
    present = F.create_map(*[x for n in REQUIRED for x in (F.lit(n), v[n] != "")])
    rows = df.withColumns(flags).withColumn("required_present", present)
    return rows.withColumn("required_missing", F.exists(F.map_values("required_present"), lambda x: ~x)).withColumn("cnpj_tomador_validado", F.col("cnpj_tomador_valido"))


def field_quality(df: DataFrame, ocr_confidence: Column | None = None) -> DataFrame:
    """Rows of critical_fields and validate_fields with field_score, ocr_confidence, final_score, low_fields, llm_should_run, fallback_needed.

    Without an OCR confidence (0 to 100) the mean of the fields' stands in. The
    recipient's number counts twice among the nine flags.
    """
    num = lambda c: F.col(c).cast("int")
    rows = df.withColumns({f"_f_{n}": F.when(X.is_header_like(F.col(f"{n}.value")), 0.0).otherwise(F.col(f"{n}.conf")) for n in FIELDS})
    share, mean = num("cnpj_tomador_validado"), F.lit(0.0)
    for n in FIELDS:
        share, mean = share + num(FLAG[n]), mean + F.col(f"_f_{n}")
    pct = F.coalesce(ocr_confidence, mean / len(FIELDS) * 100) if ocr_confidence is not None else mean / len(FIELDS) * 100
    rows = rows.withColumn("_fs", share / 9).withColumn("_oc", F.least(F.lit(100.0), F.greatest(F.lit(0.0), pct)) / 100)
    rows = rows.withColumn("_final", 0.4 * F.col("_oc") + 0.6 * F.col("_fs"))
    low = F.filter(F.array(*[F.when(F.col(f"_f_{n}") < LEAST[n], F.lit(n)) for n in FIELDS]), lambda x: x.isNotNull())
    scores = {n: F.round(F.when(F.trim(f"{n}.value") != "", 0.4).otherwise(0.0) + X.confidence_ratio(F.col(f"_f_{n}")) * 0.4 + F.when(F.col(FLAG[n]), 0.2).otherwise(0.0), 4) for n in REQUIRED}
    weak = F.filter(F.array(*[F.when(s < LOW, F.lit(n)) for n, s in scores.items()]), lambda x: x.isNotNull())
    rows = rows.withColumn("low_fields", low).withColumn("low_critical_fields", weak)
    invalid = ~F.col("cnpj_fornecedor_valido") | ~F.col("valor_valido") | ~F.col("numero_nf_valido")
    critical = F.arrays_overlap("low_fields", F.array(*[F.lit(n) for n in ("tomador", "cnpj_fornecedor", "numero_nf", "valor_nf")]))
    rows = rows.withColumn("llm_should_run", F.size("low_critical_fields") > 0).withColumn("fallback_needed", invalid | F.col("required_missing") | critical | (F.col("_final") < FINAL))
    rows = rows.withColumns({"ocr_confidence": F.round("_oc", 4), "field_score": F.round("_fs", 4), "final_score": F.round("_final", 4)})
    return rows.drop("_fs", "_oc", "_final", *[f"_f_{n}" for n in FIELDS])


def needs_ocr_fallback(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """df (avg_confidence 0..100, page_count, optional fallback_needed) with needs_fallback: weak or little text."""
    t = X.clean_line(F.col(text_col))
    pages = F.coalesce(F.col("page_count"), F.lit(1))
    little = (F.length(t) < 80) | ((pages >= 2) & (F.length(t) / pages < 90)) | (F.size(F.split(t, " ")) < 15)
    asked = F.coalesce(F.col("fallback_needed"), F.lit(False)) if "fallback_needed" in df.columns else F.lit(False)
    return df.withColumn("needs_fallback", F.coalesce(F.col("avg_confidence") < 70, F.lit(False)) | asked | little)


def text_signal_score(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """df with signal_score (0..100) and signal_fallback, from length and the presence of a date, an amount and a long number."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    have = [t.rlike(r"\d{2}/\d{2}/\d{4}"), t.rlike(r"R\$\s*[\d.]+,\d{2}|\d+,\d{2}"), t.rlike(r"\d{6,}")]
    share = (have[0].cast("int") + have[1].cast("int") + have[2].cast("int")) / 3
    score = F.round(0.4 * F.least(F.lit(100.0), F.length(t) / 40) + 0.6 * share * 100, 2)
    return df.withColumn("signal_score", score).withColumn("signal_fallback", (score < 70) | ~(have[0] & have[1] & have[2]))


def apply_post_processing(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """Long fields (doc_id, schema_id, name, value) by rules (schema_id, name, kind, pattern, allowed, least, most, required).

    Gives normalised, is_valid and reason. Kinds: string, decimal, integer,
    percentage, date, boolean, enum, cnpj, cpf, cpf_or_cnpj, digits. Blank values
    are null, and invalid only if required; fields without a rule stay as they
    are.
    """
    r = rules.select(F.col("schema_id").alias("r_schema"), F.col("name").alias("r_name"), "kind", "pattern", "allowed", "least", "most", "required")
    rows = fields.join(r, (F.col("schema_id") == F.col("r_schema")) & (F.col("name") == F.col("r_name")), "left")
    v = X.strip_space(F.col("value"))
    blank = F.coalesce(v.isin("", "-") | (v == PLACEHOLDER), F.lit(True))
    d, low = X.digits(v), X.without_accents(v)
    number = X.currency_loose(F.regexp_replace(v, "%", ""))
    date = F.coalesce(F.try_to_date(v, "dd/MM/yyyy"), F.try_to_date(v, "dd-MM-yyyy"), F.try_to_date(v, "yyyy-MM-dd"))
    yes, no = low.isin("sim", "true", "1", "retido", "yes", "s"), low.isin("nao", "false", "0", "nao retido", "no", "n")
    digit = lambda k, n: (F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda a, i: a + F.substring(d, i, F.lit(1)).try_cast("int") * (n + 2 - i)) * 10 % 11 % 10 == F.substring(d, k, 1).try_cast("int"))
    cpf = (F.length(d) == 11) & ~d.rlike(r"^(\d)\1*$") & F.coalesce(digit(10, 9) & digit(11, 10), F.lit(False))
    kind = F.col("kind")
    text = (
        F.when(kind == "decimal", F.format_string("%.2f", number)).when(kind == "percentage", F.format_string("%.2f", number)).when(kind == "integer", d.try_cast("bigint").cast("string"))
        .when(kind == "date", F.date_format(date, "yyyy-MM-dd")).when(kind == "boolean", F.when(yes, "true").when(no, "false"))
        .when(kind == "enum", F.when(F.array_contains(F.split("allowed", ","), low), low)).when(kind == "cnpj", F.when(X.cnpj_valid(v), d)).when(kind == "cpf", F.when(cpf, d))
        .when(kind == "cpf_or_cnpj", F.when(X.cnpj_valid(v) | cpf, d)).when(kind == "digits", F.nullif(d, F.lit(""))).otherwise(v)
    )
    rows = rows.withColumn("normalised", F.when(blank, None).when(kind.isNull(), F.col("value")).otherwise(text)).withColumn("_blank", blank).withColumn("_n", number)
    bounds = F.coalesce((F.col("_n") < F.col("least")) | (F.col("_n") > F.col("most")), F.lit(False)) & kind.isin("decimal", "percentage", "integer")
    shape = F.coalesce(~F.rlike("normalised", F.col("pattern")), F.lit(False))
    reason = (
        F.when(kind.isNull(), None).when(F.col("_blank") & F.coalesce("required", F.lit(False)), "required").when(F.col("_blank"), None)
        .when(F.col("normalised").isNull(), F.concat(F.lit("not a "), kind)).when(bounds, "out of range").when(shape, "pattern")
    )
    return rows.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull()).drop("r_schema", "r_name", "kind", "pattern", "allowed", "least", "most", "required", "_blank", "_n")


def merge_ocr_results(both: DataFrame) -> DataFrame:
    """Rows of (primary_text, fallback_text, primary_engine, fallback_engine) with raw_text, engine, used_fallback_text.

    The fallback's text replaces the first if it isn't blank and has 60 % of its
    length and of its words, three words at least.
    """
    p, f = F.coalesce("primary_text", F.lit("")), F.coalesce("fallback_text", F.lit(""))
    words = lambda c: F.when(X.clean_line(c) == "", 0).otherwise(F.size(F.split(X.clean_line(c), " ")))
    better = (X.clean_line(f) != "") & (F.length(f) >= F.floor(F.length(p) * 0.6)) & (words(f) >= F.greatest(F.lit(3), F.floor(words(p) * 0.6)))
    return both.withColumn("used_fallback_text", better).withColumn("raw_text", F.when(better, f).otherwise(p)).withColumn("engine", F.when(better, F.concat("primary_engine", F.lit("+"), "fallback_engine")).otherwise(F.col("primary_engine")))


def merge_ocr_documents(both: DataFrame) -> DataFrame:
    """Rows of (primary, fallback: JSON results; primary_engine, fallback_engine, primary_avg_confidence) with merged (JSON) and used_fallback_text.

    document_info, entities, tables and totals are the fallback's unless it has
    none or an empty one; raw_text and raw_text_fallback are its if its text
    replaces the first (merge_ocr_results) and they aren't empty; _meta joins
    both, the fallback's winning, with where the result comes from. All other
    keys are the first one's. JSON that is no object counts as an empty one.
    """
    fields = lambda c: F.coalesce(F.try_variant_get(F.try_parse_json(F.col(c)), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    inner = lambda m: F.coalesce(F.try_variant_get(F.try_element_at(m, F.lit("_meta")), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    rows = both.withColumn("_p", fields("primary")).withColumn("_f", fields("fallback"))
    text = lambda m: F.try_variant_get(F.try_element_at(m, F.lit("raw_text")), "$", "string")
    rows = merge_ocr_results(rows.withColumn("primary_text", text(F.col("_p"))).withColumn("fallback_text", text(F.col("_f")))).drop("primary_text", "fallback_text", "raw_text", "engine")
    empty = lambda v: F.to_json(v).isin("null", '""', "[]", "{}")
    names = lambda k: k.isin("document_info", "entities", "tables", "totals") | (F.col("used_fallback_text") & k.isin("raw_text", "raw_text_fallback"))
    rows = rows.withColumn("_own", F.map_filter("_f", lambda k, v: names(k) & ~F.coalesce(empty(v), F.lit(True))))
    first = F.map_filter("_p", lambda k, v: ~F.array_contains(F.map_keys("_own"), k) & (k != "_meta"))
    news = ["primary_engine", "fallback_engine", "primary_avg_confidence", "fallback_triggered", "fallback_raw_text_replaced"]
    told = F.to_json(F.struct("primary_engine", "fallback_engine", "primary_avg_confidence", F.lit(True).alias(news[3]), F.col("used_fallback_text").alias(news[4])), {"ignoreNullFields": "false"})
    old = X.let(inner(F.col("_f")), lambda f: F.map_concat(F.map_filter(inner(F.col("_p")), lambda k, v: ~F.array_contains(F.map_keys(f), k)), f))
    old = F.map_filter(old, lambda k, v: ~k.isin(news))
    rows = rows.withColumn("_meta", _joined(F.to_json(old), told)).withColumn("_all", F.to_json(F.map_concat(first, "_own")))
    return rows.withColumn("merged", _joined(F.col("_all"), F.concat(F.lit('{"_meta":'), "_meta", F.lit("}")))).drop("_p", "_f", "_own", "_meta", "_all")


def _joined(a: Column, b: Column) -> Column:
    """Two JSON objects of different keys as one."""
    return F.when(a == "{}", b).otherwise(F.concat(F.substring(a, F.lit(1), F.length(a) - 1), F.lit(","), F.substring(b, F.lit(2), F.length(b))))


def merge_fields(primary: DataFrame, fallback: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """Long fields (doc_id, name, value, confidence, is_valid) merged: the fallback's value where it is there and valid, or the first is blank.

    from_fallback tells which; required fields that neither has are blank with
    confidence 0.
    """
    p = primary.select(F.col("doc_id").alias("p_doc"), F.col("name").alias("p_name"), F.col("value").alias("p_value"), F.col("confidence").alias("p_conf"))
    both = p.join(fallback.select("doc_id", "name", "value", "confidence", "is_valid"), (F.col("p_doc") == F.col("doc_id")) & (F.col("p_name") == F.col("name")), "full")
    none = lambda c: F.coalesce(X.strip_space(F.col(c)) == "", F.lit(True))
    take = ~none("value") & (F.coalesce("is_valid", F.lit(False)) | none("p_value"))
    merged = both.select(
        F.coalesce("p_doc", "doc_id").alias("doc_id"), F.coalesce("p_name", "name").alias("name"), F.when(take, F.col("value")).otherwise(F.coalesce("p_value", F.lit(""))).alias("value"),
        F.when(take, F.coalesce("confidence", F.lit(0.0))).otherwise(F.coalesce("p_conf", F.lit(0.0))).alias("confidence"), take.alias("from_fallback"),
    )
    wanted = merged.select("doc_id").distinct().select(F.col("doc_id").alias("w_doc"), F.explode(F.array(*[F.lit(n) for n in required])).alias("w_name"))
    full = merged.join(wanted, (F.col("doc_id") == F.col("w_doc")) & (F.col("name") == F.col("w_name")), "full")
    return full.select(F.coalesce("doc_id", "w_doc").alias("doc_id"), F.coalesce("name", "w_name").alias("name"), F.coalesce("value", F.lit("")).alias("value"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("from_fallback", F.lit(False)).alias("from_fallback"))


def schema_confidence(fields: DataFrame, spec: DataFrame) -> DataFrame:
    """(doc_id, schema_confidence): share of the schema's required fields (all, if none is) that have a value, to 2 places.

    fields: doc_id, schema_id, name, value; spec: schema_id, name, required. The
    names that a document has are gathered in one grouping and met with the
    schema's, which are sent to the tasks.
    """
    asked = F.collect_list(F.struct("name", "required"))
    wanted = spec.groupBy(F.col("schema_id").alias("s_schema")).agg(asked.alias("asked"), F.bool_or("required").alias("some"))
    wanted = wanted.select("s_schema", F.transform(F.filter("asked", lambda e: e["required"] | ~F.col("some")), lambda e: e["name"]).alias("wanted"))
    has = F.col("doc_id").isNotNull() & (X.strip_space(F.col("value")) != "") & (F.col("value") != PLACEHOLDER)
    docs = fields.groupBy("doc_id").agg(F.collect_set("schema_id").alias("schemas"), F.collect_set(F.when(has, F.col("name"))).alias("have"))
    joined = docs.select("doc_id", "have", F.explode("schemas").alias("schema_id")).join(F.broadcast(wanted), F.col("schema_id") == F.col("s_schema"))
    hits = F.size(F.filter("wanted", lambda n: F.array_contains("have", n)))
    return joined.where(F.size("wanted") > 0).groupBy("doc_id").agg(F.round(F.sum(hits) / F.sum(F.size("wanted")), 2).alias("schema_confidence"))
