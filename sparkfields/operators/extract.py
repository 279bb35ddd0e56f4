"""Fields from text: patterns, labelled lines, blocks, and the prompts and answers of a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

# Patterns of payment slips and bills.
LINHA = r"(\d{5}\.?\d{5}\s+\d{5}\.?\d{6}\s+\d{5}\.?\d{6}\s+\d\s+\d{14})"
DATE = r"\b(\d{2}[/-]\d{2}[/-]\d{2,4})\b"
AMOUNT = r"(?i)(?:valor|total)\s*[:\-]?\s*(R\$\s*\d{1,3}(?:\.\d{3})*,\d{2}|\d{1,3}(?:\.\d{3})*,\d{2})"
PAYEE = r"(?i)(?:benefici[aá]rio|cedente)\s*[:\-]?\s*([A-Za-z0-9 .&/-]{3,80})"
UNIT = r"(?i)(?:unidade|uc)\s*[:\-]?\s*([A-Za-z0-9 .&/-]{2,40})"
KWH = r"(?i)(\d+(?:,\d+)?)\s*kwh"
SCHEMA_OF_LAYOUT = {"boleto_caixa": "boleto", "boleto_bb": "boleto", "boleto_bradesco": "boleto", "fatura_energia": "fatura", "fatura_condominio": "fatura"}
PLACEHOLDER = "Valor não encontrado"
# First and last lines of the blocks of a service invoice.
BLOCKS = {
    "emitente": (r"emitente\s+da\s+nfs-?e", [r"tomador\s+do\s+servi[çc]o", r"intermedi[áa]rio"]),
    "tomador": (r"tomador\s+do\s+servi[çc]o", [r"intermedi[áa]rio", r"servi[çc]o\s+prestado"]),
    "servico": (r"servi[çc]o\s+prestado", [r"tributa[çc][ãa]o\s+municipal", r"tributa[çc][ãa]o\s+federal"]),
    "municipal": (r"tributa[çc][ãa]o\s+municipal", [r"tributa[çc][ãa]o\s+federal", r"informa[çc][õo]es\s+complementares"]),
    "federal": (r"tributa[çc][ãa]o\s+federal", [r"informa[çc][õo]es\s+complementares"]),
}
# Labels and words of candidate lines, and names of sections that are no labels.
CANDIDATE_LABELS = {
    "fornecedor": r"\bprestador\b|\bfornecedor\b|\bemitente\b|\brazao\s+social\b|\bnome\s+empresarial\b|\bnome\s*[:\-–—]",
    "tomador": r"\btomador\b|\bcliente\b|\bdestinat[áa]rio\b|\bbenefici[áa]rio\b|\bsegurado\b|\bnome\s*[:\-–—]",
    "descricao_servico": r"\bdescri[çc][aã]o\b|\bhist[óo]rico\b|\breferente\s+a\b|\bobserva[çc][aã]o\b",
}
# What a line with such a label holds at least, in lower case.
CANDIDATE_WORDS = {
    "fornecedor": ["prestador", "fornecedor", "emitente", "razao", "empresarial", "nome"],
    "tomador": ["tomador", "cliente", "destinat", "benefici", "segurado", "nome"],
    "descricao_servico": ["descri", "hist", "referente", "observa"],
}
NAME_STOPS = ["recibo", "indeniz", "importancia", "importância", "anyscanner", "valor", "retenc", "reembolso", "nota fiscal", "nfs-e"]
NUMBER_PATTERNS = [r"(?i)\bnf\s*(?:e|nfs-?e)?\b\s*[:\-–—]?\s*([0-9]{4,})", r"(?i)\bnota\s+fiscal\b\s*[:\-–—]?\s*([0-9]{4,})", r"(?i)\bn[úu]mero\b\s*[:\-–—]?\s*([0-9]{4,})", r"(?i)\brecibo\b\s*(?:n[º°o]?|numero)?\s*[:\-–—]?\s*([0-9]{4,})"]
MONEY = r"(?:(?i:R\$)\s*)?(?:\d{1,3}(?:\.\d{3})*,\d{2}|\d+,\d{2}|\d+\.\d{2})"
CANDIDATE_CNPJ = r"(\d{2}[\.\s]?\d{3}[\.\s]?\d{3}/?\d{4}-?\d{2}|\b\d{14}\b)"
RETENTION_PATTERNS = [r"(?iu)\breten[cç][aã]o\b\s*[:\-–—]?\s*(?:R\$\s*)?(\d+[\.,]\d{2}|0[\.,]00)\b", r"(?i)\biss\b\s*(?:retido)?\s*[:\-–—]?\s*(?:R\$\s*)?(\d+[\.,]\d{2}|0[\.,]00)\b"]
NO_RETENTION = ["sem retenção", "sem retencao", "nao retido", "não retido", "isento"]
SECTION_NAMES = ["nfs-e", "nfse", "danfse", "servico prestado", "tributacao municipal", "tributacao federal", "informacoes complementares"]
LABEL = f"[{X.LETTER}0-9][{X.LETTER}0-9\\s()/%\\-.]{{1,80}}"


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """First match, trimmed; null without one."""
    return F.nullif(X.strip_space(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group)), F.lit(""))


def extract_boleto(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """df with linha_digitavel, vencimento, valor, beneficiario, confidence, requires_human_validation."""
    t = F.col(text_col)
    found = {"linha_digitavel": first(t, LINHA), "vencimento": first(t, DATE), "valor": first(t, AMOUNT), "beneficiario": first(t, PAYEE)}
    return _confident(df, found)


def extract_fatura(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """df with vencimento, valor, unidade, consumo_kwh, confidence, requires_human_validation."""
    t = F.col(text_col)
    return _confident(df, {"vencimento": first(t, DATE), "valor": first(t, AMOUNT), "unidade": first(t, UNIT), "consumo_kwh": first(t, KWH)})


def _confident(df: DataFrame, found: dict[str, Column]) -> DataFrame:
    rows = df.withColumns(found)
    have = F.lit(0)
    for name in found:
        have = have + F.col(name).isNotNull().cast("int")
    return rows.withColumn("confidence", have / len(found)).withColumn("requires_human_validation", have / len(found) < 0.75)


def extract_generic(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """df with texto, its first 500 characters, confidence, requires_human_validation."""
    t = X.strip_space(F.coalesce(F.col(text_col), F.lit("")))
    return df.withColumn("texto", F.substring(t, 1, 500)).withColumn("confidence", F.when(t == "", 0.0).otherwise(0.25)).withColumn("requires_human_validation", F.lit(True))


def schema_of_layout(layout: Column) -> Column:
    out = F.lit("generic")
    for k, v in SCHEMA_OF_LAYOUT.items():
        out = F.when(layout == k, F.lit(v)).otherwise(out)
    return out


def _after_sign(line: Column, signs: str) -> Column:
    """What follows the first of the signs; empty if there is none or nothing follows."""
    return X.strip_space(F.regexp_extract(line, f"(?s)^[^{signs}]*[{signs}]\\s*(.*)$", 1))


def labelled_value(lines: Column, labels: list[str]) -> Column:
    """From the lines with a label, the first text after : or -, else after the label; empty without one."""
    has = lambda x: X.let(F.lower(x), lambda low: X.has_any(low, labels))

    def value(x: Column) -> Column:
        after = F.lit("")
        for label in reversed(labels):
            at = F.locate(label, F.lower(x))
            rest = F.regexp_replace(F.substring(x, at + len(label), F.length(x)), r"^[ :\-]+|[ :\-]+$", "")
            after = F.when((at > 0) & (rest != ""), rest).otherwise(after)
        return F.when(_after_sign(x, ":\\-") != "", _after_sign(x, ":\\-")).otherwise(after)

    return F.coalesce(F.get(F.filter(F.transform(F.filter(lines, has), value), lambda v: v != ""), 0), F.lit(""))


def _where(lines: Column, pattern: str, start: Column | None = None) -> Column:
    """Place (from 1) of the first line that matches, after `start` if given; 0 without one."""
    hits = F.transform(lines, lambda x, i: F.when(((i + 1 > start) & x.rlike(f"(?iu){pattern}")) if start is not None else x.rlike(f"(?iu){pattern}"), i + 1))
    return F.coalesce(F.array_min(hits), F.lit(0))


def block(lines: Column, start: Column, end: Column) -> Column:
    """Lines from place `start` to before `end` (0: to the last); none if start is 0."""
    stop = F.when(end > 0, end).otherwise(F.size(lines) + 1)
    return F.when(start > 0, F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(stop - start, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def slice_blocks(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """df with lines, and an array of lines for each block of a service invoice; other texts have empty blocks."""
    rows = df.withColumn("lines", X.lines(F.col(text_col)))
    is_invoice = F.lower(F.col(text_col)).rlike("nfs-e|danfse|nfse")
    own = F.when(is_invoice, F.col("lines")).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_own", own).withColumns({f"_{k}_from": _where(F.col("_own"), a) for k, (a, _) in BLOCKS.items()})
    rows = rows.withColumns({f"_{k}_to": _where(F.col("_own"), f"(?:{'|'.join(ends)})", F.col(f"_{k}_from")) for k, (_, ends) in BLOCKS.items()})
    rows = rows.withColumns({f"{k}_block": block(F.col("_own"), F.col(f"_{k}_from"), F.col(f"_{k}_to")) for k in BLOCKS})
    return rows.drop("_own", *[f"_{k}_{x}" for k in BLOCKS for x in ("from", "to")])


def _matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _cleaned(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, X.clean_line), lambda v: v != ""))


def field_candidates(df: DataFrame, k: int = 8, text_col: str = "raw_text") -> DataFrame:
    """df with an array of at most k candidates for each field.

    Labelled lines come first; names fall back on lines of the first 40 that
    look like one, best score first, descriptions on the three longest lines.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    rows = df.withColumn("_lines", X.lines(text)).withColumn("_text", text).withColumn("_low", F.lower(text)).withColumn("_odd", text.rlike(X.ODD_CASE))
    # a text without these words has no line, or no place, with the pattern: what follows is done for the others alone
    said = lambda words: F.col("_odd") | X.has_any(F.col("_low"), words)

    def labelled(name: str, pattern: str) -> Column:
        def value(x: Column) -> Column:
            after = _after_sign(x, ":\\-–—")
            rest = F.regexp_replace(F.regexp_replace(x, f"(?iu)^.*?(?:{pattern})", ""), r"^[ :\-–—]+|[ :\-–—]+$", "")
            return F.when(after != "", after).otherwise(rest)

        found = F.transform(F.filter(F.col("_lines"), lambda x: x.rlike(f"(?iu){pattern}")), value)
        return F.when(said(CANDIDATE_WORDS[name]), _cleaned(F.slice(F.filter(found, lambda v: v != ""), 1, k))).otherwise(none)

    rows = rows.withColumns({f"_{n}": labelled(n, p) for n, p in CANDIDATE_LABELS.items()})
    names = F.filter(F.slice("_lines", 1, 40), lambda x: (F.length(x) <= 90) & ~X.let(F.lower(x), lambda low: X.has_any(low, NAME_STOPS)) & X.named(x))
    ranked = F.sort_array(F.transform(names, lambda x, i: F.struct((-X.named_score(x)).alias("s"), i.alias("i"), x.alias("x"))))
    asked = (F.size("_fornecedor") == 0) | (F.size("_tomador") == 0)
    rows = rows.withColumn("_names", F.when(asked, F.array_distinct(F.transform(F.slice(ranked, 1, min(6, k)), lambda r: r["x"]))).otherwise(none))
    long = F.filter("_lines", lambda x: (F.length(x) >= 60) & (F.length(x) <= 600) & ~X.heading(x))
    longest = F.sort_array(F.transform(long, lambda x, i: F.struct((-F.length(x)).alias("s"), i.alias("i"), x.alias("x"))))
    rows = rows.withColumn("_long", F.array_distinct(F.transform(F.slice(longest, 1, min(3, k)), lambda r: r["x"])))
    money = F.filter(_matches(F.col("_text"), f"({MONEY})"), lambda m: m.contains(",") | F.lower(m).startswith("r$"))
    plain = F.transform(money, lambda m: F.regexp_replace(F.regexp_replace(m, r"(?i)R\$\s*", ""), r"\.(?=.*,)", ""))
    cnpj = _cleaned(_matches(F.col("_text"), CANDIDATE_CNPJ))
    valid = F.filter(cnpj, X.cnpj_valid)
    numbers = F.when(said(["nf", "nota", "mero", "recibo"]), F.filter(_cleaned(F.flatten(F.array(*[_matches(F.col("_text"), p) for p in NUMBER_PATTERNS]))), lambda v: (F.length(v) >= 4) & (F.length(v) <= 12))).otherwise(none)
    kept = F.when(said(["reten", "iss"]), F.concat(*[_matches(F.col("_text"), p) for p in RETENTION_PATTERNS])).otherwise(none)
    kept_back = _cleaned(F.concat(kept, F.when(X.has_any(F.col("_low"), NO_RETENTION), F.array(F.lit("0,00"))).otherwise(none)))
    rows = rows.withColumns({"_money": _cleaned(plain), "_kept": kept_back})
    or_else = lambda a, b: F.when(F.size(a) > 0, a).otherwise(b)
    out = {
        "fornecedor": or_else(F.col("_fornecedor"), F.col("_names")), "tomador": or_else(F.col("_tomador"), F.col("_names")), "cnpj_fornecedor": or_else(valid, cnpj),
        "numero_nf": numbers, "descricao_servico": or_else(F.col("_descricao_servico"), F.col("_long")), "valor_nf": F.slice("_money", 1, k),
        "retencao": or_else(F.col("_kept"), F.slice("_money", 1, min(3, k))),
    }
    rows = rows.withColumns({f"{n}_candidates": F.slice(c, 1, k) for n, c in out.items()})
    return rows.drop("_lines", "_text", "_low", "_odd", "_names", "_long", "_money", "_kept", *[f"_{n}" for n in CANDIDATE_LABELS])


def label_value_fields(df: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text", most: int = 120) -> DataFrame:
    """(doc_id, place, name, value): lines `Label: value` or `Label - value`, at most `most` a document.

    Repeated values of a name are dropped, further values get _2, _3 and so on.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.posexplode(X.lines(F.col(text_col))).alias("place", "line"))
    colon, dash = rf"^({LABEL})\s*:\s*(.+)$", rf"^({LABEL})\s+-\s+(.+)$"
    pattern = F.when(F.col("line").rlike(colon), F.lit(1)).when(F.col("line").rlike(dash), F.lit(2))
    part = lambda g: F.when(pattern == 1, F.regexp_extract("line", colon, g)).when(pattern == 2, F.regexp_extract("line", dash, g))
    rows = rows.select("doc_id", "place", X.clean_line(part(1)).alias("label"), X.clean_line(part(2)).alias("value")).where("label != ''")
    letters = F.length(F.regexp_replace("label", f"[^{X.LETTER}]", ""))
    good_label = F.length("label").between(2, 80) & (letters >= 2) & ~X.without_accents(F.col("label")).isin(SECTION_NAMES)
    rows = rows.withColumn("key", X.snake_key(F.col("label")))
    numbers = F.length(X.digits(F.col("value")))
    refused = (
        X.is_header_like(F.col("value")) | F.col("value").rlike(f"^[{X.LETTER}]$") | (F.col("key").contains("chave_de_acesso") & (numbers < 20))
        | (F.col("key").contains("cnpj") & (numbers > 0) & (numbers != 14)) | (F.col("key").contains("numero_da_nfs") & (numbers == 0))
    )
    rows = rows.where(good_label & (F.col("key") != "") & ~refused).withColumn("value", X.strip_space(F.substring("value", 1, 500)))
    rows = rows.groupBy("doc_id", "key", "value").agg(F.min("place").alias("place"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("place"))
    rows = rows.withColumn("name", F.when(nth > 1, F.concat("key", F.lit("_"), nth.cast("string"))).otherwise(F.col("key")))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))
    return rows.withColumn("at", at).where(F.col("at") <= most).select("doc_id", F.col("place").cast("long").alias("place"), "name", "value")


def stacked_label_fields(df: DataFrame, labels: dict[str, str], id_col: str = "doc_id", text_col: str = "raw_text", within: int = 3) -> DataFrame:
    """(doc_id, name, value): a line that is a label (name -> pattern), and the value on one of the next lines.

    The value is the first of the next `within` lines that isn't a label or a
    heading; an access key is the first run of 44 digits within five lines.
    """
    lines = X.lines(F.col(text_col))
    rows = df.select(F.col(id_col).alias("doc_id"), lines.alias("lines"))
    parts = []
    any_label = "|".join(f"(?:{p})" for p in labels.values())
    for name, pattern in labels.items():
        at = _where(F.col("lines"), f"^(?:{pattern})$")
        key = name == "chave_de_acesso"
        following = F.when(at > 0, F.slice("lines", at + 1, 5 if key else within)).otherwise(F.array().cast("array<string>"))
        if key:
            value = F.get(F.filter(F.transform(following, X.digits), lambda d: F.length(d) >= 44), 0)
        else:
            stop = F.coalesce(F.array_min(F.transform(following, lambda x, i: F.when(x.rlike(f"(?iu)^(?:{any_label})$"), i))), F.lit(within))
            value = F.get(F.filter(F.slice(following, F.lit(1), stop), lambda x: ~X.is_header_like(x)), 0)
        parts.append(F.struct(F.lit(name).alias("name"), value.alias("value")))
    return rows.select("doc_id", F.inline(F.array(*parts))).where("value is not null")


def flatten_structured(df: DataFrame, id_col: str = "doc_id", columns: tuple[str, ...] = ("document_info", "entities", "totals")) -> DataFrame:
    """(doc_id, name, value): scalars of JSON columns under snake names."""
    parts = None
    for c in columns:
        rows = df.select(F.col(id_col).alias("doc_id"), F.explode(F.from_json(c, "map<string,string>")).alias("key", "value"))
        rows = rows.where("value is not null and not value rlike '^\\\\s*[\\\\[{]' and trim(value) != ''").select("doc_id", X.snake_key(F.col("key")).alias("name"), X.clean_line(F.col("value")).alias("value"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.where("name != ''")


def find_invoice_tokens(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """df with arrays cnpjs, dates and amounts of all that the text has."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumns({"cnpjs": _matches(t, r"(\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2})"), "dates": _matches(t, r"(\d{2}/\d{2}/\d{4})"), "amounts": _matches(t, r"(R\$\s*[\d.]+,\d{2})")})


def render_prompts(docs: DataFrame, fields: DataFrame, text_col: str = "raw_text", most: int = 8000) -> DataFrame:
    """docs (with schema_id) with prompt: instructions, the schema's fields, the text up to `most` characters.

    fields has schema_id, seq, name, type, rule, required; the call to a model
    is the user's, see extract_with.
    """
    line = F.concat(F.lit("- "), "name", F.when(F.col("required"), "*").otherwise(""), F.lit(" ("), "type", F.lit(")"), F.when(F.coalesce("rule", F.lit("")) != "", F.concat(F.lit(" — "), "rule")).otherwise(""))
    item = F.concat(F.lit('  "'), "name", F.lit('": {"value": "", "confidence": 0.0}'))
    spec = fields.groupBy(F.col("schema_id").alias("of_schema")).agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line"), item.alias("item")))).alias("spec"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("\n[texto truncado]"))).otherwise(text)
    # null-safe, as a null test pushed below would evaluate the schema's rules a second time
    joined = docs.join(spec.where("of_schema is not null"), F.col("schema_id").eqNullSafe(F.col("of_schema")))
    prompt = F.concat(
        F.lit("Extraia os campos do documento e responda somente com JSON.\n\nCampos:\n"), F.array_join(F.transform("spec", lambda x: x["line"]), "\n"), F.lit("\n\nTexto:\n"), cut,
        F.lit("\n\nFormato:\n{\n"), F.array_join(F.transform("spec", lambda x: x["item"]), ",\n"), F.lit("\n}"),
    )
    return joined.withColumn("prompt", prompt).drop("of_schema", "spec")


def parse_responses(df: DataFrame, names: list[str], id_col: str = "doc_id", response_col: str = "response") -> DataFrame:
    """(doc_id, name, value, confidence): answers in JSON, plain or fenced, nested or flat, whole or broken off.

    What is missing or null has the placeholder and confidence 0; a flat value
    without its own confidence has 0.5.
    """
    raw = F.coalesce(F.col(response_col), F.lit(""))
    body = F.regexp_extract(F.regexp_replace(raw, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    rows = df.select(F.col(id_col).alias("doc_id"), raw.alias("raw"), F.from_json(body, "map<string,string>").alias("m"))
    out = rows.select("doc_id", "raw", "m", F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    whole = F.try_element_at("m", F.col("name"))
    nested = whole.rlike(r"^\s*\{")
    sq = lambda p: F.regexp_extract("raw", p, 1)
    value, conf = F.lit(None).cast("string"), F.lit(None).cast("double")
    for n in names:
        broken_value = F.coalesce(F.nullif(sq(rf'"{n}"\s*:\s*\{{\s*"value"\s*:\s*"([^"]*)"'), F.lit("")), F.nullif(sq(rf'"{n}"\s*:\s*"([^"]*)"'), F.lit("")))
        broken_conf = sq(rf'"{n}"\s*:\s*\{{\s*"value"\s*:\s*"[^"]*"\s*,\s*"confidence"\s*:\s*([0-9.]+)').try_cast("double")
        value = F.when(F.col("name") == n, broken_value).otherwise(value)
        conf = F.when(F.col("name") == n, broken_conf).otherwise(conf)
    found = F.when(F.col("m").isNull(), value).when(nested, F.get_json_object(whole, "$.value")).otherwise(whole)
    sure = F.when(F.col("m").isNull(), conf).when(nested, F.get_json_object(whole, "$.confidence").try_cast("double"))
    found = F.nullif(X.strip_space(found), F.lit(""))
    return out.select("doc_id", "name", F.coalesce(found, F.lit(PLACEHOLDER)).alias("value"), F.when(found.isNull(), 0.0).otherwise(X.confidence_ratio(F.coalesce(sure, F.lit(0.5)))).alias("confidence"))


def ocr_json_to_text(df: DataFrame, response_col: str = "response") -> DataFrame:
    """df with text and parse_error: extracted_text of a JSON answer, of its broken-off start, or its key_values as lines."""
    raw = F.regexp_replace(F.coalesce(F.col(response_col), F.lit("")), r"```(?:json)?", "")
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "extracted_text string, key_values map<string,string>")
    unescape = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit('\\"'), F.lit('"'))
    start = unescape(F.regexp_extract(raw, r'(?s)"extracted_text"\s*:\s*"((?:[^"\\]|\\.)*)', 1))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("_p.key_values")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    rows = df.withColumn("_p", parsed).withColumn("_start", start)
    whole = X.blank_to_null(F.col("_p.extracted_text"))
    text = F.coalesce(whole, X.blank_to_null(pairs), X.blank_to_null(F.col("_start")), F.lit(""))
    return rows.withColumn("text", text).withColumn("parse_error", text == "").drop("_p", "_start")


def source_line_preview(docs: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(doc_id, name, line, confidence, state): first line that names each field in lower case with blanks for _."""
    lines = X.lines(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), lines.alias("lines"))
    said = lambda word: F.filter("lines", lambda x: F.contains(F.lower(x), F.lit(word)))
    parts = [F.struct(F.lit(n).alias("name"), F.get(said(n.lower().replace("_", " ")), 0).alias("line")) for n in names]
    found = F.col("line").isNotNull()
    return rows.select("doc_id", F.inline(F.array(*parts))).select("doc_id", "name", "line", F.when(found, 0.5).otherwise(0.0).alias("confidence"), F.when(found, "candidate").otherwise("missing").alias("state"))


def segment_sections(docs: DataFrame, anchors: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(doc_id, section, first, text): sections that begin at the first of their anchor phrases, each up to the next section."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), low.alias("low"))
    parts = []
    for name, phrases in anchors.items():
        places = [F.nullif(F.locate(p.lower(), F.col("low")), F.lit(0)) for p in phrases]
        parts.append(F.struct(F.lit(name).alias("section"), F.least(*places, *places[:1]).alias("first")))
    rows = rows.select("doc_id", "text", F.inline(F.array(*parts))).where("first is not null")
    end = F.lead("first").over(Window.partitionBy("doc_id").orderBy("first", "section"))
    return rows.withColumn("end", end).select("doc_id", "section", F.col("first").cast("long").alias("first"), F.substring("text", F.col("first"), F.coalesce("end", F.length("text") + 1) - F.col("first")).alias("text"))


def extract_with(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn over Arrow batches as pandas frames, for users with an OCR or model client of their own."""
    return df.mapInPandas(fn, schema)
