"""Fields of badly read texts: digits that were read as letters or as each other, values near their labels, amounts by what stands around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

# Classes and engines whose texts count as badly read.
CLASSES = ["scanned_image", "handwritten_complex"]
ENGINES = ["paddle", "paddleocr", "easyocr", "trocr", "handwritten_region", "handwritten_region_pipeline", "tesseract"]

# Labels of the parties' names and tax numbers.
NAME_LABELS = {"fornecedor": r"fornecedor|prestador|emitente|benefici[áa]rio|empresa", "tomador": r"tomador|destinat[áa]rio|cliente|pagador|favorecido"}
CNPJ_LABELS = {"cnpj_fornecedor": r"fornecedor|prestador|emitente|benefici[áa]rio", "cnpj_tomador": r"tomador|destinat[áa]rio|cliente|pagador"}
# A tax number with or without its marks, an amount, and what stands before a document's number.
CNPJ = r"\b\d{2}[\./\s-]?\d{3}[\./\s-]?\d{3}[\./\s-]?\d{4}[\./\s-]?\d{2}\b"
AMOUNT = r"\b(\d{1,3}(?:\.\d{3})*,\d{2}|\d+\.\d{2})\b"
NUMBERS = [
    r"(?i)(?:recibo|nf|nfs-?e|nota\s*fiscal)\s*(?:n[º°o]?|numero)?\s*[:#\-]?\s*([A-Za-z0-9./-]{1,30})",
    r"(?i)numero\s*(?:do\s*)?(?:recibo|documento|nf|nfs-?e)?\s*[:#\-]?\s*([A-Za-z0-9./-]{1,30})",
]
# Words around an amount and what they add to it, words of a description and where one ends, words of retention.
AROUND = 40
MONEY, MONEY_ADDS = r"r\$|rs|r5", 10000.0
TOTAL, TOTAL_ADDS = "importancia|valor|reembolso|total", 2500.0
OTHER, OTHER_ADDS = "cpf|pix|celular|telefone", -9000.0
ABOUT = r"(?i)(?:referente\s+a|referente\s+ao|descricao(?:\s+do\s+servico)?)\s*[:\-]?\s*(.+)"
ABOUT_ENDS = r"(?i)(?:\ba\s+quitacao\b|\btitular\b|\bconta\s+pix\b|\bcpf\b|\brecife\b\s*,?\s*\d{1,2}\b)"
SERVICES = "reembolso|indeniza|manutenc|prest|servi"
RETENTION = "reten|retido|iss|inss|pis|cofins|csll|irrf"
# How sure a field is when it is found.
SURE = {"fornecedor": 0.70, "tomador": 0.68, "cnpj_fornecedor": 0.90, "cnpj_tomador": 0.88, "numero_nf": 0.64, "descricao_servico": 0.62, "valor_nf": 0.86, "retencao": 0.58}
#: Digits that are read for each other: for each digit, what it may have been.
LOOK_ALIKES = {"0": "689", "1": "47", "2": "7", "3": "8", "4": "19", "5": "68", "6": "058", "7": "12", "8": "0369", "9": "048"}


def is_noisy(classification: Column, engine: Column) -> Column:
    """Whether the class or the engine is one of those whose texts are badly read."""
    named = lambda c, known: F.lower(X.strip_space(F.coalesce(c, F.lit("")))).isin(known)
    return named(classification, CLASSES) | named(engine, ENGINES)


def valid_cnpjs(text: Column) -> Column:
    """The tax numbers of a text whose check digits hold, letters read as digits, formatted, each once, in order."""
    return _valid_cnpjs(X.ocr_digit_fix(F.coalesce(text, F.lit(""))))


def _valid_cnpjs(fixed: Column) -> Column:
    found = F.regexp_extract_all(fixed, F.lit(CNPJ), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, X.cnpj_valid), X.cnpj_format))


def repaired_cnpj(number: Column) -> Column:
    """A tax number with its misread digits set right: as it is if its check digits hold, else with the one look-alike digit changed that makes them hold.

    Null if it has other than 14 digits, if no change helps, or if several do.
    """
    fixed = X.digits(X.ocr_digit_fix(F.coalesce(number, F.lit(""))))
    swaps = F.create_map(*[F.lit(x) for pair in LOOK_ALIKES.items() for x in pair])

    def others(d: Column) -> Column:
        def at(k: Column) -> Column:
            instead = F.split(F.element_at(swaps, F.substring(d, k, F.lit(1))), "")
            return F.transform(instead, lambda c: F.concat(F.substring(d, F.lit(1), k - 1), c, F.substring(d, k + 1, F.lit(14))))

        every = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(14)), at))
        return X.let(F.filter(every, X.cnpj_valid), lambda ok: F.when(F.size(ok) == 1, F.get(ok, 0)))

    whole = X.let(fixed, lambda d: F.when(X.cnpj_valid(d), d).when(F.length(d) == 14, others(d)))
    return F.regexp_replace(whole, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")


def _words(labels: str) -> list[str]:
    """The texts that a pattern of labels stands for."""
    return [w for x in labels.split("|") for w in ([x.replace("[áa]", c) for c in "áa"] if "[áa]" in x else [x])]


def _has(low: Column, labels: str) -> Column:
    """Whether a text in lower case has one of the labels: no label has a space, so some line has it then."""
    return X.has_any(low, _words(labels))


def _first_of(lines: Column, test, value=lambda x: x) -> Column:  # noqa: ANN001
    """The first value of a line that passes the test, else the empty text; lines after it aren't looked at."""
    def step(found: Column, line: Column) -> Column:
        return F.when(found != "", found).otherwise(X.let(value(line), lambda v: F.when(test(v), v).otherwise("")))

    return F.aggregate(lines, F.lit(""), step)


def _said(line: Column, labels: str) -> Column:
    return X.let(F.lower(line), lambda low: _has(low, labels))


def _at(lines: Column, labels: str) -> Column:
    """The places, from 1 on, of lines with a label."""
    return F.filter(F.transform(lines, lambda x, i: F.when(_said(x, labels), i + 1)), lambda i: i.isNotNull())


def _near_name(lines: Column, labels: str) -> Column:
    """The first line that may be a name, of those at or up to three under a label (without the label); else empty."""
    def bare(line: Column) -> Column:
        return F.when(line.rlike(f"(?i){labels}"), X.strip_space(F.regexp_replace(line, r"^[^:\-]*[:\-]\s*", ""))).otherwise(line)

    # in order of place: what comes first under the labels is the first under the first label that has any
    near = X.let(_at(lines, labels), lambda at: F.filter(lines, lambda x, i: F.exists(at, lambda k: (i + 1 >= k) & (i + 1 < k + 4))))
    return _first_of(near, X.named, bare)


def _labelled_cnpj(lines: Column, labels: str) -> Column:
    """The first valid tax number at or up to two lines under a label; the labels in order."""
    def number(i: Column) -> Column:
        return F.coalesce(F.get(valid_cnpjs(F.array_join(F.slice(lines, i, F.lit(3)), " ")), 0), F.lit(""))

    return _first_of(_at(lines, labels), lambda v: v != "", number)


def _number(lines: Column, fixed: Column) -> Column:
    """What stands after a number's label, line by line and then in the whole text, if it has a digit and isn't a heading."""
    fits = lambda v: v.rlike(r"\d") & (F.length(v) <= 25) & ~X.is_header_like(v)
    tried = lambda t: F.array(*[F.regexp_extract(t, p, 1) for p in NUMBERS])
    # letters that look like digits are digits by now, o too: of the labels only those with nf are left
    some = F.filter(lines, lambda x: F.lower(x).contains("nf"))
    found = _first_of(F.flatten(F.transform(some, lambda x: tried(X.ocr_digit_fix(x)))), fits)
    return X.let(found, lambda v: F.when(v != "", v).otherwise(_first_of(tried(fixed), fits)))


def best_amount(text: Column) -> Column:
    """_best_amount with letters read as digits."""
    return _best_amount(X.ocr_digit_fix(F.coalesce(text, F.lit(""))))


def _best_amount(fixed: Column) -> Column:
    """The amount with the most value and the best words within AROUND characters; the first of equals, empty if none counts for anything.

    The text is cut before each amount, and one walk over the pieces knows where
    each begins.
    """
    whole = F.when(X.has_any(fixed, ["\x01", "\x02"]), F.translate(fixed, "\x01\x02", "  ")).otherwise(fixed)

    def walk(t: Column, pieces: Column) -> Column:
        start = F.struct(F.length(F.get(pieces, 0)).alias("at"), F.lit(-1.0).alias("score"), F.lit("").alias("value"))

        def step(best: Column, piece: Column) -> Column:
            low = F.greatest(F.lit(0), best["at"] - AROUND)
            after = (best["at"] + F.length(piece) - 1).cast("int").alias("at")

            def adds(near: Column) -> Column:
                words = [F.when(X.has_any(near, p.replace("\\", "").split("|")), F.lit(x)).otherwise(0.0) for p, x in ((MONEY, MONEY_ADDS), (TOTAL, TOTAL_ADDS), (OTHER, OTHER_ADDS))]
                return words[0] + words[1] + words[2]

            def better(value: Column) -> Column:
                # what AMOUNT finds is a number but for its marks
                amount = F.when(value.contains(","), F.translate(value, ",.", ".")).otherwise(value).try_cast("double")
                near = F.lower(F.substring(t, low + 1, best["at"] + F.length(value) + AROUND - low))
                score = X.let(amount, lambda a: F.when(a > 0, X.let(near, lambda n: a + adds(n))))
                return X.let(score, lambda s: F.when(s > best["score"], F.struct(after, s.alias("score"), value.alias("value"))).otherwise(F.struct(after, best["score"].alias("score"), best["value"].alias("value"))))

            return X.let(F.substring_index(piece, "\x02", 1), better)

        return F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), start, step, lambda best: best["value"])

    return X.let(whole, lambda t: X.let(F.split(F.regexp_replace(t, AMOUNT, "\x01$1\x02"), "\x01"), lambda pieces: walk(t, pieces)))


def _description(lines: Column, text: Column, low: Column) -> Column:
    """What follows a description's label; else a line of a service; else the longest line of words, the first of equals."""
    worded = lambda c: c.rlike(r"(?:\p{L}[^\p{L}]*){12}")
    said = X.clean_line(F.get(F.split(F.regexp_extract(X.clean_line(text), ABOUT, 1), ABOUT_ENDS), 0))
    after = F.when(X.has_any(low, ["referente", "descricao"]), X.let(said, lambda v: F.when(F.length(v) >= 20, v)))

    def of_service(line: Column) -> Column:
        at = F.length(F.regexp_extract(F.lower(line), f"^(.*?)(?:{SERVICES})", 1))
        return X.let(at, lambda at: X.clean_line(F.substring(line, F.greatest(F.lit(0), at - 20) + 1, at + 260 - F.greatest(F.lit(0), at - 20))))

    some = F.filter(lines, lambda x: _said(x, SERVICES))
    service = F.when(_has(low, SERVICES), _first_of(some, lambda v: (F.length(v) >= 20) & worded(v), of_service))

    def longer(best: Column, x: Column) -> Column:
        fits = (F.length(x) >= 20) & (F.length(x) > F.length(best))
        return F.when(fits, F.when(~X.heading(x) & ~x.rlike(X.CNPJ) & worded(x), x).otherwise(best)).otherwise(best)

    longest = F.aggregate(lines, F.lit(""), longer)
    own = X.let(F.coalesce(after, service, F.lit("")), lambda v: F.when(v != "", v).otherwise(longest))
    return F.rtrim(F.substring(own, 1, 420))


def _retention(lines: Column, low: Column) -> Column:
    """The first three lines that speak of retention, long ones from the word on."""
    def short(line: Column) -> Column:
        from_word = X.clean_line(F.regexp_extract(line, r"(?i)((?:n[ãa]o\s+retido|retido).{0,120})", 1))
        return F.when((F.length(line) > 240) & (from_word != ""), from_word).otherwise(line)

    found = F.transform(F.slice(F.filter(lines, lambda x: _said(x, RETENTION)), 1, 3), short)
    return F.when(_has(low, RETENTION), F.array_join(found, " | ")).otherwise("")


def noisy_fields(df: DataFrame, text_col: str = "raw_text", into: str = "noisy", entities: str | None = None, totals: str | None = None, document_info: str | None = None) -> DataFrame:
    """df with a struct `into`: value and conf of each field that can be read in a bad text.

    entities, totals and document_info name map columns of what is known anyway:
    their names, tax numbers, grand_total and number. Null text has no field.
    Lines are searched only where the text has a word of the rule, and only up
    to the first that fits.
    """
    known = lambda m, *keys: F.coalesce(*[X.blank_to_null(X.strip_space(F.col(m)[k])) for k in keys], F.lit("")) if m else F.lit("")
    rows = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).withColumns({"_lines": X.lines(F.col("_text")), "_low": F.lower("_text")})
    lines, text, low = F.col("_lines"), F.col("_text"), F.col("_low")
    # lines have one space for any white space: a tax number of the text or of some lines is one of the text with white space of any length in it
    rows = rows.withColumn("_fixed", X.ocr_digit_fix(text)).withColumn("_tax", F.col("_fixed").rlike(CNPJ.replace(r"[\./\s-]?", r"(?:[\./-]|\s*)")))
    rows = rows.withColumns({f"_{n}": F.when(F.col("_tax") & _has(low, p), _labelled_cnpj(lines, p)).otherwise("") for n, p in CNPJ_LABELS.items()})
    rows = rows.withColumn("_all", F.when(F.col("_tax"), _valid_cnpjs(F.col("_fixed"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumns({f"_near_{n}": F.when(_has(low, p), _near_name(lines, p)).otherwise("") for n, p in NAME_LABELS.items()})
    rows = rows.withColumn("_any", F.when((F.col("_near_fornecedor") == "") | (F.col("_near_tomador") == ""), _first_of(lines, X.named)).otherwise(""))
    name = lambda n: F.when(F.col(f"_near_{n}") != "", F.col(f"_near_{n}")).when(F.col("_any") != "", F.col("_any"))
    one = lambda c: F.when(F.col(c) != "", F.col(c))
    # (?i) takes letters of a-z alone, which lower() makes small
    building = F.when(low.contains("condom"), X.let(X.clean_line(F.regexp_extract(text, r"(?i)(condom[íi]nio[^,\n]{5,140})", 1)), lambda v: F.when(v != "", v)))
    second = F.when((F.col("_cnpj_tomador") == "") & (F.col("_cnpj_fornecedor") == ""), F.get("_all", 1)).otherwise(one("_cnpj_tomador"))
    second = F.coalesce(second, one("_cnpj_tomador"))
    number = F.when(low.contains("nf"), _number(lines, F.col("_fixed"))).otherwise("")
    amount, info = known(totals, "grand_total"), known(document_info, "number")
    values = {
        "fornecedor": F.coalesce(name("fornecedor"), known(entities, "fornecedor", "issuer")),
        "tomador": F.coalesce(name("tomador"), building, known(entities, "tomador", "recipient")),
        "cnpj_fornecedor": F.coalesce(one("_cnpj_fornecedor"), F.get("_all", 0), known(entities, "cnpj_fornecedor", "issuer_cnpj")),
        "cnpj_tomador": F.coalesce(second, known(entities, "cnpj_tomador", "recipient_cnpj")),
        "numero_nf": F.when(info != "", info).otherwise(number) if document_info else number, "descricao_servico": _description(lines, text, low),
        "valor_nf": F.when(amount != "", amount).otherwise(_best_amount(F.col("_fixed"))) if totals else _best_amount(F.col("_fixed")), "retencao": _retention(lines, low),
    }
    rows = rows.withColumns({f"_v_{n}": c for n, c in values.items()})
    found = {n: F.col(f"_v_{n}") != "" for n in values}
    found |= {n: found[n] & X.cnpj_valid(F.col(f"_v_{n}")) for n in ("cnpj_fornecedor", "cnpj_tomador")}
    found |= {"descricao_servico": F.length("_v_descricao_servico") > 10, "valor_nf": found["valor_nf"] & F.coalesce(X.currency_loose(F.col("_v_valor_nf")) != 0, F.lit(False))}
    parts = [F.struct(F.col(f"_v_{n}").alias("value"), F.when(found[n], SURE[n]).otherwise(0.0).alias("conf")).alias(n) for n in values]
    own = ["_text", "_lines", "_low", "_fixed", "_tax", "_all", "_any", *[f"_{n}" for n in CNPJ_LABELS], *[f"_near_{n}" for n in NAME_LABELS], *[f"_v_{n}" for n in values]]
    return rows.withColumn(into, F.struct(*parts)).drop(*own)


def enrich(df: DataFrame, fields: list[str], classification: str, engine: str, text_col: str = "raw_text") -> DataFrame:
    """df whose struct columns `fields` (value, conf) take what noisy_fields reads, where the text is badly read and theirs is worse.

    Worse is: empty, a heading, a tax number whose check digits fail (for one
    whose hold), a retention of over 240 characters, a description of few
    letters, a lower amount. The confidence is the higher one.
    """
    rows = noisy_fields(df, text_col, "_noisy").withColumn("_bad", is_noisy(F.col(classification), F.col(engine)))
    for n in fields:
        own, other = X.strip_space(F.coalesce(F.col(f"{n}.value"), F.lit(""))), F.col(f"_noisy.{n}.value")
        there = other != ""
        amount, other_amount = X.currency_loose(own), X.currency_loose(other)
        take = F.when((own == "") | X.is_header_like(own), there)
        if n.startswith("cnpj"):
            take = take.when(~X.cnpj_valid(own), there & X.cnpj_valid(other))
        elif n == "retencao":
            take = take.when(F.length(own) > 240, there)
        elif n == "descricao_servico":
            take = take.when(X.is_low_quality_text(own), there)
        elif n == "valor_nf":
            take = take.otherwise(other_amount.isNotNull() & (amount.isNull() | (other_amount > amount)))
        take = F.col("_bad") & F.coalesce(take, F.lit(False))
        new = F.struct(other.alias("value"), F.greatest(F.coalesce(F.col(f"{n}.conf"), F.lit(0.0)), F.col(f"_noisy.{n}.conf")).alias("conf"))
        rows = rows.withColumn(n, F.when(take, new).otherwise(F.col(n)))
    return rows.drop("_noisy", "_bad")
