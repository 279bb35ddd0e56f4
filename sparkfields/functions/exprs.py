"""Column expressions for text, numbers, Brazilian tax numbers and money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of headings that are never field values, and words of headings.
HEADER_PATTERNS = [
    r"^tomador\s+do\s+servi[çc]o", r"^emitente\s+da\s+nfs-?e", r"^prestador\s+do\s+servi[çc]o", r"^cnpj\s*/\s*cpf\s*/\s*nif$", r"^nome\s*/\s*nome\s*empresarial$",
    r"^descri[çc][aã]o\s+do\s+servi[çc]o$", r"^valor\s+do\s+servi[çc]o$", r"^valor\s+total\s+da\s+nfs-?e$", r"^inscri[çc][aã]o\s+municipal$", r"^telefone$",
    r"^e-?mail$", r"^endere[çc]o$", r"^munic[íi]pio$", r"^cep$",
]
HEADER_TOKENS = ["serviço", "servico", "cnpj", "cpf", "nif", "emissão", "tributação", "municipal"]
COMPANY_TOKENS = ["condominio", "edificio", "associados", "advogados", "ltda", "s/a", "me", "epp", "empresa", "comercio", "servicos"]
CNPJ = r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}|\d{14}"
FORMATTED_CNPJ = r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}"
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
LETTER = "A-Za-zÀ-ÿ"
#: The letters of LETTER.
LETTERS = "".join(chr(c) for a, b in ("AZ", "az", "Àÿ") for c in range(ord(a), ord(b) + 1))
#: Letters that a (?iu) pattern takes for s, i and k, and lower() does not.
ODD_CASE = "[\u017f\u0131\u0130\u212a]"


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_line(c: Column) -> Column:
    """White space runs as one space, none at the ends; null as empty."""
    # a single space stays as it is: it need not be found and replaced
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\n\x0B\f\r]\s*| \s+", " "))


def lines(c: Column) -> Column:
    """Cleaned lines without the blank ones."""
    text = F.coalesce(c, F.lit(""))
    # most texts are clean, which one search tells for all lines
    rough = text.rlike(r"[\t\x0B\f\r]| [ \n]|\n |^ | $")
    cleaned = F.filter(F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("\n")), "\n"), clean_line), lambda x: x != "")
    return F.when(rough, cleaned).otherwise(F.array_remove(F.split(text, "\n"), ""))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]+", "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _check_digit(n: Column, weights: list[int]) -> Column:
    """11 less the rest of 11 of the weighted sum of the first digits of a number of 14; 0 for 10 and 11."""
    total = F.lit(0).cast("long")
    for k, w in enumerate(weights):
        total = total + F.call_function("div", n, F.lit(10 ** (13 - k))) % 10 * w
    return (F.lit(11) - total % 11) % 11 % 10


def cnpj_valid(c: Column) -> Column:
    """Whether the digits of c are 14, not all alike, and end in their two check digits."""

    def right(n: Column) -> Column:
        ends = _check_digit(n, [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]) * 10 + _check_digit(n, [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])
        return F.coalesce((n % 11111111111111 != 0) & (n % 100 == ends), F.lit(False))

    return let(digits(c), lambda d: (F.length(d) == 14) & let(d.try_cast("bigint"), right))


def cnpj_format(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 14, F.regexp_replace(d, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")).otherwise(c)


def _plain_number(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), c.try_cast("double"))


def currency_loose(c: Column) -> Column:
    """1.234,56 or 1234.56, with or without R$; null if it isn't a number."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)R\$|\s", "")
    both = t.contains(",") & t.contains(".")
    return _plain_number(F.when(both, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("."))))


def currency_strict(c: Column) -> Column:
    """As currency_loose, but dots are thousands wherever there is a comma, and only positive values count."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)R\$|\s", "")
    v = _plain_number(F.when(t.contains(","), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(t))
    return F.when(v > 0, v)


def is_date_text(c: Column) -> Column:
    return F.coalesce(strip_space(c).rlike(r"^\d{2}/\d{2}/(\d{4}|\d{2})$"), F.lit(False))


def without_accents(c: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), *ACCENTS)


def snake_key(c: Column) -> Column:
    """A name of a-z, 0-9 and _ of at most 64 characters; campo_ before a leading digit."""
    k = F.regexp_replace(F.regexp_replace(without_accents(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.substring(F.when(k.rlike(r"^[0-9]"), F.concat(F.lit("campo_"), k)).otherwise(k), 1, 64)


def search_norm(c: Column) -> Column:
    return clean_line(without_accents(c))


def count_of(values: list[str], text: Column) -> Column:
    """How many of the values the text contains."""
    return F.size(F.filter(F.array(*[F.lit(v) for v in values]), lambda v: F.contains(text, v)))


def has_any(text: Column, words: list[str]) -> Column:
    """Whether the text contains one of the words."""
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def _number_of(words: list[str], text: Column) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


def heading(line: Column) -> Column:
    """is_header_like for a cleaned line."""

    def test(low: Column) -> Column:
        hit = low.rlike(f"^(?:{'|'.join(p.removeprefix('^') for p in HEADER_PATTERNS)})")
        return hit | ((_number_of(HEADER_TOKENS, low) >= 2) & (F.size(F.split(low, " ")) <= 6) & ~line.rlike(FORMATTED_CNPJ))

    return (line == "") | let(F.lower(line), test)


def is_header_like(c: Column) -> Column:
    """Blank, a heading, or a short line of heading words without a tax number."""
    return let(clean_line(c), heading)


def named(line: Column) -> Column:
    """is_name_line for a cleaned line."""
    # characters are left out one by one: a pattern costs several times as much
    letters = F.length(line) - F.length(F.translate(line, LETTERS, ""))
    numbers = F.length(line) - F.length(F.translate(line, "0123456789", ""))
    many = let(letters, lambda n: (n >= 6) & let(numbers, lambda m: (n > m) & ((m < 14) | ~line.rlike(CNPJ))))
    return many & ~heading(line)


def is_name_line(c: Column) -> Column:
    """A line that may be the name of a party."""
    return let(clean_line(c), named)


def name_score(c: Column) -> Column:
    """How much a line looks like the name of a party, from 0 to 1."""
    return let(clean_line(c), line_score)


def line_score(line: Column) -> Column:
    """name_score for a cleaned line."""
    return F.when(named(line), named_score(line)).otherwise(0.0)


def named_score(line: Column) -> Column:
    """name_score for a cleaned line that may be a name."""
    upper = F.length(F.regexp_replace(line, r"[^A-ZÀ-Ý]+", "")) / F.greatest(F.lit(1), F.length(F.regexp_replace(line, f"[^{LETTER}]+", "")))
    total = (
        F.when(F.contains(line, F.lit(" ")), 0.20).otherwise(0.0) + F.when(F.length(line) >= 18, 0.15).otherwise(0.0)
        + F.when(upper >= 0.70, 0.25).otherwise(0.0) + F.when(let(F.lower(line), lambda low: has_any(low, COMPANY_TOKENS)), 0.35).otherwise(0.0)
    )
    return F.least(F.lit(1.0), total)


def ocr_digit_fix(c: Column) -> Column:
    return F.translate(c, "OoIlSsBQ", "00115580")


def is_low_quality_text(c: Column) -> Column:
    # the text is searched once: what is left of it has digits alone besides letters
    def weak(known: Column) -> Column:
        return let(F.length(F.translate(known, "0123456789", "")), lambda n: (n < 10) | (n / F.greatest(F.lit(1), F.length(known)) < 0.45))

    return let(F.regexp_replace(F.coalesce(c, F.lit("")), f"[^{LETTER}0-9]+", ""), weak)


def avg_confidence(*candidates: Column) -> Column:
    """The first number, as a percentage from 0 to 100."""
    v = F.coalesce(*[c.try_cast("double") for c in candidates])
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.when((v >= 0) & (v <= 1), v * 100).otherwise(v)))


def confidence_ratio(c: Column) -> Column:
    v = F.coalesce(c.try_cast("double"), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(v > 1, v / 100).otherwise(v)))


def sender_address(c: Column) -> Column:
    found = F.regexp_extract(c, r"<([^>]*)>", 1)
    return F.when(found != "", strip_space(found)).otherwise(strip_space(c))


def disposition_filename(c: Column) -> Column:
    """File name of a content-disposition header: filename*=charset'lang'name, else filename=."""
    star = F.regexp_extract(c, r"(?i)filename\*\s*=\s*[^']*'[^']*'([^;]+)", 1)
    plain = F.regexp_extract(c, r"(?i)filename\s*=\s*\"?([^\";]+)\"?", 1)
    return F.when(star != "", F.try_url_decode(strip_space(star))).when(plain != "", strip_space(plain))


def object_key(tenant: Column, document: Column) -> Column:
    return F.format_string("documents/%s/%s/original", tenant, document)


def object_uri(key: Column) -> Column:
    return F.concat(F.lit("local://"), key)


def numeric_token_fix(c: Column) -> Column:
    """Letters read for digits, in tokens that otherwise look like numbers."""
    looks = lambda t: (F.length(t) >= 2) & t.rlike(r"[0-9]") & t.rlike(r"^[0-9/.,\-OoIlSBZ]+$")
    return F.array_join(F.transform(F.split(c, " "), lambda t: F.when(looks(t), F.translate(t, "OoIlSBZ", "0011582")).otherwise(t)), " ")


def is_blank(c: Column) -> Column:
    """Whether clean_line leaves nothing; the search ends at the first other character."""
    return ~F.coalesce(c, F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")


def blank_to_null(c: Column) -> Column:
    return F.when(strip_space(c) != "", c)
