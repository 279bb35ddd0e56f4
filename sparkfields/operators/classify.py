"""Rules that name a document's layout, schema, class and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

# Weights of the words of each layout, in the order in which ties are decided.
LAYOUTS: dict[str, list[tuple[str, float]]] = {
    "nota_fiscal": [
        ("nota fiscal", 0.30), ("nf-e", 0.20), ("nfs-e", 0.20), ("nfe", 0.10), ("chave de acesso", 0.15), ("icms", 0.10), ("valor total", 0.10), ("tomador", 0.10),
        ("fornecedor", 0.10), ("prestador de servi", 0.10), ("secretaria municipal", 0.10),
    ],
    "boleto_caixa": [("caixa economica federal", 0.35), ("104", 0.15), ("linha digitavel", 0.2), ("cedente", 0.1), ("boleto", 0.1), ("vencimento", 0.1)],
    "boleto_bb": [("banco do brasil", 0.35), ("001", 0.15), ("linha digitavel", 0.2), ("cedente", 0.1), ("boleto", 0.1), ("vencimento", 0.1)],
    "boleto_bradesco": [("bradesco", 0.35), ("237", 0.15), ("linha digitavel", 0.2), ("beneficiario", 0.1), ("boleto", 0.1), ("vencimento", 0.1)],
    "fatura_energia": [("energia eletrica", 0.25), ("kwh", 0.2), ("unidade consumidora", 0.2), ("consumo", 0.15), ("distribuidora", 0.1), ("vencimento", 0.1)],
    "fatura_condominio": [("condominio", 0.3), ("unidade", 0.15), ("rateio", 0.15), ("assembleia", 0.1), ("sindico", 0.1), ("vencimento", 0.1), ("boleto", 0.1)],
}
ACCESS_KEY, ACCESS_KEY_WEIGHT = r"\b\d{44}\b", 0.25
LEAST, GENERIC, REVIEW = 0.45, 0.35, 0.7

# Words of each schema, how many make it likely, and patterns that count for more.
NF_WORDS = ["nota fiscal", "nf-e", "nfe", "chave de acesso", "icms", "ipi", "pis", "cofins", "iss", "tomador", "fornecedor", "descricao", "quantidade", "valor unitario", "valor total", "produtos", "servicos"]
WATER_WORDS = ["fatura", "água", "agua", "esgoto", "consumo", "matrícula", "matricula", "hidrômetro", "hidrometro", "tarifa", "concessionaria", "compesa", "sabesp", "cedae", "embasa", "copasa", "sanepar", "cagece", "leitura", "economia"]
BOLETO_WORDS = ["boleto", "linha digitavel", "beneficiario", "pagador", "vencimento", "nosso numero", "valor"]
LINHA = r"\b\d{5}\.?\d{5}\s+\d{5}\.?\d{6}\s+\d{5}\.?\d{6}\s+\d\s+\d{14}\b"

# Engines by document class, and the names they are also known by.
ENGINE_OF_CLASS = {"digital_pdf": "docling", "scanned_image": "openrouter", "handwritten_complex": "openrouter"}
ENGINE_ALIASES = {"paddleocr": "paddle", "paddle_ocr": "paddle", "llama-parse": "llamaparse", "deepseek-ocr": "deepseek", "hybrid": "paddle_easyocr", "paddle_deepseek": "paddle_easyocr"}
FALLBACK_OF_CLASS = {"digital_pdf": "llamaparse", "scanned_image": "easyocr", "handwritten_complex": "easyocr"}
FALLBACK_ALTERNATIVE = {"llamaparse": "docling", "easyocr": "tesseract"}


def _weight(text: Column, words: list[tuple[str, float]]) -> Column:
    total = F.lit(0.0)
    for word, w in words:
        total = total + F.when(F.contains(text, F.lit(word)), w).otherwise(0.0)
    return total


def layout_classify(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """df with layout, confidence, requires_human_validation.

    The layout with most weight wins, ties go to the first; under LEAST it is
    generic with a fixed confidence, 0 for empty text. Review is decided on the
    confidence before rounding.
    """
    low = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+", " "))
    scored = []
    for k, (name, words) in enumerate(LAYOUTS.items()):
        score = _weight(F.col("_low"), words)
        if name == "nota_fiscal":
            score = F.least(F.lit(0.99), score + F.when(F.col("_low").rlike(ACCESS_KEY), ACCESS_KEY_WEIGHT).otherwise(0.0))
        scored.append(F.struct(score.alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name")))
    rows = df.withColumn("_low", low).withColumn("_best", F.array_max(F.array(*scored)))
    generic = F.col("_best.score") < LEAST
    raw = F.when(generic, F.when(F.col("_low") == "", 0.0).otherwise(GENERIC)).otherwise(F.least(F.lit(0.99), F.col("_best.score")))
    rows = rows.withColumn("layout", F.when(generic, "generic").otherwise(F.col("_best.name"))).withColumn("_raw", raw)
    return rows.withColumn("confidence", F.round("_raw", 2)).withColumn("requires_human_validation", F.col("_raw") < REVIEW).drop("_low", "_best", "_raw")


def schema_classify(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """df with schema_id: invoice, else water bill, else payment slip, else null."""
    rows, low = df.withColumn("_low", F.lower(F.coalesce(F.col(text_col), F.lit("")))), F.col("_low")
    key = F.when(low.rlike(ACCESS_KEY), 1).otherwise(0)
    count = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    slip = count(BOLETO_WORDS) + F.when(low.rlike(LINHA), 3).otherwise(0) + key * 2
    scores = F.array(count(NF_WORDS) + key * 3, count(WATER_WORDS), slip)
    schema = X.let(scores, lambda s: F.when(s[0] >= 4, "nota_fiscal_default").when(s[1] >= 3, "conta_agua_default").when(s[2] >= 4, "boleto_default"))
    return rows.withColumn("schema_id", schema).drop("_low")


def _mapped(c: Column, table: dict[str, str], other: Column) -> Column:
    out = other
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def engine_name(c: Column) -> Column:
    """Trimmed lower-case name under which an engine is known; null and none are null."""
    name = F.lower(X.strip_space(c))
    return F.when(name.isin("", "none", "null"), None).otherwise(_mapped(name, ENGINE_ALIASES, name))


def resolve_engine(df: DataFrame, selected: str = "selected_engine", document_class: str = "document_class") -> DataFrame:
    """df with engine: the selected one, else that of the class, else tesseract."""
    return df.withColumn("engine", F.coalesce(engine_name(F.col(selected)), _mapped(F.lower(X.strip_space(F.col(document_class))), ENGINE_OF_CLASS, F.lit("tesseract"))))


def fallback_engine(df: DataFrame, primary: str = "engine", document_class: str = "document_class") -> DataFrame:
    """df with fallback: the class's second engine, or its alternative where that is the first engine."""
    preferred = _mapped(F.lower(F.col(document_class)), FALLBACK_OF_CLASS, F.lit("tesseract"))
    same = preferred == F.coalesce(engine_name(F.col(primary)), F.lit(""))
    return df.withColumn("fallback", F.when(same, _mapped(preferred, FALLBACK_ALTERNATIVE, preferred)).otherwise(preferred))


# Words in file names that tell how a document came about.
NAME_SIGNALS = {
    "handwritten": ["manuscrito", "handwritten", "assinatura", "signature", "anotacao", "anotação"], "scanned": ["scan", "scanned", "digitalizado", "foto", "image", "camera", "print"],
    "table": ["tabela", "table", "invoice", "fatura", "nota", "extrato", "statement"], "mixed": ["misto", "mixed", "hibrido", "híbrido", "completo", "complex"],
}


def route_by_features(df: DataFrame) -> DataFrame:
    """df with document_class from page features and the words of the file name.

    Needs filename, ext, nr_pages, txtblocks, imgblocks, text_chars, table_score,
    handwriting_score, image_like_ratio; the first rule that holds decides.
    """
    name = F.lower(F.coalesce(F.col("filename"), F.lit("")))
    said = {k: name.rlike("|".join(words)) for k, words in NAME_SIGNALS.items()}
    hand_name, scan_name, mixed = said["handwritten"], said["scanned"], said["mixed"]
    only_hand = hand_name & ~scan_name
    c = {k: F.coalesce(F.col(k), F.lit(0)) for k in ("txtblocks", "imgblocks", "text_chars", "nr_pages", "table_score", "handwriting_score", "image_like_ratio")}
    hw, chars, grid, ratio = c["handwriting_score"], c["text_chars"], c["table_score"], c["image_like_ratio"]
    digital, scanned, hand = F.lit("digital_pdf"), F.lit("scanned_image"), F.lit("handwritten_complex")
    pdf = (
        F.when((c["txtblocks"] > 0) & (c["txtblocks"] >= c["imgblocks"]) & ~only_hand, digital).when(c["nr_pages"] == 0, scanned)
        .when((chars >= 800) & (ratio <= 0.25) & ((grid >= 0.015) | said["table"]) & ~hand_name, digital).when(only_hand | ((hw >= 0.68) & (chars < 900)), hand)
        .when((chars >= 60) & (grid >= 0.030) & (hw < 0.62), digital).when((chars >= 120) & (hw < 0.58), digital)
        .when(scan_name & (chars < 80), F.when(mixed | (hw >= 0.38), hand).otherwise(scanned))
        .when((chars < 40) & (ratio >= 0.5), F.when(mixed | (hw >= 0.62), hand).otherwise(scanned)).when((mixed & (hw >= 0.56)) | (hw >= 0.62), hand).otherwise(digital)
    )
    image = F.when(only_hand, hand).when(mixed & (hw >= 0.40), hand).when(hw >= 0.60, hand).otherwise(scanned)
    ext = F.lower(F.coalesce(F.col("ext"), F.lit("")))
    return df.withColumn("document_class", F.when(ext == "pdf", pdf).when(ext.isin("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"), image).otherwise(scanned))


def image_type_label(words: DataFrame) -> DataFrame:
    """(doc_id, label): typed, handwritten or hybrid, by the mean confidence and word count of the engines typed and handwritten."""
    engines = ("typed", "handwritten")
    by = words.groupBy("doc_id").agg(
        *[F.coalesce(F.avg(F.when(F.col("engine") == e, F.col("conf"))), F.lit(0.0)).alias(f"{e}_conf") for e in engines], *[F.count_if(F.col("engine") == e).alias(f"{e}_words") for e in engines]
    )
    t, e, tn, en = F.col("typed_conf"), F.col("handwritten_conf"), F.col("typed_words"), F.col("handwritten_words")
    label = F.when((t >= 0.55) & (tn >= 8) & (t - e >= 0.15), "typed").when((e >= 0.45) & (en >= 5) & (e - t >= 0.10), "handwritten")
    return by.select("doc_id", label.when((tn == 0) & (en > 0), "handwritten").when((en == 0) & (tn > 0), "typed").otherwise("hybrid").alias("label"))
