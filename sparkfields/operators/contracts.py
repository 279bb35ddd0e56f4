"""Event contracts: a table of fields that one expression walks over the parsed event."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Field(NamedTuple):
    """A field of an event; `least` and `most` bound a number's value or a string's length, `choices` are all that a string may be."""

    path: str
    kind: str
    required: bool = True
    nullable: bool = False
    least: float | None = None
    most: float | None = None
    choices: tuple[str, ...] = ()


# The fields of all events, and those of each type's data. Kinds: uuid, string, int, float, bool, time, zoned (a time with its zone), object (of the fields named below it), map, strings (a map of strings).
BASE = (
    Field("event_id", "uuid", required=False), Field("event_type", "string", required=False), Field("event_version", "string", required=False, choices=("v1",)), Field("occurred_at", "zoned", required=False), Field("tenant_id", "string", least=1),
    Field("document_id", "uuid"), Field("correlation_id", "uuid", required=False), Field("source", "string", least=1), Field("data", "object"),
)
DATA: dict[str, tuple[Field, ...]] = {
    "document.received": (
        Field("data.channel", "string", choices=("manual", "email", "whatsapp")), Field("data.file", "object"), Field("data.file.uri", "string", least=1), Field("data.file.content_type", "string", least=1), Field("data.file.filename", "string", least=1),
        Field("data.file.size_bytes", "int", least=0), Field("data.file.sha256", "string", required=False, nullable=True, least=64, most=64), Field("data.received_at", "time"), Field("data.sender", "string", required=False, nullable=True), Field("data.metadata", "map", required=False),
    ),
    "ocr.completed": (
        Field("data.raw_text_uri", "string", least=1), Field("data.raw_text_preview", "string", required=False), Field("data.document_type", "string", choices=("digital_pdf", "scanned_image", "handwritten_complex", "unknown")), Field("data.engine_used", "string", least=1),
        Field("data.confidence", "float", required=False, nullable=True, least=0, most=1), Field("data.processing_time_seconds", "float", least=0), Field("data.artifacts", "strings", required=False), Field("data.metadata", "map", required=False),
    ),
    "ocr.failed": (Field("data.reason", "string", least=1), Field("data.retryable", "bool", required=False), Field("data.engine_used", "string", required=False, nullable=True), Field("data.metadata", "map", required=False)),
    "layout.classified": (
        Field("data.layout", "string", least=1), Field("data.confidence", "float", least=0, most=1), Field("data.document_type", "string", least=1), Field("data.requires_human_validation", "bool", required=False), Field("data.metadata", "map", required=False),
    ),
    "extraction.completed": (
        Field("data.schema_id", "string", least=1), Field("data.schema_version", "string", least=1), Field("data.fields", "map"), Field("data.confidence", "float", least=0, most=1), Field("data.requires_human_validation", "bool"), Field("data.metadata", "map", required=False),
    ),
    "erp.integration.requested": (Field("data.connector", "string", least=1), Field("data.payload", "map"), Field("data.idempotency_key", "string", least=1), Field("data.metadata", "map", required=False)),
    "erp.sent": (Field("data.connector", "string", least=1), Field("data.external_id", "string", required=False, nullable=True), Field("data.idempotency_key", "string", least=1), Field("data.response_metadata", "map", required=False)),
    "erp.failed": (Field("data.connector", "string", least=1), Field("data.reason", "string", least=1), Field("data.retryable", "bool"), Field("data.idempotency_key", "string", least=1), Field("data.response_metadata", "map", required=False)),
}

# What counts as a boolean, a UUID, a time, and a zone at a time's end.
TRUTHS = ("0", "1", "f", "false", "n", "no", "off", "on", "t", "true", "y", "yes")
UUID = r"^(urn:uuid:)?[{]?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}[}]?$"
TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
ZONE = r"[T ].*(Z|[+-]\d{2}:?\d{2})$"


def _looked(event: Column, parent: str) -> Column:
    """A map of an object's keys to what its values are: JSON kind, text of a string or number, and whether it is a map of strings."""

    def seen(_: Column, value: Column) -> Column:
        json = F.schema_of_variant(value)
        strings = F.forall(F.map_values(F.try_variant_get(value, "$", "map<string,variant>")), lambda v: F.schema_of_variant(v) == "STRING")
        return F.struct(json.alias("json"), F.try_variant_get(value, "$", "string").alias("text"), F.when(json.startswith("OBJECT"), strings).alias("strings"))

    return F.transform_values(F.try_variant_get(event, f"$.{parent}" if parent else "$", "map<string,variant>"), seen)


_ROWS = (
    "event_type string, fields array<struct<parent:string,name:string,path:string,kind:string,required:boolean,nullable:boolean,least:double,most:double,choices:array<string>>>, "
    "objects array<struct<path:string,named:array<string>>>"
)


def contract_rows(spark: SparkSession, types: dict[str, tuple[Field, ...]]) -> DataFrame:
    """A row for each type: its fields in order, and the names in each of its objects."""
    rows = []
    for kind, fields in types.items():
        parents = ["", *(f.path for f in fields if f.kind == "object")]
        split = [(*f.path.rpartition(".")[::2], f) for f in fields]
        rows.append((kind, [(parent, name, *f[:4], *(None if x is None else float(x) for x in (f.least, f.most)), list(f.choices)) for parent, name, f in split], [(p, [n for parent, n, _ in split if parent == p]) for p in parents]))
    return spark.createDataFrame(rows, _ROWS)


def _broken(field: Column, value: Column, there: Column) -> Column:
    """The rule that a value breaks, else null; `there`: whether the object that should hold it is there."""
    json, text, kind = value["json"], value["text"], field["kind"]
    is_text, is_number, is_object = json == "STRING", json.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), json.startswith("OBJECT")
    number = F.when(is_text | is_number, F.trim(text).try_cast("double"))
    fits = (
        F.when(kind == "string", is_text).when(kind == "uuid", is_text & text.rlike(UUID)).when(kind == "int", number == F.floor(number)).when(kind == "float", number.isNotNull())
        .when(kind == "bool", (json == "BOOLEAN") | ((is_text | is_number) & F.lower(text).isin(*TRUTHS))).when(kind.isin("object", "map"), is_object).when(kind == "strings", value["strings"])
        .otherwise(is_number | (is_text & text.rlike(TIME) & text.try_cast("timestamp").isNotNull()))
    )
    size = F.when(kind == "string", F.length(text)).otherwise(number)
    says = lambda *what: F.concat(field["path"], F.lit(": "), *[F.lit(w) if isinstance(w, str) else w for w in what])
    bound = lambda c: c.cast("bigint").cast("string")
    return (
        F.when(value.isNull(), F.when(field["required"] & there, says("missing"))).when(json == "VOID", F.when(~field["nullable"], says("null")))
        .when(~F.coalesce(fits, F.lit(False)), says("not ", F.replace(kind, F.lit("zoned"), F.lit("time")))).when((kind == "zoned") & is_text & ~text.rlike(ZONE), says("no zone"))
        .when((F.size(field["choices"]) > 0) & ~F.array_contains(field["choices"], text), says("not a choice"))
        .when(size < field["least"], says("below ", bound(field["least"]))).when(size > field["most"], says("above ", bound(field["most"])))
    )


def check_events(df: DataFrame, payload: str = "payload", into: str = "error", contract: dict[str, tuple[Field, ...]] | None = None) -> DataFrame:
    """df with `into`: the first rule of its type's contract that a JSON event breaks, else null.

    Fields come in their order: one that is missing, null, of another kind or out
    of its bounds; after all fields, keys that an object doesn't name. Each event
    is parsed once and each of its objects looked at once; the contracts, a row
    for each type, are sent to the tasks, and one expression walks the fields of
    the event's type. Null and broken JSON is "not an object"; an unknown or
    missing type is an error of its own. Numbers in strings are numbers, as are
    whole floats whole numbers. A column `into` of df is replaced.
    """
    types = contract or {t: BASE + fields for t, fields in DATA.items()}
    parents = sorted({"", *(f.path for fields in types.values() for f in fields if f.kind == "object")})
    held = contract_rows(df.sparkSession, types).withColumnsRenamed({"event_type": "_type", "fields": "_fields", "objects": "_objects"})
    rows = df.drop(into).withColumn("_event", F.try_parse_json(F.col(payload)))
    rows = rows.withColumn("_looked", F.create_map(*[x for p in parents for x in (F.lit(p), _looked(F.col("_event"), p))])).drop("_event")
    at = lambda parent, name: F.try_element_at(F.try_element_at("_looked", parent), name)
    rows = rows.withColumn("_kind", at(F.lit(""), F.lit("event_type"))["text"])
    rows = rows.join(F.broadcast(held), F.col("_kind") == F.col("_type"), "left")
    found = F.transform("_fields", lambda f: F.struct(f.alias("f"), at(f["parent"], f["name"]).alias("v"), F.try_element_at("_looked", f["parent"]).isNotNull().alias("there")))
    values = F.transform(found, lambda x: _broken(x["f"], x["v"], x["there"]))
    known = lambda o: F.size(F.array_except(F.map_keys(F.try_element_at("_looked", o["path"])), o["named"]))
    unknown = F.transform("_objects", lambda o: F.when(known(o) > 0, F.concat(F.coalesce(F.nullif(o["path"], F.lit("")), F.lit("event")), F.lit(": unknown key"))))
    error = F.get(F.filter(F.concat(values, unknown), lambda e: e.isNotNull()), 0)
    whole = F.try_element_at("_looked", F.lit(""))
    rows = rows.withColumn(into, F.when(whole.isNull(), "not an object").when(F.col("_type").isNull(), "unknown event type").otherwise(error))
    return rows.drop("_looked", "_kind", "_type", "_fields", "_objects")
