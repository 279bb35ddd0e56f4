"""Field versions: numbering, edits with conflicts, history and differences. Versions are long: document_id, version_number, name, value, confidence, is_active."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def next_version(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """(document_id, active_version, next_number, source_type) for each document."""
    v = versions.groupBy(F.col("document_id").alias("v_id")).agg(F.max("version_number").alias("top"), F.max(F.when(F.col("is_active"), F.col("version_number"))).alias("active_version"))
    rows = docs.select(F.col("id").alias("document_id")).join(v, F.col("document_id") == F.col("v_id"), "left")
    return rows.select("document_id", "active_version", (F.coalesce("top", F.lit(0)) + 1).alias("next_number"), F.when(F.col("top").isNull(), "INITIAL_EXTRACTION").otherwise("REPROCESSING").alias("source_type"))


def _current(versions: DataFrame) -> DataFrame:
    """(document_id, top, active, held): of each document the last version, the last active one, and the rows of those that aren't inactive, found in one grouping."""
    held = F.collect_list(F.when(F.coalesce("is_active", F.lit(True)), F.struct(*versions.columns)))
    return versions.groupBy("document_id").agg(F.max("version_number").alias("top"), F.max(F.when(F.col("is_active"), F.col("version_number"))).alias("active"), held.alias("held"))


def _is_active(row: Column) -> Column:
    """Whether a row of held is one of the active version."""
    return F.coalesce(row["is_active"] & (row["version_number"] == F.col("active")), F.lit(False))


def apply_manual_edits(versions: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (document_id, edit_no, base_version, fields: array of name, value) with outcome, new_version, fields and confidence.

    Of several edits of a document in one batch the first that is good makes the
    new version; later ones meet it as a conflict. Names are trimmed, blank ones
    dropped, the last of equal names counts. Unchanged fields keep their
    confidence, others have 1.
    """
    return _outcomes(_tried(versions, edits, "left"))


def _tried(versions: DataFrame, edits: DataFrame, how: str) -> DataFrame:
    """Edits beside what their documents hold; how is left, or full to keep documents without edits (is_edit is null)."""
    trimmed = F.filter(F.transform("fields", lambda e: F.struct(X.strip_space(e["name"]).alias("name"), e["value"].alias("value"))), lambda e: F.coalesce(e["name"] != "", F.lit(False)))
    entries = F.array_sort(F.transform(F.filter("held", _is_active), lambda h: F.struct(h["name"].alias("name"), F.struct(h["value"].alias("value"), h["confidence"].alias("confidence")).alias("entry"))))
    current = _current(versions).select(F.col("document_id").alias("c_id"), "top", "active", "held", F.when(F.col("active").isNotNull(), F.map_from_entries(entries)).alias("old"))
    rows = edits.select("document_id", "edit_no", "base_version", trimmed.alias("new"), F.lit(True).alias("is_edit")).join(current, F.col("document_id") == F.col("c_id"), how)
    # of equal names the last, in order of name and place
    ordered = F.array_sort(F.transform("new", lambda e, i: F.struct(e["name"].alias("name"), i.alias("i"), e["value"].alias("value"))))
    last = X.let(ordered, lambda o: F.filter(o, lambda e, i: ~F.coalesce(F.get(o, i + 1)["name"] == e["name"], F.lit(False))))
    rows = rows.withColumn("new", F.map_from_entries(F.transform(last, lambda e: F.struct(e["name"].alias("key"), e["value"].alias("value"))))).withColumn("was", F.transform_values(F.coalesce("old", F.create_map().cast("map<string,struct<value:string,confidence:double>>")), lambda k, v: v["value"]))
    same = F.array_sort(F.map_entries("new")) == F.array_sort(F.map_entries("was"))
    first = F.when(F.col("active").isNull() | (F.col("base_version") != F.col("active")), "conflict").when(F.size("new") == 0, "empty").when(same, "no_changes").otherwise("saved")
    rows = rows.withColumn("document_id", F.coalesce("document_id", "c_id")).withColumn("outcome", F.when(F.col("is_edit"), first))
    by = Window.partitionBy("document_id").orderBy("edit_no")
    rows = rows.withColumns({"earlier": F.max(F.when(F.col("outcome") == "saved", F.col("active"))).over(by.rowsBetween(Window.unboundedPreceding, -1)), "place": F.row_number().over(by)})
    rows = rows.withColumn("outcome", F.when(F.col("is_edit") & F.col("earlier").isNotNull(), "conflict").otherwise(F.col("outcome"))).withColumn("saved", F.coalesce(F.col("outcome") == "saved", F.lit(False)))
    kept = F.transform_values("new", lambda k, v: F.struct(v.alias("value"), F.when(F.try_element_at("was", k).eqNullSafe(v), F.try_element_at("old", k)["confidence"]).otherwise(F.lit(1.0)).alias("confidence")))
    return rows.withColumn("kept", F.when(F.col("saved"), kept))


def _outcomes(tried: DataFrame) -> DataFrame:
    mean = F.aggregate(F.map_values("kept"), F.lit(0.0), lambda a, e: a + F.coalesce(e["confidence"], F.lit(0.0))) / F.greatest(F.lit(1), F.size("kept"))
    return tried.where("is_edit").select("document_id", "edit_no", "outcome", "active", F.when(F.col("saved"), F.col("top") + 1).alias("new_version"), F.col("kept").alias("fields"), F.when(F.col("saved"), F.round(mean, 4)).alias("confidence"))


def save_edits(versions: DataFrame, edits: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What saving edits leaves: all versions, results in step with them, and the edits that were refused.

    The versions have previous_version and source_type, null for those that were
    there; the old active one of an edited document isn't active any more. A
    result takes the fields and the confidence of its new version; nothing else
    of it changes. Documents are met with their edits once: what they hold comes
    out beside the new versions, inactive versions go by.
    """
    tried = _tried(versions, edits, "full").withColumn("edited", F.max("saved").over(Window.partitionBy("document_id")))
    held = {c: lambda h, c=c: h[c] for c in versions.columns} | {"is_active": lambda h: h["is_active"] & ~F.col("edited")}
    made = {"document_id": lambda e: F.col("document_id"), "version_number": lambda e: F.col("top") + 1, "name": lambda e: e["key"], "value": lambda e: e["value"]["value"], "confidence": lambda e: e["value"]["confidence"], "is_active": lambda e: F.lit(True)}
    kinds = {f.name: f.dataType for f in versions.schema.fields}

    def row(of, e, previous, source):
        cells = [(of[c](e) if c in of else F.lit(None)).cast(kinds[c]).alias(c) for c in versions.columns]
        return F.struct(*cells, previous.cast("int").alias("previous_version"), source.cast("string").alias("source_type"))

    stay = F.when(F.col("place") == 1, F.transform("held", lambda h: row(held, h, F.lit(None), F.lit(None))))
    new = F.when(F.col("saved"), F.transform(F.map_entries("kept"), lambda e: row(made, e, F.col("active"), F.lit("MANUAL_EDIT"))))
    after = tried.select(F.explode(F.array(stay, new)).alias("rows")).select(F.inline("rows"))
    after = versions.where(~F.coalesce("is_active", F.lit(True))).unionByName(after, allowMissingColumns=True)
    outcomes = apply_manual_edits(versions, edits)
    return after, _synced(results, outcomes.where("outcome = 'saved'").select("document_id", "fields", "confidence")), outcomes.where("outcome <> 'saved'").select("document_id", "edit_no", "outcome", "active")


def _synced(results: DataFrame, active: DataFrame) -> DataFrame:
    """results with the fields and confidence of active (document_id, fields, confidence) where it has them."""
    new = active.select(F.col("document_id").alias("n_id"), F.to_json("fields", {"ignoreNullFields": "false"}).alias("n_fields"), F.col("confidence").alias("n_conf"))
    rows = results.join(new, F.col("document_id") == F.col("n_id"), "left")
    return rows.withColumn("fields", F.coalesce("n_fields", "fields")).withColumn("confidence", F.coalesce("n_conf", "confidence")).drop("n_id", "n_fields", "n_conf")


def correct_in_turn(versions: DataFrame, corrections: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions and results after corrections (document_id, seq, fields: map) that follow each other.

    Each correction is a whole new version, made from what is active at its turn,
    unless its values are the same or it has no names. A field keeps its
    confidence as long as its value stays in every version, else it is 1. A
    correction depends on the one before it alone: versions are found by the lag
    of values, unbroken fields by the count of a value's steps, without a walk
    over a document. The active version goes through the same windows as step 0,
    so neither it nor the corrections are made twice; inactive versions go by.
    """
    clean = F.map_filter(F.transform_keys("fields", lambda k, v: X.strip_space(k)), lambda k, v: k != "")
    whole = F.transform_values(clean, lambda k, v: F.coalesce(v, F.lit("")))
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    rows = corrections.where("seq is not null").select("document_id", "seq", F.array_sort(F.map_entries(whole)).alias("values")).where(F.size("values") > 0)
    now = F.array_sort(F.transform(F.filter("held", _is_active), lambda h: pair(h["name"], h["value"])))
    start = _current(versions).select("document_id", F.when(F.col("active").isNotNull(), now).alias("values"), "top", "active", "held")
    by = Window.partitionBy("document_id").orderBy(F.col("seq").asc_nulls_first())
    document, so_far = Window.partitionBy("document_id"), by.rowsBetween(Window.unboundedPreceding, 0)
    every = rows.unionByName(start, allowMissingColumns=True).withColumn("before", F.lag("values").over(by))
    kept = every.where(F.col("seq").isNull() | ~F.col("values").eqNullSafe(F.col("before"))).drop("before")
    kept = kept.withColumns({"step": F.count("seq").over(so_far).cast("int"), "n_new": F.count("seq").over(document), "top": F.max("top").over(document), "active": F.max("active").over(document)})
    none = F.lit(None).cast(versions.select(F.struct(*versions.columns).alias("r")).schema["r"].dataType)
    item = lambda name, value, was: F.struct(name.alias("name"), value.alias("value"), was.alias("was"))
    items = F.when(F.col("seq").isNull(), F.transform("held", lambda h: item(h["name"], h["value"], h))).otherwise(F.transform("values", lambda e: item(e["key"], e["value"], none)))
    long = kept.select("document_id", "step", "n_new", "top", "active", F.inline(items))
    was = F.col("was")
    long = long.withColumn("step", F.when(was.isNull() | _is_active(was), F.col("step")))
    same = Window.partitionBy("document_id", "name", "value").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    long = long.withColumns({"unbroken": F.count("step").over(same) == F.col("step") + 1, "old": F.max(F.when(F.col("step") == 0, F.col("was.confidence"))).over(same)})
    number = (F.coalesce("top", F.lit(0)) + F.col("step")).cast("int")
    made = {"document_id": F.col("document_id"), "version_number": number, "name": F.col("name"), "value": F.col("value"), "confidence": F.when(F.col("unbroken"), F.col("old")).otherwise(F.lit(1.0)), "is_active": F.col("step") == F.col("n_new")}
    left = {c: was[c] for c in versions.columns} | {"is_active": was["is_active"] & (F.col("n_new") == 0)}
    both = long.select(
        *[F.when(was.isNotNull(), left[c]).otherwise(made.get(c, F.lit(None))).alias(c) for c in versions.columns],
        F.when(was.isNull(), F.when(F.col("step") == 1, F.col("active")).otherwise(number - 1)).cast("int").alias("previous_version"),
        F.when(was.isNull(), "MANUAL_EDIT").alias("source_type"),
    )
    after = versions.where(~F.coalesce("is_active", F.lit(True))).unionByName(both, allowMissingColumns=True)
    entries = F.array_sort(F.collect_list(F.struct("name", F.struct("value", "confidence").alias("entry"))))
    now = both.where("source_type is not null and is_active").groupBy("document_id").agg(F.map_from_entries(entries).alias("fields"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("confidence"))
    return after, _synced(results, now)


def version_diff(versions: DataFrame) -> DataFrame:
    """(document_id, version_number, name, change): added, removed, changed or same against the version before."""
    now = versions.select("document_id", "version_number", "name", "value")
    was = versions.select(F.col("document_id").alias("w_id"), (F.col("version_number") + 1).alias("w_no"), F.col("name").alias("w_name"), F.col("value").alias("w_value"))
    top = versions.groupBy(F.col("document_id").alias("t_id")).agg(F.max("version_number").alias("top"))
    both = now.join(was, (F.col("document_id") == F.col("w_id")) & (F.col("version_number") == F.col("w_no")) & (F.col("name") == F.col("w_name")), "full")
    rows = both.select(F.coalesce("document_id", "w_id").alias("document_id"), F.coalesce("version_number", "w_no").alias("version_number"), F.coalesce("name", "w_name").alias("name"), F.when(F.col("w_id").isNull(), "added").when(F.col("document_id").isNull(), "removed").when(F.col("value") == F.col("w_value"), "same").otherwise("changed").alias("change"))
    return rows.join(top, F.col("document_id") == F.col("t_id")).where(F.col("version_number") <= F.col("top")).drop("t_id", "top")


def version_history(versions: DataFrame) -> DataFrame:
    """(document_id, version_number, previous_version, n_fields, confidence, is_active, n_versions), newest first in each document."""
    rows = versions.groupBy("document_id", "version_number").agg(F.count("*").alias("n_fields"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("confidence"), F.bool_or("is_active").alias("is_active"))
    by = Window.partitionBy("document_id")
    return rows.withColumn("previous_version", F.lag("version_number").over(by.orderBy("version_number"))).withColumn("n_versions", F.count("*").over(by))


def backfill_versions(results: DataFrame, versions: DataFrame) -> DataFrame:
    """(document_id, version_number, source_type, is_active) for results whose document has no version."""
    have = versions.select(F.col("document_id").alias("v_id")).distinct()
    rows = results.join(have, F.col("document_id") == F.col("v_id"), "left_anti")
    return rows.select("document_id", F.lit(1).alias("version_number"), F.lit("INITIAL_EXTRACTION").alias("source_type"), F.lit(True).alias("is_active"))
