"""Versions of documents: what their plans shuffle, and edits and corrections against literal rows."""

from __future__ import annotations

from sparkfields.operators import quality, versions
from sparkfields.plans import flows, records

from .test_layout import SF, shuffles

KIND = "document_id string, version_number int, name string, value string, confidence double, is_active boolean, more string"
ROWS = [("d", 1, "a", "1", 0.5, False, "x"), ("d", 2, "a", "2", 0.6, True, "y"), ("d", 2, "b", "7", 0.7, True, None), ("e", 1, "a", "1", 0.8, True, "z"), ("f", 1, "a", "1", 0.8, False, "w")]


def found(df):
    return {tuple(r) for r in df.collect()}


def test_history_shuffles_lines_once(spark):
    keys = shuffles(records.c09_version_history(spark, SF))
    assert len(keys) == 1 and "l_orderkey" in keys[0]


def test_corrections_shuffle_lines_once_for_versions_and_once_for_decisions(spark):
    keys = shuffles(records.b13_corrected_versions(spark, SF))
    assert sum("l_orderkey" in k for k in keys) <= 3 and not any(k.startswith("document_id, ") and "name" in k for k in keys)


def test_saved_edits_shuffle_their_documents_once_beside_lines(spark):
    keys = shuffles(records.e06_saved_versions(spark, SF))
    assert sum("l_orderkey" not in k for k in keys) <= 1


def test_schema_confidence_shuffles_fields_once(spark):
    assert sum(k.startswith("doc_id") for k in shuffles(flows.d09_schema_confidence(spark, SF))) == 1


def test_corrections_in_turn_keep_what_was_there(spark):
    v = spark.createDataFrame(ROWS, KIND)
    kind = "document_id string, seq int, fields map<string,string>"
    c = spark.createDataFrame([("d", 1, {"a": "2", "b": "7"}), ("d", 2, {" a": "2", "b": "8"}), ("d", 3, {"a": "2", "b": "7"}), ("f", 1, {"a": "1"}), ("g", 5, {"n": None}), ("e", 1, {" ": "x"})], kind)
    r = spark.createDataFrame([("d", "{}", 0.1), ("e", "{}", 0.2)], "document_id string, fields string, confidence double")
    after, synced = versions.correct_in_turn(v, c, r)
    old = {(*r[:5], r[5] and r[0] != "d", r[6], None, None) for r in ROWS}
    new = {
        ("d", 3, "a", "2", 0.6, False, None, 2, "MANUAL_EDIT"), ("d", 3, "b", "8", 1.0, False, None, 2, "MANUAL_EDIT"), ("d", 4, "a", "2", 0.6, True, None, 3, "MANUAL_EDIT"), ("d", 4, "b", "7", 1.0, True, None, 3, "MANUAL_EDIT"),
        ("f", 2, "a", "1", 1.0, True, None, None, "MANUAL_EDIT"), ("g", 1, "n", "", 1.0, True, None, None, "MANUAL_EDIT"),
    }
    assert found(after) == old | new and after.count() == len(old | new)
    assert {(x.document_id, x.confidence) for x in synced.collect()} == {("d", 0.8), ("e", 0.2)}


def test_saved_edits_keep_documents_without_edits(spark):
    v = spark.createDataFrame(ROWS, KIND)
    kind = "document_id string, edit_no int, base_version int, fields array<struct<name:string,value:string>>"
    e = spark.createDataFrame([("d", 1, 1, [("a", "9")]), ("d", 2, 2, [("a", "2"), ("b", "9")]), ("d", 3, 2, [("a", "5")]), ("h", 1, 1, [("a", "1")])], kind)
    r = spark.createDataFrame([("d", "{}", 0.1)], "document_id string, fields string, confidence double")
    after, synced, refused = versions.save_edits(v, e, r)
    old = {(*r[:5], r[5] and r[0] != "d", r[6], None, None) for r in ROWS}
    new = {("d", 3, "a", "2", 0.6, True, None, 2, "MANUAL_EDIT"), ("d", 3, "b", "9", 1.0, True, None, 2, "MANUAL_EDIT")}
    assert found(after) == old | new and after.count() == len(old | new)
    assert {(x.document_id, x.edit_no, x.outcome) for x in refused.collect()} == {("d", 1, "conflict"), ("d", 3, "conflict"), ("h", 1, "conflict")}
    assert [x.confidence for x in synced.collect()] == [0.8]


def test_schema_confidence_of_several_schemas(spark):
    f = spark.createDataFrame([("p", "s", "a", "1"), ("p", "s", "a", "2"), ("p", "t", "b", " "), ("q", "s", "b", "1"), ("r", "u", "a", "1")], "doc_id string, schema_id string, name string, value string")
    s = spark.createDataFrame([("s", "a", True), ("s", "b", True), ("s", "c", False), ("t", "a", False), ("t", "b", False)], "schema_id string, name string, required boolean")
    assert found(quality.schema_confidence(f, s)) == {("p", 0.5), ("q", 0.5)}
