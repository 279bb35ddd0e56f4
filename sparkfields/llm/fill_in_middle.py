"""Fill-in-middle transformation with a sparse index of multibyte characters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 7
#: Of 100 documents, so many are transformed; of 100 of these, so many begin with the suffix.
RATE, SPM = 100, 50

_FIELDS = [("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("prefix_bytes", "bigint"), ("middle_bytes", "bigint"), ("output", "string")]
_ARROW = pa.struct([(n, {"bigint": pa.int64(), "string": pa.string()}[t]) for n, t in _FIELDS])


class Index:
    """Where a UTF-8 text has more than one byte a character.

    `at` holds the code-point positions of the multibyte characters, `lead` their
    byte positions, `excess` the bytes that the first 0, 1, 2... of them add.
    Between them a code point and its byte differ by a constant.
    """

    def __init__(self, raw: np.ndarray):
        self.lead = np.flatnonzero(raw >= 0xC0)
        first = raw[self.lead]
        more = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(more)])
        self.at = self.lead - self.excess[:-1]
        self.chars = len(raw) - int(self.excess[-1])

    def to_bytes(self, chars: np.ndarray) -> np.ndarray:
        return chars + self.excess[np.searchsorted(self.at, chars)]

    def to_chars(self, offsets: np.ndarray) -> np.ndarray:
        """Byte offsets must not lie inside a character."""
        return offsets - self.excess[np.searchsorted(self.lead, offsets)]


def arrange(raw: bytes, doc_id: str, unit: str, rate: int, spm: int, seed: int) -> dict:
    """The fields of one document."""
    text = np.frombuffer(raw, np.uint8)
    index = Index(text)
    if unit == "line":
        ends = np.flatnonzero(text == 0x0A) + 1
        if len(raw) and not raw.endswith(b"\n"):
            ends = np.append(ends, len(raw))
        n = len(ends)
    else:
        n = index.chars
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not raw or any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return {"n": n, "form": "plain", "output": raw}
    cuts = np.array(sorted((h1 % (n + 1), h2 % (n + 1))))
    if unit == "line":
        offsets = np.where(cuts > 0, ends[cuts - 1], 0)
        chars = index.to_chars(offsets)
    else:
        chars, offsets = cuts, index.to_bytes(cuts)
    a, b = map(int, offsets)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    form = "spm" if h4 % 100 < spm else "psm"
    head = SUFFIX + suffix + PREFIX + prefix if form == "spm" else PREFIX + prefix + SUFFIX + suffix
    return {
        "n": n, "form": form, "prefix_chars": int(chars[0]), "middle_chars": int(chars[1] - chars[0]),
        "prefix_bytes": a, "middle_bytes": b - a, "output": head + MIDDLE + middle,
    }


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "fim", unit: str = "line", rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """docs with a struct `into`: n units, form (plain, psm, spm), lengths of prefix and middle in characters and bytes, output.

    Units are lines with their ends, or characters (unit="char"). The cuts and the
    form follow from the seed and the id alone. Null and empty texts and texts
    that contain a marker are plain, with null lengths; a null id counts as the
    empty text; repeated rows give equal results; texts of any length are
    arranged whole; no rows give no rows. A column `into` of docs is replaced,
    others stay, whatever their names.
    """
    if unit not in ("line", "char"):
        raise ValueError("unit is line or char")
    docs = docs.drop(into)
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    schema = ", ".join([*columns, f"`{into}` struct<{','.join(f'{n}:{t}' for n, t in _FIELDS)}>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, text_col):
            at = {n: k for k, n in enumerate(batch.schema.names)}
            texts = batch.column(at[text_col]).cast(pa.binary()).to_pylist()
            ids = batch.column(at[id_col]).cast(pa.string()).to_pylist()
            made = [arrange(t or b"", i or "", unit, rate, spm, seed) for t, i in zip(texts, ids, strict=True)]
            parts = [pa.array([m.get(n) for m in made], pa.binary()).cast(pa.string()) if n == "output" else pa.array([m.get(n) for m in made], _ARROW.field(k).type) for k, (n, _) in enumerate(_FIELDS)]
            fim = pa.StructArray.from_arrays(parts, fields=list(_ARROW))
            yield pa.RecordBatch.from_arrays([*batch.columns, fim], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, schema)


def restored(form: Column, output: Column) -> Column:
    """The text again; a text that is not plain holds no marker, so the first of each is the one that was set."""
    p, s, m = (F.lit(x.decode()) for x in (PREFIX, SUFFIX, MIDDLE))
    psm = F.split_part(F.split_part(output, p, F.lit(2)), s, F.lit(1))
    rest = F.split_part(output, s, F.lit(2))
    middle = F.split_part(output, m, F.lit(2))
    spm = F.split_part(F.split_part(output, p, F.lit(2)), m, F.lit(1))
    return (
        F.when(form == "psm", F.concat(psm, middle, F.split_part(rest, m, F.lit(1))))
        .when(form == "spm", F.concat(spm, middle, F.split_part(rest, p, F.lit(1))))
        .otherwise(output)
    )
