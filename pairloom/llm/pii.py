"""Personal information in free text found by a character tagger and replaced by typed placeholders.

The tagger (``pii_model``) reads whole texts in overlapping windows and gives spans. An exact check follows: a span is
moved to the value of its type's shape that it overlaps, and dropped if there is none; titles before a name are cut off.
Nothing is searched outside the tagger's spans. The weights are a file of this package, loaded once per worker.

Defined results: NULL and empty text, and text without a letter or digit, hold nothing; positions are code points; of
overlapping spans the longer counts, of equal ones the first type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pairloom.llm.pii_graph import fastest
from pairloom.llm.pii_model import Tagger, tag_texts
from pairloom.llm.pii_training import _EMAIL, _EMAIL_WORDS, SHAPES, TITLES

#: What a span of each type but names has to be, looked for right around its start.
CHECKS = {
    "email": re.compile(f"{_EMAIL}|{_EMAIL_WORDS}"),
    "phone": re.compile(SHAPES["phone"]),
    "idnum": re.compile(SHAPES["idnum"]),
    "street": re.compile(SHAPES["street"]),
}

#: Placeholders by type.
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "idnum": "[ID]", "street": "[ADDRESS]", "person": "[NAME]"}

_READY: dict[str, Tagger] = {}


def checked(text: str, kind: str, start: int, end: int) -> tuple[str, int, int] | None:
    """The value of its type that a span stands for."""
    if kind == "person":
        while title := re.match(r"(?i)" + TITLES, text[start:end]):
            start += title.end()
        while start > 0 and text[start - 1].isalnum() and text[start].isalnum():
            start -= 1
        while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
            end += 1
        value = text[start:end]
        start += len(value) - len(value.lstrip(" ,.;:\n"))
        value = text[start:end].rstrip(" ,;:\n")
        return (kind, start, start + len(value)) if len(re.findall(r"[^\W\d_]{2,}", value)) >= 2 else None
    # the nearest place to the tagged start at which a value of the shape begins
    reach = 12 if kind != "email" else 40
    for step in sorted(range(-reach, reach + 1), key=lambda d: (abs(d), d)):
        at = start + step
        if not 0 <= at < end or (at > 0 and (text[at - 1].isalnum() or text[at - 1] in "@#") and text[at].isalnum()):
            continue
        hit = CHECKS[kind].match(text, at)
        if hit and hit.end() > start:
            return (kind, at, hit.end())
    return None


def spans_of(model: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Checked spans of every text, none overlapping."""
    out = []
    for text, tagged in zip(texts, tag_texts(model, texts), strict=True):
        kept: list[tuple[str, int, int]] = []
        found = [s for s in (checked(text, *t) for t in tagged) if s]
        for s in sorted(found, key=lambda s: (s[1] - s[2], s[1], s[0])):
            if all(s[2] <= k[1] or s[1] >= k[2] for k in kept):
                kept.append(s)
        out.append(sorted(kept, key=lambda s: s[1]))
    return out


def model() -> Tagger:
    """The trained tagger, loaded once per process."""
    if "tagger" not in _READY:
        _READY["tagger"] = fastest(Tagger.load())
    return _READY["tagger"]


def _spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """``df`` over so many partitions; reading a text costs far less than tagging it, so few large files are spread."""
    return df.repartition(partitions) if partitions else df


def find_pii(df: DataFrame, key: str, text: str, partitions: int | None = None) -> DataFrame:
    """(key, pii_type, start_pos, end_pos) of every occurrence in the column ``text``."""
    kind = dict(df.dtypes)[key]
    slim = _spread(df, partitions).select(F.col(key).alias("__key"), F.col(text).alias("__text")).filter(F.regexp_like("__text", F.lit(r"[\p{L}\p{N}]")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = model()
        for batch in batches:
            for low in range(0, batch.num_rows, 1_000):
                part = batch.slice(low, 1_000)
                texts = part.column(1).to_pylist()
                found = spans_of(tagger, texts)
                at = [i for i, spans in enumerate(found) for _ in spans]
                flat = [s for spans in found for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at, pa.int64())), pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.int32()), pa.array([s[2] for s in flat], pa.int32())],
                    ["key", "pii_type", "start_pos", "end_pos"],
                )

    return slim.mapInArrow(run, f"key {kind}, pii_type string, start_pos int, end_pos int").withColumnRenamed("key", key)


def redact(df: DataFrame, text: str, into: str = "redacted", partitions: int | None = None) -> DataFrame:
    """Add ``into``: the text with a typed placeholder in place of every occurrence; NULL stays NULL."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = model()
        for batch in batches:
            texts = [t or "" for t in batch]
            out = []
            for t, raw, spans in zip(texts, batch, spans_of(tagger, texts), strict=True):
                pieces, last = [], 0
                for kind, a, z in spans:
                    pieces += [t[last:a], PLACEHOLDERS[kind]]
                    last = z
                out.append(None if raw is None else "".join([*pieces, t[last:]]))
            yield pd.Series(out, dtype=object)

    return _spread(df, partitions).withColumn(into, F.pandas_udf(run, StringType())(F.col(text)))
