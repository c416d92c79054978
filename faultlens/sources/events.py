"""Runtime error events, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.schemas import RUNTIME_EVENT
from faultlens.sources.logs import read_text_lines

EVENT_GLOBS = ("*.jsonl",)


def parse_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Typed event columns next to the other columns; malformed lines are dropped whole.

    A field of the wrong type makes its line malformed, so every field's own JSON type
    is looked at; a missing field or ``null`` is empty text or 0.
    """
    others = [c for c in lines.columns if c != value]
    # The generator keeps the tests below from parsing the text once per field.
    doc = lines.where(F.col(value) != "").select(
        *others, F.explode(F.array(F.try_parse_json(value))).alias("_v")
    )
    doc = doc.where(F.col("_v").isNotNull())
    good = F.schema_of_variant("_v").rlike("^(OBJECT|VOID)")
    fields = []
    for field in RUNTIME_EVENT.fields:
        is_text = isinstance(field.dataType, T.StringType)
        path = f"$.{field.name}"
        found = F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
        allowed = ("STRING", "VOID") if is_text else ("BIGINT", "VOID")
        good = good & F.coalesce(found.isin(*allowed), F.lit(True))
        value_of = F.try_variant_get("_v", path, field.dataType.simpleString())
        fields.append(F.coalesce(value_of, F.lit("" if is_text else 0)).alias(field.name))
    return doc.where(good).select(*others, *fields)


def read_events(spark: SparkSession, path: str, globs: tuple[str, ...] = EVENT_GLOBS) -> DataFrame:
    """Events of a file or of a directory's matching files, with ``event_order``."""
    lines = read_text_lines(spark, path, globs).withColumnRenamed("line_order", "event_order")
    return parse_events(lines)
