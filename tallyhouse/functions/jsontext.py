"""JSON text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import EVENT, RAW_EVENT
from .basics import as_col

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def dumps(*columns: Column | str, nulls: bool = True) -> Column:
    """The given columns as one compact JSON object; dates in ISO form, nulls kept unless ``nulls`` is false."""
    return F.to_json(
        F.struct(*columns), {"timestampFormat": ISO_FORMAT, "ignoreNullFields": str(not nulls).lower()}
    )


def dump_row(df: DataFrame, *, money_as_text: bool = True, nulls: bool = True) -> Column:
    """Whole row as compact JSON; decimals as text so no digit is lost."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if money_as_text and isinstance(field.dataType, T.DecimalType):
            column = column.cast("string").alias(field.name)
        columns.append(column)
    return dumps(*columns, nulls=nulls)


def loads(value: Column | str, schema: T.StructType | str = EVENT) -> Column:
    return F.from_json(as_col(value), schema)


def validate(value: Column | str) -> Column:
    """True where the text is JSON; false for null and blank text."""
    return F.try_parse_json(as_col(value)).isNotNull()


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Blank lines dropped, each other line parsed as one raw (text-typed) event.

    ``_corrupt_record`` holds the line where it is not a JSON object, so a bad
    line can be routed to quarantine instead of failing the job or vanishing.

    The parsed struct passes through ``inline``: a later filter on its fields
    then stays above the parser. As a plain projection the optimizer would copy
    the parser into the filter once per field it mentions.
    """
    schema = T.StructType(RAW_EVENT.fields + [T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json(
        F.trim(F.col(column)),
        schema,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    return lines.filter(F.length(F.trim(F.col(column))) > 0).select(
        F.trim(F.col(column)).alias("_line"), F.inline(F.array(parsed))
    )


def typed(raw: DataFrame) -> DataFrame:
    """Raw text event columns to the EVENT types; unreadable values become null."""
    columns = []
    for field in EVENT.fields:
        source = F.col(field.name)
        if field.name == "metadata":
            columns.append(source)
        elif isinstance(field.dataType, T.StringType):
            columns.append(F.trim(source).alias(field.name))
        elif isinstance(field.dataType, T.TimestampType):
            columns.append(F.try_to_timestamp(source).alias(field.name))
        else:
            columns.append(source.try_cast(field.dataType).alias(field.name))
    keep = [F.col(c) for c in raw.columns if c not in EVENT.fieldNames()]
    return raw.select(*columns, *keep)
