"""Shared parts: table access, written intermediate results, ASCII-only case folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

#: White space of the corpus contracts: the six ASCII blanks and nothing else.
BLANK = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\x0c\r"
WORD = f"[^{BLANK}]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back.

    Cuts the lineage: a lost executor costs a re-read of files, not the work that
    made them, and the planner knows the table's real size.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    ``lower`` is the quick way where the text has ASCII characters only; elsewhere
    it would also change letters such as É.
    """
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def scanned(docs: DataFrame, make, fields: str, with_text: bool = False) -> DataFrame:
    """``row`` (all columns but the text), optionally ``text``, and new columns made from the text.

    ``make()`` runs once per task and returns a function from a list of texts, nulls
    included, to one list or array per field. Texts pass in Arrow batches, without a shuffle.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    rest = [f"`{c}`" for c in docs.columns if c != "text"]
    df = docs.select(F.struct(*rest).alias("row"), F.col("text").cast("string").alias("text"))
    new = T._parse_datatype_string(fields)
    schema = T.StructType([*df.schema.fields[: 1 + with_text], *new.fields])
    types = [f for f in _arrow_fields(new)]

    def run(batches):
        fn = make()
        for batch in batches:
            made = fn(batch.column(1).to_pylist())
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, (_, t) in zip(made, types)]
            head = [batch.column(0), batch.column(1)][: 1 + with_text]
            yield pa.RecordBatch.from_arrays([*head, *arrays], [*["row", "text"][: 1 + with_text], *[n for n, _ in types]])

    return df.mapInArrow(run, schema)


def _arrow_fields(schema):
    from pyspark.sql.pandas.types import to_arrow_type

    return [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]
