"""Sources and file sinks: every query writes or reads data derived from the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import jsontext
from ..functions.jsontext import dump_row
from ..operators import alerts as A
from ..operators import windows as W
from ..session import scratch
from ..sinks import catalog, files
from ..sources import readers
from ..sources import relational as R
from .base import amount, query, with_ctes

CORE = (
    "event_id, event_type, event_timestamp, ingestion_timestamp, customer_id, session_id, "
    "product_id, page, action, cart_id, quantity, order_id, total_amount, status"
)
CORE_SQL = CORE.replace("total_amount", f"{amount('total_cents')} AS total_amount")
ACTIVITY = with_ctes(f"SELECT {CORE_SQL} FROM activity_ev", "activity_ev")


def core(df):
    return df.select(*[c.strip() for c in CORE.split(",")])


def rough_events(spark, root):
    """The whole event feed as a careless producer would send it: text times, upper-case
    and padded types and statuses, odd column names, some unreadable times, some
    missing customers."""
    df = R.all_events(spark, root)
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    loud = lambda c: F.concat(F.lit(" "), F.upper(F.col(c)), F.lit(" "))
    df = df.withColumns(
        {
            "event_type": F.when(F.col("quantity") > 25, loud("event_type")).otherwise(
                F.col("event_type")
            ),
            "status": loud("status"),
            "event_timestamp": F.when(F.col("quantity") == 7, F.lit("not a time")).otherwise(
                F.date_format("event_timestamp", iso)
            ),
            "ingestion_timestamp": F.date_format("ingestion_timestamp", iso),
            "customer_id": F.when(F.col("quantity") == 13, F.lit(None)).otherwise(
                F.col("customer_id")
            ),
        }
    )
    return df.withColumnsRenamed({"event_id": " Event_ID ", "quantity": "QUANTITY", "page": "Page"})


def event_lines(spark, root):
    """Activity events as JSON lines, with blank and broken lines mixed in."""
    df = R.activity_events(spark, root).drop("metadata")
    good = df.select(F.concat(F.lit("  "), dump_row(df), F.lit(" ")).alias("value"))
    noise = df.filter(F.col("event_type") == "cart").select(
        F.when(F.col("quantity") > 6, F.lit("   ")).otherwise(
            F.concat(F.lit("{broken "), F.col("event_id"))
        ).alias("value")
    )
    return good.unionByName(noise)


#: Rows of the activity feed that one task sorts for a file of lines in order.
FILE_ROWS = 100_000


def files_for(spark, root, parts):
    """Files for each of ``parts`` parts of the activity feed, so that a file stays small however long the feed is."""
    return max(1, int(-(-R.table(spark, root, "events").count() // (parts * FILE_ROWS))))


def written_lines(spark, root, lines=event_lines):
    path = scratch(spark, "lines")
    lines(spark, root).write.text(path)
    return path


@query("src1_read_json", ACTIVITY)
def _(spark, root):
    path = scratch(spark, "raw")
    # one sub-folder per type: the scan is recursive
    df = R.activity_events(spark, root).withColumn("kind", F.col("event_type"))
    files.write_jsonl(df, path, partition_by=["kind"])
    return core(readers.read_json(spark, path))


@query("src2_read_parquet", with_ctes(
    f"SELECT event_id, order_id, quantity, {amount('total_cents')} AS total_amount FROM order_ev", "order_ev"))
def _(spark, root):
    path = scratch(spark, "parquet")
    files.write_parquet(R.order_events(spark, root), path)
    return readers.read_parquet(spark, path).select("event_id", "order_id", "quantity", "total_amount")


@query("src3_read_raw", ACTIVITY)
def _(spark, root):
    path = scratch(spark, "raw")
    files.write_jsonl(R.activity_events(spark, root), path)
    return core(readers.read_raw(spark, path))


@query("src4_read_clean", ACTIVITY)
def _(spark, root):
    path = scratch(spark, "clean")
    files.write_clean(R.activity_events(spark, root), path, ["event_type", "no_such_column", " "])
    return core(readers.read_clean(spark, path))


@query("src7_json_records", ACTIVITY)
def _(spark, root):
    path = scratch(spark, "lines")
    df = R.activity_events(spark, root)
    df.select(dump_row(df).alias("value")).unionByName(
        df.select(F.lit("  ").alias("value"))
    ).write.text(path)
    return core(readers.read_json_records(spark, path))


@query("src9_read_table", ACTIVITY)
def _(spark, root):
    name = "src9_" + scratch(spark, "t").rsplit("-", 1)[1]
    path = scratch(spark, "table")
    catalog.load(R.activity_events(spark, root), name, "overwrite", path=path)
    return core(readers.read_table(spark, name))


LINE_COUNT = (
    "(SELECT count(*) FROM activity_ev) + "
    "(SELECT count(*) FROM activity_ev WHERE event_type = 'cart' AND quantity <= 6)"
)


@query("src11_text_lines", with_ctes(f"SELECT {LINE_COUNT} AS line_count, 0::BIGINT AS untrimmed", "activity_ev"))
def _(spark, root):
    lines = readers.read_lines(spark, written_lines(spark, root))
    return lines.agg(
        F.count(F.lit(1)).alias("line_count"),
        F.count(F.when(F.trim("value") != F.col("value"), 1)).alias("untrimmed"),
    )


@query("src12_parsed_events", ACTIVITY)
def _(spark, root):
    good, _bad = readers.read_events(spark, written_lines(spark, root))
    return core(jsontext.typed(good))


@query("src12_quarantined_lines", with_ctes(
    "SELECT '{broken ' || event_id AS line FROM activity_ev WHERE event_type = 'cart' AND quantity <= 6",
    "activity_ev"))
def _(spark, root):
    _good, bad = readers.read_events(spark, written_lines(spark, root))
    return bad.select(F.col("_line").alias("line"))


def contract_lines(spark, root):
    """Activity events as JSON lines holding only the fields of their type; carts above
    eight items carry an action outside the contract."""
    df = R.activity_events(spark, root)
    df = df.withColumn(
        "action",
        F.when((F.col("event_type") == "cart") & (F.col("quantity") > 8), F.lit("ADD")).otherwise(
            F.col("action")
        ),
    )
    base = ["event_id", "event_type", "event_timestamp", "ingestion_timestamp", "customer_id", "session_id"]
    fields = {
        "click": ["product_id", "page", "action"],
        "cart": ["cart_id", "product_id", "quantity", "action"],
        "order": ["order_id", "product_id", "quantity", "unit_price", "total_amount", "status"],
    }
    value = None
    for kind, own in fields.items():
        text = jsontext.dumps(*base, *own)
        test = F.col("event_type") == kind
        value = F.when(test, text) if value is None else value.when(test, text)
    return df.select(value.alias("value"))


#: The contract's least amount is a cent; an unknown one does not keep it.
PRICED = "(event_type <> 'order' OR coalesce(unit_cents >= 1 AND total_cents >= 1, false))"
CONTRACT_OK = f"WHERE NOT (event_type = 'cart' AND quantity > 8) AND {PRICED}"


@query("src13_validated_events", with_ctes(f"SELECT {CORE_SQL} FROM activity_ev {CONTRACT_OK}", "activity_ev"))
def _(spark, root):
    path = written_lines(spark, root, contract_lines)
    return core(readers.read_validated_events(spark, path))


@query("src14_unified_row", with_ctes(f"SELECT {CORE_SQL} FROM click_ev", "click_ev"))
def _(spark, root):
    narrow = R.click_events(spark, root).select(
        "event_id", "event_type", "event_timestamp", "ingestion_timestamp", "customer_id",
        "session_id", "product_id", "page", "action",
    )
    return core(readers.to_unified(narrow))


@query("src15_event_count", with_ctes(
    f"SELECT count(*) AS event_count FROM activity_ev {CONTRACT_OK}", "activity_ev"))
def _(spark, root):
    return readers.count_events(spark, written_lines(spark, root, contract_lines))


# ---- sinks -------------------------------------------------------------------
@query("snk1_partitioned_parquet", with_ctes(
    "SELECT event_type, CAST(event_timestamp AS DATE) AS event_date, count(*) AS n FROM activity_ev "
    "GROUP BY ALL", "activity_ev"))
def _(spark, root):
    path = scratch(spark, "events")
    df = R.activity_events(spark, root).withColumn("event_date", F.to_date("event_timestamp"))
    files.write_parquet(df, path, partition_by=["event_date", " "])
    back = readers.read_parquet(spark, path)
    return back.groupBy("event_type", "event_date").agg(F.count(F.lit(1)).alias("n"))


HOURS = (
    "strftime(event_timestamp, '%Y') AS ano, strftime(event_timestamp, '%m') AS mes, "
    "strftime(event_timestamp, '%d') AS dia, strftime(event_timestamp, '%H') AS hora"
)


@query("snk16_hourly_archive", with_ctes(
    f"SELECT {HOURS}, count(*) AS events, {amount('CAST(sum(coalesce(total_cents, 0)) AS BIGINT)')} "
    "AS amount FROM activity_ev GROUP BY ALL", "activity_ev"))
def _(spark, root):
    path = scratch(spark, "archive")
    files.write_event_archive(R.activity_events(spark, root), path)
    back = (
        spark.read.schema("value STRING, ano STRING, mes STRING, dia STRING, hora STRING")
        .format("text").load(path)
    )
    money = F.get_json_object("value", "$.total_amount").cast("decimal(14,2)")
    return back.groupBy("ano", "mes", "dia", "hora").agg(
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.sum(money), F.lit(0)).cast("double").alias("amount"),
    )


def archived(spark, path):
    return spark.read.schema("value STRING, ano STRING, mes STRING, dia STRING, hora STRING").format("text").load(path)


@query("snk19_alert_archive", with_ctes(
    f"SELECT {HOURS}, 'alert-order-' || event_id AS alert_id, customer_id FROM activity_ev "
    "WHERE event_type = 'order' AND total_cents >= 5000", "activity_ev"))
def _(spark, root):
    path = scratch(spark, "alert_archive")
    found = A.detect(R.activity_events(spark, root), [A.large_order_value("50.00")])
    files.write_alert_archive(found, path)
    field = lambda name: F.get_json_object("value", f"$.{name}").alias(name)
    return archived(spark, path).select("ano", "mes", "dia", "hora", field("alert_id"), field("customer_id"))


@query("snk20_window_archive", with_ctes(
    f"SELECT {HOURS.replace('event_timestamp', 'start')}, count(*) AS windows, CAST(sum(n) AS BIGINT) AS events FROM ("
    "SELECT date_trunc('minute', event_timestamp) AS start, count(*) AS n FROM activity_ev GROUP BY ALL) GROUP BY ALL",
    "activity_ev"))
def _(spark, root):
    path = scratch(spark, "window_archive")
    files.write_window_archive(W.process(R.activity_events(spark, root), 60, 60, ordered=False), path)
    n = F.get_json_object("value", "$.event_count").cast("long")
    return archived(spark, path).groupBy("ano", "mes", "dia", "hora").agg(
        F.count(F.lit(1)).alias("windows"), F.sum(n).alias("events"))


@query("snk21_archive_folder", with_ctes(
    f"SELECT event_id, {HOURS} FROM all_ev", "all_ev"))
def _(spark, root):
    df = R.all_events(spark, root)
    from ..functions.timestamps import sink_partitions

    return df.select("event_id", *[c.alias(n) for n, c in sink_partitions("event_timestamp").items()])


@query("snk22_event_json", with_ctes(
    "SELECT '{\"event_id\":\"' || event_id || '\",\"quantity\":' || quantity || ',\"total_amount\":\"' || "
    "(total_cents // 100) || '.' || lpad(CAST(total_cents % 100 AS VARCHAR), 2, '0') || '\",\"session_id\":null}' "
    "AS payload FROM order_ev", "order_ev"))
def _(spark, root):
    df = R.order_events(spark, root).select("event_id", "quantity", "total_amount", "session_id")
    return df.select(dump_row(df).alias("payload"))


@query("js4_read_jsonl", ACTIVITY)
def _(spark, root):
    path = scratch(spark, "jsonl")
    files.write_jsonl(R.activity_events(spark, root), path)
    return core(readers.read_jsonl(spark, path))


@query("js6_count_jsonl", with_ctes("SELECT count(*) AS record_count FROM activity_ev", "activity_ev"))
def _(spark, root):
    path = scratch(spark, "jsonl")
    files.write_jsonl(R.activity_events(spark, root), path)
    return readers.count_jsonl(spark, path)


def folder_with_bad_lines(spark, root):
    """Four folders of JSON lines in order of their ids; some lines are broken, no object, or blank.

    A folder has as many files as its rows ask for, named in order, so that no task sorts a whole folder.
    """
    path, tasks = scratch(spark, "jsonl"), 4 * files_for(spark, root, 4)
    df = R.activity_events(spark, root)
    number = F.substring("event_id", 3, 20).cast("long")
    line = (
        F.when(F.col("quantity") == 6, F.concat(F.lit("{broken "), "event_id"))
        .when(F.col("quantity") == 9, F.lit("[1, 2]"))
        .when(F.col("quantity") == 12, F.lit("  "))
        .otherwise(dump_row(df))
    )
    rows = df.select((number % 4).alias("part"), number.alias("id"), line.alias("value"))
    ordered = rows.repartitionByRange(tasks, "part", "id").sortWithinPartitions("part", "id")
    ordered.drop("id").write.partitionBy("part").text(path)
    return path


@query("js4_bad_lines", with_ctes(
    "SELECT part, line_number, CASE WHEN quantity = 6 THEN '{broken ' || event_id ELSE '[1, 2]' END AS line FROM ("
    "SELECT *, id % 4 AS part, row_number() OVER (PARTITION BY id % 4 ORDER BY id) AS line_number "
    "FROM (SELECT *, CAST(substr(event_id, 3) AS BIGINT) AS id FROM activity_ev)) WHERE quantity IN (6, 9)", "activity_ev"))
def _(spark, root):
    path = folder_with_bad_lines(spark, root)
    part = F.regexp_extract("file", r"part=(\d)", 1).cast("long").alias("part")
    # the lines of a folder are numbered through: those of its files before come first
    files = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(part).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    bad = readers.bad_lines(spark, path).join(before, "file")
    return bad.select(part, (F.col("before") + F.col("line_number")).alias("line_number"), F.col("value").alias("line"))
