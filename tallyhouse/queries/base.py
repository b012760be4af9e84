"""Registry and the SQL building blocks of the oracles.

The oracles are written on their own from the operator descriptions; money is
kept in whole cents there, so sums and half-up rounding are exact integers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import pin_utc, size_shuffles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Result types both engines share: bigint, double, naive timestamp, text.

    A map becomes ``key=value`` pairs in the order of its keys, so that it is compared too.
    """
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(kind, (T.DecimalType, T.FloatType)):
            column = column.cast("double")
        elif isinstance(kind, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(kind, T.ArrayType):
            column = F.concat_ws(",", column)
        elif isinstance(kind, T.MapType):
            pairs = F.transform(
                F.array_sort(F.map_entries(column)),
                lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit(""))),
            )
            column = F.array_join(pairs, ";")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, root)`` under a name, with its oracle when there is one."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, root: str) -> DataFrame:
            return plain(fn(size_shuffles(pin_utc(spark), root), root))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return register


def step(name, source, fn, columns: dict[str, str], cte: str, where: str = "", key: str = "event_id"):
    """Register a row-level operator: its new columns next to the event id."""
    body = ", ".join(f"{expr} AS {col}" for col, expr in columns.items())
    sql = with_ctes(f"SELECT {key}, {body} FROM {cte} {where}", cte)

    @query(name, sql)
    def run(spark, root):
        return fn(source(spark, root)).select(key, *columns)

    return run


# ---- SQL fragments ---------------------------------------------------------
def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def flag(condition: str) -> str:
    return f"CAST(coalesce({condition}, false) AS BIGINT)"


def total(cents: str = "total_cents") -> str:
    """Sum of cents as an amount."""
    return f"CAST(CAST(sum({cents}) AS BIGINT) AS DOUBLE) / 100"


def mean(cents: str = "total_cents") -> str:
    """Mean amount of the non-null rows."""
    return f"(CAST(CAST(sum({cents}) AS BIGINT) AS DOUBLE) / 100) / count({cents})"


def mean_2(cents: str = "total_cents") -> str:
    """Mean rounded half up to cents, by integer arithmetic."""
    s, n = f"CAST(sum({cents}) AS BIGINT)", f"count({cents})"
    return f"CASE WHEN {n} > 0 THEN CAST((2 * {s} + {n}) // (2 * {n}) AS DOUBLE) / 100 END"


def amount(cents: str) -> str:
    return f"CAST({cents} AS DOUBLE) / 100"


def round_2(expr: str) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(28,12)), 2) AS DOUBLE)"


COLUMNS = (
    "event_id, event_type, event_timestamp, ingestion_timestamp, customer_id, session_id, "
    "product_id, page, action, cart_id, quantity, order_id, unit_cents, total_cents, status, "
    "delivery_id, carrier, estimated_delivery, actual_delivery"
)
TIE_BREAK = ", ".join(
    f"{c} NULLS FIRST"
    for c in (
        "ingestion_timestamp event_timestamp event_type customer_id session_id product_id page "
        "action cart_id quantity order_id unit_cents total_cents status delivery_id carrier "
        "estimated_delivery actual_delivery"
    ).split()
)

CTES = {
    "lines": (
        """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus,
        l_shipdate, o_custkey, o_orderstatus, o_orderdate, CAST(l_quantity AS BIGINT) AS q,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
        (),
    ),
    "order_ev": (
        """SELECT 'o-' || l_orderkey || '-' || l_linenumber AS event_id, 'order' AS event_type,
        o_orderdate AS event_timestamp,
        o_orderdate + to_seconds(l_linenumber * 3) AS ingestion_timestamp,
        CAST(o_custkey AS VARCHAR) AS customer_id, CAST(NULL AS VARCHAR) AS session_id,
        CAST(l_partkey AS VARCHAR) AS product_id, CAST(NULL AS VARCHAR) AS page,
        CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS cart_id, q AS quantity,
        CAST(l_orderkey AS VARCHAR) AS order_id, (2 * cents + q) // (2 * q) AS unit_cents,
        cents AS total_cents,
        CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'created'
             ELSE 'processing' END AS status,
        CAST(NULL AS VARCHAR) AS delivery_id, CAST(NULL AS VARCHAR) AS carrier,
        CAST(NULL AS TIMESTAMP) AS estimated_delivery, CAST(NULL AS TIMESTAMP) AS actual_delivery
        FROM lines""",
        ("lines",),
    ),
    "delivery_ev": (
        """SELECT 'd-' || l_orderkey || '-' || l_linenumber AS event_id, 'delivery' AS event_type,
        l_shipdate AS event_timestamp,
        l_shipdate + to_hours(l_linenumber * 6) AS ingestion_timestamp,
        CAST(o_custkey AS VARCHAR) AS customer_id, CAST(NULL AS VARCHAR) AS session_id,
        CAST(NULL AS VARCHAR) AS product_id, CAST(NULL AS VARCHAR) AS page,
        CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS cart_id,
        CAST(NULL AS BIGINT) AS quantity, CAST(l_orderkey AS VARCHAR) AS order_id,
        CAST(NULL AS BIGINT) AS unit_cents, CAST(NULL AS BIGINT) AS total_cents,
        CASE WHEN l_linestatus = 'F' THEN 'delivered' WHEN l_returnflag = 'R' THEN 'failed'
             WHEN l_returnflag = 'A' THEN 'in_transit' ELSE 'pending' END AS status,
        'dl-' || l_orderkey || '-' || l_linenumber AS delivery_id,
        'carrier-' || l_suppkey AS carrier, o_orderdate + INTERVAL 30 DAY AS estimated_delivery,
        CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS actual_delivery
        FROM lines""",
        ("lines",),
    ),
    "activity_ev": (
        """SELECT 'e-' || event_id AS event_id,
        CASE WHEN event_type IN ('click', 'view') THEN 'click'
             WHEN event_type IN ('signup', 'error') THEN 'cart' ELSE 'order' END AS event_type,
        ts AS event_timestamp, ts + to_seconds(event_id % 20) AS ingestion_timestamp,
        CAST(user_id AS VARCHAR) AS customer_id,
        's-' || user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, 'p-' || k AS product_id,
        CASE WHEN event_type IN ('click', 'view') THEN event_type END AS page,
        CASE event_type WHEN 'view' THEN 'view'
             WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'product_view' ELSE 'add_to_cart' END
             WHEN 'signup' THEN 'created' WHEN 'error' THEN 'abandoned' END AS action,
        CASE WHEN event_type IN ('signup', 'error')
             THEN 'c-' || user_id || '-' || strftime(ts, '%Y%m%d') END AS cart_id,
        CAST(CASE WHEN event_type IN ('signup', 'error') THEN k % 12 + 1
             WHEN event_type = 'purchase' THEN 1 END AS BIGINT) AS quantity,
        CASE WHEN event_type = 'purchase' THEN 'e-' || event_id END AS order_id,
        CASE WHEN event_type = 'purchase' THEN v END AS unit_cents,
        CASE WHEN event_type = 'purchase' THEN v END AS total_cents,
        CASE WHEN event_type = 'purchase' THEN 'confirmed' END AS status,
        CAST(NULL AS VARCHAR) AS delivery_id, CAST(NULL AS VARCHAR) AS carrier,
        CAST(NULL AS TIMESTAMP) AS estimated_delivery, CAST(NULL AS TIMESTAMP) AS actual_delivery
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
              CAST(round(value * 100) AS BIGINT) AS v FROM events)""",
        (),
    ),
    "click_ev": ("SELECT * FROM activity_ev WHERE event_type = 'click'", ("activity_ev",)),
    "cart_ev": ("SELECT * FROM activity_ev WHERE event_type = 'cart'", ("activity_ev",)),
    "all_ev": (
        "SELECT * FROM order_ev UNION ALL SELECT * FROM delivery_ev UNION ALL SELECT * FROM activity_ev",
        ("order_ev", "delivery_ev", "activity_ev"),
    ),
    # what the damaged raw feed (see scans.rough_events) looks like once normalised
    "rough_ev": (
        """SELECT event_id, event_type,
        CASE WHEN quantity = 7 THEN NULL ELSE event_timestamp END AS event_timestamp,
        ingestion_timestamp, CASE WHEN quantity = 13 THEN NULL ELSE customer_id END AS customer_id,
        * EXCLUDE (event_id, event_type, event_timestamp, ingestion_timestamp, customer_id)
        FROM all_ev""",
        ("all_ev",),
    ),
    "clean_ev": (
        f"""SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY {TIE_BREAK}) AS rn
        FROM rough_ev WHERE event_timestamp IS NOT NULL AND customer_id IS NOT NULL) WHERE rn = 1""",
        ("rough_ev",),
    ),
    "dcust": (
        """SELECT c_custkey AS customer_sk, CAST(c_custkey AS VARCHAR) AS customer_id,
        c_name AS name, c_mktsegment AS segment FROM customer""",
        (),
    ),
    "dprod": (
        """SELECT p_partkey AS product_sk, CAST(p_partkey AS VARCHAR) AS product_id,
        p_name AS name, p_type AS category_id, p_brand AS brand,
        CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents, p_size AS stock_quantity
        FROM part""",
        (),
    ),
    "dcat": (
        """SELECT DISTINCT p_type AS category_id,
        upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS name FROM part""",
        (),
    ),
}


def with_ctes(body: str, *names: str) -> str:
    """Prefix a query with the named CTEs and all they depend on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in CTES:
            return
        for parent in CTES[name][1]:
            visit(parent)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    head = ",\n".join(f"{n} AS ({CTES[n][0]})" for n in ordered)
    return f"WITH {head}\n{body}"
