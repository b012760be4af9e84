"""URL filters as of the fetch time: dated list entries become validity intervals.

A list is a history of entries (domain, day, action, category). The next entry of a domain ends
the one before, so each entry holds for an interval; a removal leaves a gap. A capture is judged by
the entries that were active on its day, for its host and every parent domain; the most specific
one decides.

The as-of join is an equi-join on (domain, month): an interval is put into each month it touches, a
capture into its own. So a host with a third of all captures is spread over the months, a domain
with a long history meets a capture with the entries of one month only, and Spark can split a month
that is still large. Pages bring their id and URL only.

Defined cases. A null or hostless URL is not blocked. Entries without domain or day are ignored. Of
entries of one domain and day the last by sequence number counts. Captures without a day are not
blocked. Repeated captures are judged each on its own. Extra columns pass through in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and closing dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.rtrim(host, F.lit("."))
    return F.when(host != "", host)


def suffixes(host: Column) -> Column:
    """The host and its parent domains, down to two labels."""
    labels = F.split(host, r"\.", -1)
    count = F.greatest(F.size(labels) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def intervals(entries: DataFrame) -> DataFrame:
    """domain, category, valid_from and valid_to (exclusive, null if open) of each active entry.

    ``entries``: domain, day, seq (order within a day), action (``add`` or ``remove``), category.
    """
    dated = entries.where("domain is not null and day is not null")
    history = Window.partitionBy("domain").orderBy("day", "seq")
    df = dated.withColumn("valid_to", F.lead("day").over(history))
    df = df.where((F.col("action") == "add") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("day"))))
    return df.select("domain", "category", F.col("day").alias("valid_from"), "valid_to")


def as_of(captures: DataFrame, active: DataFrame) -> DataFrame:
    """``row`` (the capture), host, matched_domain, category, listed_from and blocked.

    ``captures`` has url and fetched_on (a date).
    """
    rows = captures.select(
        F.struct("*").alias("row"), host_of(F.col("url")).alias("host"), F.monotonically_increasing_id().alias("rid")
    )
    # an open interval reaches to the last month in which anything was fetched
    last = F.lit(captures.agg(F.max("fetched_on")).first()[0]).cast("date")
    spread = active.where(F.col("valid_from") <= last)
    until = F.least(F.coalesce(F.date_sub("valid_to", 1), last), last)
    spread = spread.withColumn("m", F.explode(F.sequence(month(F.col("valid_from")), month(until))))
    keyed = rows.withColumn("domain", F.explode_outer(suffixes(F.col("host")))).withColumn("m", month(F.col("row.fetched_on")))
    day = F.col("row.fetched_on")
    inside = (day >= F.col("valid_from")) & (F.col("valid_to").isNull() | (day < F.col("valid_to")))
    same = (keyed["domain"] == spread["domain"]) & (keyed["m"] == spread["m"])
    hit = F.struct(
        F.length(spread["domain"]).alias("size"), spread["domain"].alias("domain"), "category", F.col("valid_from").alias("since")
    )
    found = keyed.join(spread, same & inside, "left").select(
        "rid", "row", "host", F.when(spread["domain"].isNotNull(), hit).alias("hit")
    )
    # the few suffixes of one capture; first() of the row, which is the same in all of them
    df = found.groupBy("rid").agg(F.first("row").alias("row"), F.first("host").alias("host"), F.max("hit").alias("hit"))
    return df.select(
        "row",
        "host",
        F.col("hit.domain").alias("matched_domain"),
        F.col("hit.category").alias("category"),
        F.col("hit.since").alias("listed_from"),
        F.col("hit").isNotNull().alias("blocked"),
    )
