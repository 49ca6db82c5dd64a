"""Block lists over time: every capture is judged by the entries in force when it was fetched.

List changes are dated (add or remove, per pattern and category). They become validity intervals
[from, to); an interval ends at the next change of the same pattern and category. A pattern is a host
name and holds for its subdomains. Captures are first reduced to distinct pairs of host and day, so that
a hot host costs no more than the days it was fetched on; pairs and intervals then meet by an
equi-join on pattern and month with the day inside the interval, which spreads a pattern with a
long history. The verdicts go back to the captures by host and day.

Defined results: a url without a host (null, empty, malformed) is never blocked and has a null host; a null day
is never blocked; several changes of a pattern and category on one day: the last by action wins, "remove"
after "add"; repeated rows are judged alike and all kept; empty tables give empty results or nothing
blocked. Other columns are kept; input columns with the names of ours are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripecast.llm import text

OPEN_END = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host of a url, without user, port and trailing dot; null if there is none."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.lower(F.regexp_replace(raw, r"\.+$", ""))
    return F.when(host != "", host)


def suffixes(host: Column) -> Column:
    """The host itself and its parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(changes: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to) from changes (pattern, category, action, changed_on)."""
    text.require(changes, "pattern", "category", "action", "changed_on")
    clean = changes.select(
        F.lower("pattern").alias("pattern"), "category", F.lower("action").alias("action"),
        F.col("changed_on").cast("date").alias("changed_on")).filter(
            "pattern IS NOT NULL AND changed_on IS NOT NULL AND action IN ('add', 'remove')")
    daily = clean.groupBy("pattern", "category", "changed_on").agg(F.max("action").alias("action"))
    order = W.partitionBy("pattern", "category").orderBy("changed_on")
    until = daily.withColumn("valid_to", F.coalesce(F.lead("changed_on").over(order), F.lit(OPEN_END).cast("date")))
    return until.filter("action = 'add'").select("pattern", "category", F.col("changed_on").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, changes: DataFrame, url: str = "url", fetched_on: str = "fetched_on") -> DataFrame:
    """Captures with host, blocked, categories (sorted), pattern (longest in force) and listed_on (its latest entry)."""
    text.require(captures, url, fetched_on)
    own = ("host", "blocked", "categories", "pattern", "listed_on")
    rows = captures.drop(*(c for c in own if c not in (url, fetched_on))).withColumns(
        {"host": host_of(F.col(url)), fetched_on: F.col(fetched_on).cast("date")})
    days = rows.select("host", F.col(fetched_on).alias("day")).filter("host IS NOT NULL AND day IS NOT NULL").distinct()
    asked = days.withColumns({"pattern": F.explode(suffixes(F.col("host"))), "month": F.trunc("day", "month")})
    # Months of an interval, no further than captures reach: one row of bounds.
    reach = days.agg(F.max("day").alias("last_day"), F.min("day").alias("first_day"))
    spans = intervals(changes).join(F.broadcast(reach)).filter("valid_from <= last_day AND valid_to > first_day")
    monthly = spans.withColumn("month", F.explode(F.sequence(
        F.trunc(F.greatest("valid_from", "first_day"), "month"),
        F.trunc(F.least("valid_to", "last_day"), "month"), F.expr("INTERVAL 1 MONTH")))).drop("first_day", "last_day")
    hits = asked.join(monthly, ["pattern", "month"]).filter("valid_from <= day AND day < valid_to")
    verdicts = hits.groupBy("host", "day").agg(
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        F.max(F.struct(F.length("pattern").alias("n"), "pattern", "valid_from")).alias("best"),
    ).select(F.col("host"), F.col("day").alias(fetched_on), "categories",
             F.col("best.pattern").alias("pattern"), F.col("best.valid_from").alias("listed_on"))
    return rows.join(verdicts, ["host", fetched_on], "left").withColumn("blocked", F.col("pattern").isNotNull()).select(
        *(c for c in rows.columns if c != "host"), "host", "blocked", "categories", "pattern", "listed_on")
