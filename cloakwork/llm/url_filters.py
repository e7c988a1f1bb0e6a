"""URL filters: a temporal join of captures with dated block lists (native: DataFrame functions only).

A list is a log of dated entries: on a day, a pattern is added to a category or
removed from it. Entries of a pattern and category become validity intervals
[from, to) that end at its next entry. An as-of join evaluates every capture
against the intervals that hold at its fetch time, for each pattern that its URL
can match: the host and every parent domain, and the host with each leading part
of the path.

All joins are shuffled: both their sides grow with the captures or the lists.
Intervals are cut at month ends and joined on (pattern, month). A host with many
captures is thereby spread over months, and a capture meets the intervals of one
month, not a pattern's whole history. What the joins give is bounded: captures
are first reduced to distinct (pattern, day) pairs, so a pattern with a third of
all captures has one row a day.

Defined results
* One row per distinct (capture_id, url, fetched): blocked, n_active (entries that
  hold), pattern (the longest that holds, then the first by category), category.
* Hosts are lower case, without user, port and final dots. A null or unparsable
  URL, or a null time, matches nothing and isn't blocked.
* Of several entries of a pattern and category on a day, 'remove' wins. Repeating
  an entry changes nothing. An empty list blocks nothing.
* Columns besides those named are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cloakwork.llm.shared import staged

_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)(?::\d*)?([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dots; null where there is none."""
    h = F.rtrim(F.lower(F.regexp_extract(url, _URL, 1)), F.lit("."))
    return F.when(h != "", h)


def patterns(url: Column) -> Column:
    """What a list entry may name to match the URL: 'example.com' for a domain and its subdomains, 'example.com/a/' for a path below."""
    h = host(url)
    labels = F.split(h, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    steps = F.split(F.regexp_extract(url, _URL, 2), "/")
    paths = F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(h, F.array_join(F.slice(steps, 1, i), "/"), F.lit("/"))
    )
    whole = F.concat(h, F.regexp_extract(url, _URL, 2))
    # a path's last part is a page, or empty after a final slash: both forms can be named
    return F.when(h.isNotNull(), F.array_distinct(F.concat(parents, paths, F.array(whole))))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, category, valid_from, valid_to (null: still holds). entries: pattern, category, day, action ('add' or 'remove').

    A pattern's history isn't gathered in a task: its days follow each other within
    a month, and the last one of a month is followed by the first of the next month
    that has any, which a window over one row a month tells.
    """
    # one row a day before the windows
    daily = (
        entries.where("pattern is not null and category is not null and day is not null")
        .groupBy(F.lower("pattern").alias("pattern"), "category", F.col("day").cast("date").alias("valid_from"))
        .agg(F.max((F.col("action") == "remove").cast("int")).alias("removed"))
        .withColumn("month", F.trunc("valid_from", "month"))
    )
    within = W.partitionBy("pattern", "category", "month").orderBy("valid_from")
    months = daily.groupBy("pattern", "category", "month").agg(F.min("valid_from").alias("first"))
    following = months.withColumn("following", F.lead("first").over(W.partitionBy("pattern", "category").orderBy("month"))).drop("first")
    ended = daily.withColumn("next", F.lead("valid_from").over(within)).where("removed = 0")
    known = ended.where("next is not null").withColumn("valid_to", F.col("next"))
    last = ended.where("next is null").join(following.hint("merge"), ["pattern", "category", "month"]).withColumn("valid_to", F.col("following"))
    columns = ["pattern", "category", "valid_from", "valid_to"]
    return known.select(columns).unionByName(last.select(columns))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures: capture_id, url, fetched (timestamp or date)."""
    asked = staged(
        captures.select("capture_id", "url", "fetched").distinct().withColumn("day", F.to_date("fetched")).withColumn("patterns", patterns(F.col("url"))),
        "captures",
    )
    first, last = asked.agg(F.min("day"), F.max("day")).first()
    valid = intervals(entries)
    if first is None:
        months = valid.where("false").withColumn("month", F.col("valid_from"))
    else:
        begin = F.trunc(F.greatest("valid_from", F.lit(first)), "month")
        end = F.trunc(F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(last)), F.lit(last)), "month")
        months = valid.where((F.col("valid_from") <= F.lit(last)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(first)))).withColumn(
            "month", F.explode(F.when(begin <= end, F.sequence(begin, end, F.expr("interval 1 month"))))
        )
    pairs = asked.select(F.explode("patterns").alias("pattern"), "day").where("day is not null")
    days = pairs.distinct().withColumn("month", F.trunc("day", "month"))
    active = (
        days.hint("merge").join(months, ["pattern", "month"])
        .where("valid_from <= day and (valid_to is null or day < valid_to)")
        .groupBy("pattern", "day")
        .agg(F.count("*").alias("n"), F.min("category").alias("category"))
    )
    active = staged(active, "active")
    met = (
        asked.select("capture_id", "url", "fetched", "day", F.explode("patterns").alias("pattern"))
        .join(active.hint("merge"), ["pattern", "day"])
        .groupBy("capture_id", "url", "fetched")
        .agg(F.sum("n").alias("n_active"), F.max(F.struct(F.length("pattern").alias("l"), "pattern", "category")).alias("best"))
    )
    met = met.withColumnsRenamed({"capture_id": "_id", "url": "_url", "fetched": "_at"})
    same = F.col("capture_id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url")) & F.col("fetched").eqNullSafe(F.col("_at"))
    return asked.join(met.hint("merge"), same, "left").select(
        "capture_id", "url", "fetched", F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("best.pattern").alias("pattern"), F.col("best.category").alias("category"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """The captures of `pages`, which has no fetch time: 97 minutes from 2024-01-01 for each page_id, over and over within a year."""
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(pmod(page_id * 97, 366 * 1440) as int))")
    return pages.select(F.col("page_id").alias("capture_id"), "url", at.alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A block list drawn from `pages`: of every seventh page the host's parent domain, of every eleventh the host and first
    path part, added on the day of a rule over page_id and removed on another."""
    h = host(F.col("url"))
    some = pages.where("page_id % 7 = 0 or page_id % 11 = 0").select("page_id", h.alias("h"), F.regexp_extract("url", _URL, 2).alias("path"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * n, F.lit(366)).cast("int"))
    domains = some.where("page_id % 7 = 0").select(
        F.regexp_replace("h", r"^[^.]+\.(?=[^.]+\.[^.]+\.)", "").alias("pattern"), F.when(F.col("page_id") % 2 == 0, "ads").otherwise("malware").alias("category"), "page_id"
    )
    paths = some.where("page_id % 11 = 0").select(F.concat("h", F.regexp_extract("path", r"^(/[^/]*/?)", 1)).alias("pattern"), F.lit("adult").alias("category"), "page_id")
    both = domains.unionByName(paths).where("pattern is not null")
    added = both.select("pattern", "category", day(13).alias("day"), F.lit("add").alias("action"))
    removed = both.select("pattern", "category", day(29).alias("day"), F.lit("remove").alias("action"))
    return added.unionByName(removed)
