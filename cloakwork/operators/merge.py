"""Merge: overlapping spans become disjoint ones, each with the strictest action of its members.

merge() works on the array in the row (no shuffle). merged_rows() is the same
sweep over one row a span, with windows, for spans that come from a table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloakwork.functions.positions import let
from cloakwork.operators.describing import quickly
from cloakwork.operators.policy import Policy

MERGED = "struct<start:int,end:int,label:string,action:int,score:double,evidence:int,sources:array<string>,labels:array<string>>"
_WORD = r"[\p{L}\p{N}_]"


def evidence(validated: Column, context: Column) -> Column:
    """2 validated, 1 context, 0 model."""
    return F.when(validated, 2).when(context, 1).otherwise(0)


def snapped(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Start and end widened to whole words where they cut through one."""
    left = F.length(F.regexp_extract(F.substring(text, F.lit(1), start), rf"{_WORD}+\z", 0))
    right = F.length(F.regexp_extract(F.substring(text, end + 1, F.length(text)), rf"^{_WORD}+", 0))
    first, last = F.substring(text, start + 1, F.lit(1)), F.substring(text, end, F.lit(1))
    return (
        (start - F.when(first.rlike(_WORD), left).otherwise(0)).cast("int"),
        (end + F.when(last.rlike(_WORD), right).otherwise(0)).cast("int"),
    )


@quickly
def merge(text: Column, spans: Column, policy: Policy = Policy(), snap: bool = True, min_scores: Mapping[str, float] | None = None) -> Column:
    """array<MERGED> in order, disjoint. Kept labels and unproved spans under their label's floor are left out before they can
    widen anything; touching spans stay apart. A span that ends after the text raises an error."""
    floors = {k.upper(): float(v) for k, v in (min_scores or {}).items()}

    def item(s: Column) -> Column:
        bad = F.raise_error(F.concat(F.lit("span exceeds text: "), s["end"].cast("string")))
        value = F.when(s["end"] > F.length(text), bad.cast("string")).otherwise(F.substring(text, s["start"] + 1, s["end"] - s["start"]))
        start, end = snapped(text, s["start"], s["end"]) if snap else (s["start"], s["end"])
        return F.struct(
            start.alias("start"), (-end).alias("back"), policy.rank_of(s["label"], value).alias("action"), evidence(s["validated"], s["context"]).alias("evidence"),
            (s["end"] - s["start"]).alias("size"), s["score"].alias("score"), s["label"].alias("label"), s["source"].alias("source"),
        )

    def counts(x: Column) -> Column:
        ok = x["action"] > 0
        if floors:
            table = F.create_map(*[F.lit(v) for kv in floors.items() for v in kv])
            ok = ok & ((x["evidence"] == 2) | (x["score"] >= F.coalesce(F.try_element_at(table, x["label"]), F.lit(0.0))))
        return ok

    ordered = F.array_sort(F.filter(F.transform(spans, item), counts))

    def clusters(items: Column) -> Column:
        """The start and end of each island: one pass over the sorted items."""
        none = F.array().cast("array<struct<start:int,end:int>>")

        def step(acc: Column, x: Column) -> Column:
            last = F.try_element_at(acc, F.lit(-1))
            joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], -x["back"]).alias("end"))))
            fresh = F.concat(acc, F.array(F.struct(x["start"].alias("start"), (-x["back"]).alias("end"))))
            return F.when((F.size(acc) > 0) & (x["start"] < last["end"]), joined).otherwise(fresh)

        return F.aggregate(items, none, step)

    def finish(c: Column, items: Column) -> Column:
        members = F.filter(items, lambda x: (x["start"] >= c["start"]) & (x["start"] < c["end"]))

        def settle(ms: Column) -> Column:
            best = F.array_max(
                F.transform(ms, lambda m: F.struct(m["action"].alias("action"), m["evidence"].alias("evidence"), m["size"].alias("size"), m["score"].alias("score"), m["label"].alias("label")))
            )
            return let(
                best,
                lambda b: F.struct(
                    c["start"].alias("start"), c["end"].alias("end"), b["label"].alias("label"), b["action"].alias("action"), b["score"].alias("score"), b["evidence"].alias("evidence"),
                    F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["source"]))).alias("sources"), F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))).alias("labels"),
                ),
            )

        return let(members, settle)

    return let(ordered, lambda items: F.transform(clusters(items), lambda c: finish(c, items)))


def merged_rows(spans: DataFrame, key: str) -> DataFrame:
    """The sweep over rows (key, start, end, label, score, evidence, source, action): gaps and islands by a running maximum."""
    order = W.partitionBy(key).orderBy("start", F.desc("end"))
    s = spans.where("action > 0").withColumn("_reach", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    s = s.withColumn("_island", F.sum(F.coalesce((F.col("start") >= F.col("_reach")).cast("int"), F.lit(1))).over(order.rowsBetween(W.unboundedPreceding, 0)))
    best = F.max(F.struct("action", "evidence", (F.col("end") - F.col("start")).alias("size"), "score", "label")).alias("b")
    out = s.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), best, F.sort_array(F.collect_set("source")).alias("sources"), F.sort_array(F.collect_set("label")).alias("labels"))
    return out.select(key, "start", "end", "b.label", "b.action", "b.score", "b.evidence", "sources", "labels")


def disjoint_longest(spans: Column) -> Column:
    """Longest first, then by start; a span stays if it meets none that stays. array<struct<start,end,...>>."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("k"), s["start"].alias("at"), s.alias("s"))))
    return _first_come(ordered, spans)


def disjoint_first(spans: Column) -> Column:
    """By start, then longest first; a span stays if it meets none that stays."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("k"), (s["start"] - s["end"]).alias("at"), s.alias("s"))))
    return _first_come(ordered, spans)


def _first_come(ordered: Column, spans: Column) -> Column:
    free = lambda kept, x: ~F.exists(kept, lambda k: (k["start"] < x["s"]["end"]) & (x["s"]["start"] < k["end"]))
    kept = F.aggregate(ordered, F.slice(spans, 1, 0), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x["s"]))).otherwise(acc))
    return F.array_sort(kept)
