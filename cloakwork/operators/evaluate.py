"""Evaluation of predicted spans against gold ones, per text and summed.

cases have id, text, gold and preds (arrays of struct<start,end,label,...>) and
tags. What concerns one text is computed in its row; sums are grouped by label,
tag or threshold, with partial aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloakwork.functions.fixed import LABEL_CLASSES
from cloakwork.functions.positions import let, running_max
from cloakwork.functions.validators import text_key, wilson
from cloakwork.operators.tables import free_name


def meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def key(s: Column) -> Column:
    return F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["label"].alias("label"))


def in_scope(gold: Column, tiers: list[int] | None) -> Column:
    return gold if tiers is None else F.filter(gold, lambda g: F.coalesce(g["tier"], F.lit(1)).isin(*tiers))


def within_scope(preds: Column, gold: Column, tiers: list[int] | None) -> Column:
    """Predictions that don't sit on gold of another tier."""
    if tiers is None:
        return preds
    return F.filter(preds, lambda p: ~F.exists(gold, lambda g: ~F.coalesce(g["tier"], F.lit(1)).isin(*tiers) & meets(p, g)))


#: Pairs of predictions and gold spans of a text up to which these are compared as they are, not by islands.
FEW = 1024


def greedy_matches(preds: Column, gold: Column, need_label: bool) -> Column:
    """How many predictions, in order, find a gold span that is still free, the first that they meet. Of many spans only those of an island, which
    meet directly or by others between them, are compared."""

    def of_few(p: Column, g: Column) -> Column:
        start = F.struct(F.sequence(F.lit(0), F.size(g) - 1).alias("free"), F.lit(0).alias("tp"))
        start = F.when(F.size(g) > 0, start).otherwise(F.struct(F.array().cast("array<int>").alias("free"), F.lit(0).alias("tp")))

        def step(acc: Column, x: Column) -> Column:
            fits = lambda i: meets(x, F.get(g, i)) & ((x["label"] == F.get(g, i)["label"]) if need_label else F.lit(True))
            first = F.try_element_at(F.filter(acc["free"], fits), F.lit(1))
            return let(first, lambda f: F.when(f.isNull(), acc).otherwise(F.struct(F.filter(acc["free"], lambda i: i != f).alias("free"), (acc["tp"] + 1).alias("tp"))))

        return F.aggregate(p, start, step, lambda acc: acc["tp"])

    def of_island(spans: Column) -> Column:
        ordered = lambda x: F.struct(*[x[c].alias(c) for c in ("pos", "start", "end", "label")])
        own = lambda pred: F.array_sort(F.transform(F.filter(spans, lambda x: x["pred"] == pred), ordered))
        return let(F.struct(own(True).alias("p"), own(False).alias("g")), lambda s: of_few(s["p"], s["g"]))

    def of_many(p: Column, g: Column) -> Column:
        row = lambda pred: lambda x, i: F.struct(*[x[c].cast("int").alias(c) for c in ("start", "end")], x["label"].alias("label"), F.lit(pred).alias("pred"), i.alias("pos"))
        both = F.array_sort(F.concat(F.transform(p, row(True)), F.transform(g, row(False))))
        reached = let(both, lambda s: F.struct(s.alias("s"), running_max(F.transform(s, lambda x: x["end"])).alias("reach")))
        begins = lambda t: F.filter(F.sequence(F.lit(0), F.size(t["s"]) - 1), lambda i: (i == 0) | (F.get(t["s"], i)["start"] >= F.get(t["reach"], i - 1)))
        cut = lambda s, at: F.transform(at, lambda a, k: of_island(F.slice(s, a + 1, F.coalesce(F.get(at, k + 1), F.size(s)) - a)))
        counts = let(reached, lambda t: let(begins(t), lambda at: cut(t["s"], at)))
        return F.aggregate(counts, F.lit(0), lambda a, n: a + n)

    few = lambda s: F.size(s["p"]).cast("long") * F.size(s["g"]) <= FEW
    return let(F.struct(preds.alias("p"), gold.alias("g")), lambda s: F.when(few(s), of_few(s["p"], s["g"])).otherwise(of_many(s["p"], s["g"])))


BLOCK = 1 << 16


def islands(spans: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """spans (key, start, end, ...) with island: spans of a key that meet, directly or by others between them, have the same one.

    Spans lie in blocks of a text by their start, so that a text with most of the spans is many tasks' work: what a block has to know of those
    before it, how far they reach and where the last island began, is one row a block. Spans that only share a start may share an island.
    """
    own = {x: free_name(spans, x) for x in ("block", "reach", "before", "begin", "first")}
    b, reach, before, begin, first = own.values()
    cut = spans.withColumn(b, F.floor(F.col("start") / block).cast("long"))
    inside = W.partitionBy(key, b).orderBy("start", "end")
    earlier = W.partitionBy(key).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    reaches = cut.groupBy(key, b).agg(F.max("end").alias(reach)).withColumn(before, F.max(reach).over(earlier)).drop(reach)
    led = F.greatest(F.max("end").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.col(before))
    marked = cut.join(reaches, [key, b]).withColumn(begin, F.when(led.isNull() | (F.col("start") >= led), F.col("start")))
    begins = marked.groupBy(key, b).agg(F.max(begin).alias(first)).withColumn(first, F.max(first).over(earlier))
    # spans of one start come in any order here, so each takes what any of them begins
    so_far = W.partitionBy(key, b).orderBy("start").rangeBetween(W.unboundedPreceding, W.currentRow)
    at = F.coalesce(F.max(begin).over(so_far), F.col(first))
    return marked.join(begins, [key, b]).withColumn("island", at).drop(*own.values())


def totals_of_spans(gold: DataFrame, preds: DataFrame, key: str) -> DataFrame:
    """totals() of spans as rows: gold (key, start, end, label) and preds (key, start, end, label, pos: their order). A prediction can only
    take gold of its own island, so each island is matched by itself, whatever the number of spans of a text."""
    columns = [F.col(key), *[F.col(c).cast("int").alias(c) for c in ("start", "end")], F.col("label")]
    both = gold.select(*columns, F.lit(None).cast("long").alias("pos"), F.lit(False).alias("pred")).unionByName(preds.select(*columns, F.col("pos").cast("long").alias("pos"), F.lit(True).alias("pred")))
    span = F.struct("start", "end", "label")
    of = lambda pred, order: F.transform(F.array_sort(F.collect_list(F.when(F.col("pred") == pred, F.struct(*order, span.alias("s"))))), lambda x: x["s"])
    one = islands(both, key).groupBy(key, "island").agg(of(True, ["pos"]).alias("p"), of(False, ["start", "end", "label"]).alias("g"))
    p, g = F.array_distinct("p"), F.array_distinct("g")
    return totals(
        one.select(
            F.array_intersect(p, g).alias("strict_hits"), F.array_except(p, g).alias("strict_extra"), F.array_except(g, p).alias("strict_missed"), F.size("p").alias("n_preds"), F.size("g").alias("n_gold"),
            greedy_matches(F.col("p"), F.col("g"), True).alias("overlap_tp"), greedy_matches(F.col("p"), F.col("g"), False).alias("agnostic_tp"),
        )
    )


def covered(gold: Column, preds: Column) -> Column:
    """Characters of a gold span that predictions cover; overlapping predictions count once."""
    cut = F.filter(preds, lambda p: meets(p, gold))
    parts = F.array_sort(F.transform(cut, lambda p: F.struct(F.greatest(p["start"], gold["start"]).alias("a"), F.least(p["end"], gold["end"]).alias("b"))))
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["reach"], x["b"]).alias("reach"), (acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["reach"], x["a"]))).alias("n"))
    return F.aggregate(parts, zero, step, lambda acc: acc["n"])


def scored(cases: DataFrame, tiers: list[int] | None = None) -> DataFrame:
    """cases with tp, fp and fn of three modes, and leaks: array<struct<label,chars,hit>> of the gold in scope."""
    c = cases.withColumns({"_gold": in_scope(F.col("gold"), tiers), "_preds": within_scope(F.col("preds"), F.col("gold"), tiers)})
    p, g = F.array_distinct(F.transform("_preds", key)), F.array_distinct(F.transform("_gold", key))
    c = c.withColumns({"_p": p, "_g": g})
    n_p, n_g = F.size("_preds"), F.size("_gold")
    c = c.withColumns(
        {
            "strict_hits": F.array_intersect("_p", "_g"), "strict_extra": F.array_except("_p", "_g"), "strict_missed": F.array_except("_g", "_p"),
            "overlap_tp": greedy_matches(F.col("_preds"), F.col("_gold"), True), "agnostic_tp": greedy_matches(F.col("_preds"), F.col("_gold"), False),
            "n_preds": n_p, "n_gold": n_g, "out_of_scope": F.size("gold") - n_g,
            "leaks": let(F.col("preds"), lambda ps: F.transform("_gold", lambda x: F.struct(x["label"].alias("label"), (x["end"] - x["start"]).alias("chars"), covered(x, ps).alias("hit")))),
        }
    )
    return c.drop("_gold", "_preds", "_p", "_g")


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def totals(s: DataFrame) -> DataFrame:
    """mode, tp, fp, fn, precision, recall, f1 of the three modes."""
    modes = F.array(
        F.struct(F.lit("strict").alias("mode"), F.size("strict_hits").alias("tp"), F.size("strict_extra").alias("fp"), F.size("strict_missed").alias("fn")),
        *[F.struct(F.lit(m).alias("mode"), F.col(t).alias("tp"), (F.col("n_preds") - F.col(t)).alias("fp"), (F.col("n_gold") - F.col(t)).alias("fn")) for m, t in (("overlap", "overlap_tp"), ("type_agnostic", "agnostic_tp"))],
    )
    out = s.select(F.explode(modes).alias("m")).groupBy("m.mode").agg(*[F.sum(f"m.{c}").alias(c) for c in ("tp", "fp", "fn")])
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select("mode", "tp", "fp", "fn", F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"), F.bround(f, 4).alias("f1"))


def per_label(s: DataFrame) -> DataFrame:
    """label, tp, fp, fn and strict precision, recall, F1."""
    tell = lambda c, kind: F.transform(c, lambda x: F.struct(x["label"].alias("label"), F.lit(kind).alias("kind")))
    rows = s.select(F.explode(F.concat(tell("strict_hits", "tp"), tell("strict_extra", "fp"), tell("strict_missed", "fn"))).alias("x"))
    out = rows.groupBy("x.label").agg(*[F.count_if(F.col("x.kind") == k).alias(k) for k in ("tp", "fp", "fn")])
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select("label", "tp", "fp", "fn", F.bround(p, 3).alias("strict_p"), F.bround(r, 3).alias("strict_r"), F.bround(f, 3).alias("strict_f1"))


def leak_recall(s: DataFrame, by: str | None = None) -> DataFrame:
    """Character recall with its Wilson interval: by 'label', by 'tag', or over all."""
    rows = s.select(F.explode("leaks").alias("l"), *(["tags"] if by == "tag" else []))
    keys = []
    if by == "label":
        rows, keys = rows.withColumn("label", F.col("l.label")), ["label"]
    elif by == "tag":
        rows, keys = rows.withColumn("tag", F.explode("tags")), ["tag"]
    hit, n = F.col("l.hit"), F.col("l.chars")
    out = rows.groupBy(*keys).agg(
        F.sum(n).alias("gold_chars"), F.sum(hit).alias("covered_chars"), F.count("*").alias("spans"), F.count_if(hit == 0).alias("fully_missed"),
        F.count_if((hit > 0) & (hit < n)).alias("partial"),
    )
    ci = wilson(F.col("covered_chars"), F.col("gold_chars"))
    return out.select(
        *keys, "gold_chars", "covered_chars", "spans", "fully_missed", "partial", F.bround(F.try_divide("covered_chars", "gold_chars"), 4).alias("char_recall"),
        F.bround(ci["low"], 3).alias("low"), F.bround(ci["high"], 3).alias("high"),
    )


def benign(s: DataFrame) -> DataFrame:
    """Texts without any gold: how many have a prediction."""
    free = s.where(F.size("gold") == 0)
    out = free.agg(F.count("*").alias("cases"), F.count_if(F.size("preds") > 0).alias("cases_with_fp"), F.coalesce(F.sum(F.size("preds")), F.lit(0)).alias("fp_spans"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    return out.withColumn("fp_case_rate", F.bround(F.try_divide("cases_with_fp", "cases"), 4))


def overlap_classes(s: DataFrame) -> DataFrame:
    """label, tp, nested, mism, fp: a prediction on gold of its label, inside other gold, across other gold, or on none."""
    rows = s.select(F.explode("preds").alias("p"), "gold")
    on = lambda test: F.exists("gold", lambda g: meets(F.col("p"), g) & test(g))
    p = F.col("p")
    kind = (
        F.when(on(lambda g: g["label"] == p["label"]), "tp")
        .when(on(lambda g: (g["start"] <= p["start"]) & (g["end"] >= p["end"])), "nested")
        .when(on(lambda g: F.lit(True)), "mism")
        .otherwise("fp")
    )
    out = rows.select(F.col("p.label").alias("label"), kind.alias("kind")).groupBy("label")
    return out.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "nested", "mism", "fp")])


def verdict(recall: Column, precision: Column, n: Column) -> Column:
    return F.when(n < 20, "FEW SAMPLES").when(recall < 0.95, "WEAK").when(precision < 0.70, "NOISY").otherwise("ok")


def threshold_sweep(cases: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, fn (strict) with the predictions of at least that score: each text once, its thresholds in an array."""
    t = F.array(*[F.lit(float(x)) for x in thresholds])

    def at(x: Column) -> Column:
        p = F.array_distinct(F.transform(F.filter("preds", lambda s: s["score"] >= x), key))
        g = F.array_distinct(F.transform("gold", key))
        return F.struct(x.alias("threshold"), F.size(F.array_intersect(p, g)).alias("tp"), F.size(F.array_except(p, g)).alias("fp"), F.size(F.array_except(g, p)).alias("fn"))

    rows = cases.select(F.explode(F.transform(t, at)).alias("r"))
    out = rows.groupBy("r.threshold").agg(*[F.sum(f"r.{c}").alias(c) for c in ("tp", "fp", "fn")])
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select("threshold", "tp", "fp", "fn", F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"), F.bround(f, 4).alias("f1"))


def recommended(sweep: DataFrame, least_recall: float = 0.95, step: float = 0.05) -> DataFrame:
    """The highest threshold that reaches the recall, one step lower; or the lowest one, marked unmet."""
    good = F.max(F.when(F.col("recall") >= least_recall, F.col("threshold")))
    out = sweep.agg(good.alias("best"), F.min("threshold").alias("low"))
    return out.select(F.round(F.coalesce(F.greatest(F.col("best") - step, F.col("low")), F.col("low")), 4).alias("threshold"), F.col("best").isNotNull().alias("met"))


def nearest_rank(values: Column, q: float) -> Column:
    """sorted[min(n - 1, floor(q n))] of an array: not interpolated."""
    s = F.sort_array(values)
    return F.get(s, F.least(F.size(s) - 1, F.floor(F.lit(q) * F.size(s)).cast("int")))


def resampled(cases: DataFrame, id_col: str, hit: str, total: str, by: list[str] | None = None, resamples: int = 1000, seed: int = 7) -> DataFrame:
    """i, r: sum(hit) / sum(total) of each resample (of each group): Poisson weights from a digest of (id, resample), so each case is
    read once and only sums are shuffled."""
    digest = lambda i: F.md5(F.concat_ws(":", F.col(id_col).cast("string"), i.cast("string"), F.lit(str(seed))))
    u = lambda i: F.conv(F.substring(digest(i), 1, 8), 16, 10).cast("double") / 4294967296.0
    cuts = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940581]
    weight = lambda i: let(u(i), lambda x: sum(((x >= c).cast("int") for c in cuts), F.lit(0)))
    keys = by or []
    rows = cases.select(*keys, hit, total, F.explode(F.transform(F.sequence(F.lit(1), F.lit(resamples)), lambda i: F.struct(i.alias("i"), weight(i).alias("w")))).alias("x"))
    return rows.groupBy(*keys, "x.i").agg(F.try_divide(F.sum(F.col("x.w") * F.col(hit)), F.sum(F.col("x.w") * F.col(total))).alias("r"))


def bootstrap(cases: DataFrame, id_col: str, hit: str, total: str, resamples: int = 1000, seed: int = 7) -> DataFrame:
    """2.5 and 97.5 % points of sum(hit) / sum(total) under resampling."""
    each = resampled(cases, id_col, hit, total, None, resamples, seed)
    return each.agg(F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high"))


def compare_reports(before: DataFrame, after: DataFrame) -> DataFrame:
    """label, recall and precision of two reports, with a note for changes beyond 0.02 and 0.05."""
    a = before.select("label", F.col("recall").alias("recall_before"), F.col("precision").alias("precision_before"))
    b = after.select("label", F.col("recall").alias("recall_after"), F.col("precision").alias("precision_after"))
    j = a.join(b, "label", "full")
    d_r, d_p = F.col("recall_after") - F.col("recall_before"), F.col("precision_after") - F.col("precision_before")
    note = F.when(F.col("recall_before").isNull(), "new").when(F.col("recall_after").isNull(), "gone").when(d_r < -0.02, "recall fell").when(d_p < -0.05, "precision fell").otherwise("")
    return j.withColumn("note", note)


def label_class(label: Column) -> Column:
    """The class of a label in lower case, '_' and '-' as blanks; a label of none is a class of its own."""
    plain = F.lower(F.translate(label, "_-", "  "))
    return F.coalesce(*[F.when(plain.isin(*members), F.concat(F.lit("class:"), F.lit(name))) for name, members in LABEL_CLASSES.items()], plain)


def class_totals(cases: DataFrame, by: list[str] | None = None, least_precision: float = 0.85, least_recall: float = 0.80) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and passed, of all cases or by columns of theirs: a prediction takes the first free gold span
    that it meets and that has a label of its class."""
    classed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["end"], label_class(s["label"]).alias("label")))
    tp = greedy_matches(classed(F.col("preds")), classed(F.col("gold")), True)
    one = cases.select(*(by or []), tp.alias("tp"), F.size("preds").alias("n_preds"), F.size("gold").alias("n_gold"))
    sums = one.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "n_preds", "n_gold")])
    sums = sums.select(*(by or []), "tp", (F.col("n_preds") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select("*", F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"), F.bround(f, 4).alias("f1"), ((p >= least_precision) & (r >= least_recall)).alias("passed"))


def best_model(table: DataFrame, models: list[str], combined: str, slack: float = 0.01) -> DataFrame:
    """table with best, the first of the models' columns that holds the highest F1, and starred: combined comes within slack of the others."""
    f1 = {m: F.coalesce(F.col(m), F.lit(0.0)) for m in models}
    top = F.greatest(*f1.values())
    others = F.greatest(*[f1[m] for m in models if m != combined], F.lit(0.0))
    best = F.coalesce(*[F.when(f1[m] == top, m) for m in models])
    return table.withColumns({"best": best, "starred": (f1[combined] >= others - slack) & (f1[combined] > 0)})


# ---- from predictions of a model to a report
def above_floor(preds: Column, floors: dict[str, float], default: float = 0.3) -> Column:
    """Predictions of at least their label's floor; '*' names the floor of labels that aren't listed."""
    table = F.create_map(*[F.lit(x) for k, v in floors.items() for x in (k, float(v))]) if floors else None
    other = F.lit(float(floors.get("*", default)))
    floor = (lambda p: F.coalesce(F.try_element_at(table, p["label"]), other)) if table is not None else (lambda p: other)
    return F.filter(preds, lambda p: p["score"] >= floor(p))


def with_predictions(cases: DataFrame, preds: DataFrame) -> DataFrame:
    """cases with the predictions of a table (key, preds) that names texts by their digest; texts without any have none. Spans that
    don't lie in their text are left out, and scores are held between 0 and 1."""
    n = F.length("text")
    inside = F.filter("preds", lambda p: (p["start"] >= 0) & (p["start"] < p["end"]) & (p["end"] <= n))
    held = F.transform(inside, lambda p: p.withField("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p["score"]))))
    keyed = preds.select(F.col("key").alias("_key"), F.col("preds"))
    out = cases.withColumn("_key", text_key(F.col("text"))).join(keyed, "_key", "left").drop("_key")
    return out.withColumn("preds", F.coalesce(held, F.slice(held, 1, 0), F.array().cast(preds.schema["preds"].dataType)))


def latency(timed: DataFrame, ms: str = "ms", chars: str = "chars") -> DataFrame:
    """p50, p95, max and ms_per_kb of a table of times: nearest ranks from the counts of distinct values, so nothing is gathered."""
    counts = timed.where(F.col(ms).isNotNull()).groupBy(F.col(ms).alias("v")).agg(F.count("*").alias("n"), F.sum(F.col(chars)).alias("chars"))
    total = counts.agg(F.sum("n").alias("total"), F.max("v").alias("max"), F.sum(F.col("v") * F.col("n")).alias("all_ms"), F.sum("chars").alias("all_chars"))
    # running counts by ranges of values: every range's sum first, then within it
    ranged = counts.withColumn("part", F.floor(F.log2(F.greatest(F.col("v"), F.lit(1e-6))) * 4))
    before = ranged.groupBy("part").agg(F.sum("n").alias("m")).withColumn("below", F.sum("m").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).drop("m")
    upto = ranged.join(before, "part").withColumn("to", F.coalesce("below", F.lit(0)) + F.sum("n").over(W.partitionBy("part").orderBy("v")))
    rank = lambda q: F.least(F.col("total") - 1, F.floor(F.lit(q) * F.col("total")))
    at = lambda q: F.min(F.when(F.col("to") > rank(q), F.col("v")))
    out = upto.crossJoin(F.broadcast(total)).groupBy("total", "max", "all_ms", "all_chars").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    return out.select(F.bround("p50", 3).alias("p50"), F.bround("p95", 3).alias("p95"), F.bround("max", 3).alias("max"), F.bround(F.try_divide(F.col("all_ms"), F.col("all_chars") / 1000), 3).alias("ms_per_kb"))


def report(s: DataFrame, timed: DataFrame | None = None) -> DataFrame:
    """section, key, metric, value: totals by mode, leak recall over all, by label and by tag with its interval, clean texts, gold out of
    scope, and latency where times are given."""

    def rows(df: DataFrame, section: str, key: str | None = None) -> DataFrame:
        metrics = [c for c in df.columns if c != key]
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        name = F.col(key) if key else F.lit("")
        return df.select(F.lit(section).alias("section"), name.alias("key"), F.explode(pairs).alias("p")).select("section", "key", "p.metric", "p.value")

    scope = s.agg(F.coalesce(F.sum("out_of_scope"), F.lit(0)).alias("out_of_scope_gold_spans"))
    parts = [
        rows(totals(s), "mode", "mode"), rows(leak_recall(s), "leak"), rows(per_label(s), "label", "label"), rows(leak_recall(s, "label"), "label_leak", "label"), rows(leak_recall(s, "tag"), "tag_leak", "tag"),
        rows(benign(s), "benign"), rows(scope, "scope"),
    ]
    if timed is not None:
        parts.append(rows(latency(timed), "latency"))
    return reduce(DataFrame.unionByName, parts)


#: Rows of a file of examples, in a fixed order.
MAX_EXAMPLES = 500


def examples(s: DataFrame, id_col: str, k: int = MAX_EXAMPLES) -> tuple[DataFrame, DataFrame]:
    """The first k gold spans that aren't covered whole, and the first k predictions on texts without gold: reports for people to read."""
    cut = lambda a, b: F.substring(F.col("text"), F.greatest(a, F.lit(0)) + 1, b - F.greatest(a, F.lit(0)))
    gold = s.select(id_col, "text", F.explode(F.arrays_zip("gold", "leaks")).alias("z")).where("z.leaks.hit < z.leaks.chars")
    g = F.col("z.gold")
    misses = gold.select(F.col(id_col).alias("id"), g["label"].alias("label"), g["start"].alias("start"), cut(g["start"], g["end"]).alias("text"), F.col("z.leaks.hit").alias("covered_chars"), F.col("z.leaks.chars").alias("of"), cut(g["start"] - 30, g["end"] + 30).alias("context"))
    p = F.col("p")
    wrong = s.where(F.size("gold") == 0).select(id_col, "text", F.explode("preds").alias("p")).select(F.col(id_col).alias("id"), p["label"].alias("label"), p["start"].alias("start"), cut(p["start"], p["end"]).alias("text"))
    return misses.orderBy("id", "start", "label").limit(k), wrong.orderBy("id", "start", "label").limit(k)


def write_reports(s: DataFrame, id_col: str, folder: str, timed: DataFrame | None = None) -> None:
    """report, overlap, misses and false_positives as JSON lines in a folder."""
    misses, wrong = examples(s, id_col)
    for name, df in {"report": report(s, timed), "overlap": overlap_classes(s), "misses": misses, "false_positives": wrong}.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def markdown(table: DataFrame, title: str, k: int = MAX_EXAMPLES) -> str:
    """A small table for people to read; rows in the order of its first columns."""
    names = table.columns
    say = lambda v: "" if v is None else f"{v:g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(names) + " |", "|" + "-|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(map(say, r)) + " |" for r in table.orderBy(*names).limit(k).collect()])


def kill_test(models: DataFrame, id_col: str, label: str, least_f1: float) -> DataFrame:
    """model, f1, low, high, passes: each model's F1 of one label (cases with a column model), with an interval by resampling cases."""
    own = lambda spans: F.filter(spans, lambda x: x["label"] == label)
    tp = greedy_matches(own("preds"), own("gold"), True)
    counts = models.select("model", id_col, tp.alias("tp"), (F.size(own("preds")) + F.size(own("gold"))).alias("n"))
    whole = counts.groupBy("model").agg(F.coalesce(F.try_divide(2 * F.sum("tp"), F.sum("n")), F.lit(0.0)).alias("f1"))
    draws = resampled(counts.withColumn("hit", 2 * F.col("tp")), id_col, "hit", "n", ["model"]).groupBy("model").agg(F.bround(F.percentile("r", 0.025), 3).alias("low"), F.bround(F.percentile("r", 0.975), 3).alias("high"))
    return whole.join(draws, "model", "left").select("model", F.bround("f1", 3).alias("f1"), "low", "high", (F.bround("f1", 3) >= least_f1).alias("passes"))


def combined(cases: DataFrame, members: dict[str, str]) -> DataFrame:
    """cases of which preds are those of several columns together: {column: name of its source}."""
    return cases.withColumn("preds", F.array_distinct(F.concat(*[F.transform(c, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["label"].alias("label"), p["score"].alias("score"))) for c in members])))
