"""Resampling a corpus towards a target: hashed n-gram features, importance weights, a draw without replacement.

Texts are cut at their newlines, which separate words, into lines. A line is its
words joined by one space, so lines that differ in case, signs or blanks only are one.
The features of each distinct line (runs of 1 to n words within it, as buckets) are
counted once: times the line's occurrences they are the corpus counts, and summed as
gains they are the line's part of each document that holds it. Runs over the end of a
line are no line's: they are counted apart, for each document, from the ends of its
lines (none for n = 1).

A bucket's gain is floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) with the counts s and t of
the bucket in corpus and target, S and T of all features and B buckets. A document's
weight is the floored mean gain of its features, and its score adds Gumbel noise from a
hash of its id: the highest scores are a draw by weight without replacement, which a
task that runs again repeats.

Scale: equal lines are combined before the shuffle; what a line is worth goes back to
its documents by a join on digests, whose heaviest lines are sent to the rows instead. The gains are as many as the buckets, and are sent. Ranks come from the
count of each score in two levels and the order by id within one score: nothing is
sorted as a whole.

Defined results
* Null and empty texts have no words: n_features 0, weight 0, and a score of their own.
* A null id counts as the empty text in the hash, and comes last among ties.
* One row per input row; rows that share an id share noise, and are ranked one after the other.
* No target, or one without words, has T = 0: each gain is what the formula gives.
* Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.functions.positions import let
from cloakwork.llm.shared import discard, staged
from cloakwork.llm.skew import join_heavy
from cloakwork.operators.tables import spread

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What words don't hold: all of ASCII but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Scores are ranked in groups of so many neighbours.
NEAR = 256


def lines_of(text: Column) -> Column:
    """The lines that have words, each as its lower-case words joined by one space."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.transform(F.split(low, "\n"), lambda x: F.trim(F.regexp_replace(x, SEPARATORS, " "))), lambda x: x != "")


def spans(items: Column, k: int) -> Column:
    """The runs of k items of an array that has so many. items is a variable: the array is read for each run."""
    return F.transform(F.sequence(F.lit(1), F.size(items) - (k - 1)), lambda i: F.slice(items, i, k))


def runs(words: Column, n: int) -> Column:
    """All runs of 1 to n of the words, joined by one space; repeats stay."""
    none = F.array().cast("array<string>")

    def longer(w: Column, k: int) -> Column:
        return F.when(F.size(w) >= k, F.transform(spans(w, k), lambda s: F.array_join(s, " "))).otherwise(none)

    return words if n == 1 else let(words, lambda w: F.concat(w, *[longer(w, k) for k in range(2, n + 1)]))


def crossing(lines: Column, n: int) -> Column:
    """The runs of 2 to n words that lie in more than one line. Of a long line only the ends are looked at: the words between them are a gap."""
    none = F.array().cast("array<string>")

    def ends(line: Column, number: Column) -> Column:
        def cut(words: Column) -> Column:
            short = F.concat(F.slice(words, 1, n - 1), F.array(F.lit(None).cast("string")), F.slice(words, -(n - 1), n - 1))
            return F.transform(F.when(F.size(words) > 2 * (n - 1), short).otherwise(words), lambda w: F.struct(w.alias("w"), number.alias("line")))

        return let(F.split(line, " "), cut)

    def over(words: Column, k: int) -> Column:
        apart = F.filter(spans(words, k), lambda s: (s[0]["line"] != F.element_at(s, -1)["line"]) & ~F.exists(s, lambda x: x["w"].isNull()))
        joined = F.transform(apart, lambda s: F.array_join(F.transform(s, lambda x: x["w"]), " "))
        return F.when(F.size(words) >= k, joined).otherwise(none)

    return let(F.flatten(F.transform(lines, ends)), lambda words: F.concat(none, *[over(words, k) for k in range(2, n + 1)]))


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(F.encode(feature, "UTF-8")) % buckets).cast("int")


def line_table(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """digest, n (occurrences), features (buckets, repeats included) of each distinct line."""
    lines = texts.select(F.explode(lines_of(F.col("text"))).alias("line")).groupBy("line").agg(F.count("*").alias("n"))
    features = F.transform(runs(F.split("line", " "), n), lambda f: bucket(f, buckets))
    return lines.select(digest(F.col("line")).alias("digest"), "n", features.alias("features"))


def digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def part_table(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """row, doc_id, digest of each line of each text; and for each text one row without a digest, with its n_words and the buckets
    of its runs over the ends of lines."""
    held = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", lines_of(F.col("text")).alias("lines"))
    digests = F.concat(F.transform(F.coalesce("lines", F.array().cast("array<string>")), digest), F.array(F.lit(None).cast("binary")))
    if n == 1:  # a line's words are its features, and no run is over its end
        return held.select("row", "doc_id", F.explode(digests).alias("digest"))
    words = F.aggregate("lines", F.lit(0).cast("long"), lambda acc, x: acc + F.size(F.split(x, " ")))
    over = F.transform(crossing(F.col("lines"), n), lambda f: bucket(f, buckets))
    one = held.select("row", "doc_id", F.coalesce(words, F.lit(0)).alias("n_words"), over.alias("over"), digests.alias("digests"))
    own = [F.when(F.col("digest").isNull(), F.col(c)).alias(c) for c in ("n_words", "over")]
    return one.select("row", "doc_id", "n_words", "over", F.explode("digests").alias("digest")).select("row", "doc_id", "digest", *own)


def counts(lines: DataFrame, parts: DataFrame, n: int) -> DataFrame:
    """bucket, n: features of all texts. lines, parts: the tables of the texts."""
    found = lines.select("n", F.explode("features").alias("bucket")).groupBy("bucket").agg(F.sum("n").alias("n"))
    if n > 1:
        over = parts.select(F.explode("over").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
        found = found.unionByName(over).groupBy("bucket").agg(F.sum("n").alias("n"))
    return found


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain for every bucket that the corpus has."""
    all_s, all_t = (c.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for c in (corpus, target))
    s, t = F.col("s").cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    ratio = (t + 1) * F.lit(float(all_s + buckets)) / ((s + 1) * F.lit(float(all_t + buckets)))
    both = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000) -> DataFrame:
    """row, doc_id, n_words, n_features, weight of every row of docs (doc_id, text); target: text."""
    texts = spread(docs.select(F.col("doc_id").cast("long"), "text"))
    wanted = target.select(F.lit(0).cast("long").alias("doc_id"), "text")
    lines, parts = staged(line_table(texts, n, buckets), "lines"), staged(part_table(texts, n, buckets), "parts")
    corpus = staged(counts(lines, parts, n), "counts")
    worth = staged(gains(corpus, counts(line_table(wanted, n, buckets), part_table(wanted, n, buckets), n), buckets), "gains")
    gain = F.broadcast(worth)  # no more rows than buckets
    each = lines.select("digest", "n", F.size("features").alias("k"), F.explode("features").alias("bucket")).join(gain, "bucket")
    # the features of a line come from one row, so they are summed before the shuffle
    valued = staged(each.groupBy("digest").agg(F.max("n").alias("n"), F.max("k").cast("long").alias("k"), F.sum("gain").alias("gain")), "valued")
    met = join_heavy(parts.where("digest is not null").select("row", "doc_id", "digest"), valued, "digest", "n").select("row", "doc_id", "k", "gain")
    of_rows, nothing = parts.where("digest is null"), F.lit(0).cast("long")
    met = met.unionByName(of_rows.select("row", "doc_id", nothing.alias("k"), nothing.alias("gain")))
    if n > 1:
        over = of_rows.select("row", "doc_id", F.explode("over").alias("bucket")).join(gain, "bucket")
        met = met.unionByName(over.select("row", "doc_id", (nothing + 1).alias("k"), "gain"))
    summed = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("k").alias("n_features"), F.sum("gain").alias("gain"))
    weight = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (gain - pmod(gain, n_features)) div n_features END")
    out = summed.select("row", "doc_id", "n_features", weight.alias("weight"))
    out = out.withColumn("n_words", F.col("n_features")) if n == 1 else out.join(of_rows.select("row", "n_words"), "row")
    result = staged(out, "weights")
    discard(lines, parts, corpus, worth, valued)
    return result


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """scored (row, doc_id, score, can be drawn) with rank 1, 2, 3... for the highest percent of those that can be drawn."""
    can = scored.where("drawable")
    group = F.floor(F.col("score") / NEAR)
    by_score = staged(can.groupBy("score").agg(F.count("*").alias("n")), "scores")
    # the range of scores is bounded by the logarithms in them: some hundreds of groups, whatever the corpus
    by_group = by_score.groupBy(group.alias("near")).agg(F.sum("n").alias("group_n"))
    above = by_group.withColumn("above", F.sum("group_n").over(Window.orderBy(F.desc("near"))) - F.col("group_n"))
    within = F.sum("n").over(Window.partitionBy("near").orderBy(F.desc("score"))) - F.col("n")
    start = by_score.withColumn("near", group).join(F.broadcast(above.select("near", "above")), "near").select("score", (F.col("above") + within).alias("start"))
    take = by_score.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * percent // 100
    start = staged(start.where(F.col("start") < take), "starts")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    place = F.col("start") + F.row_number().over(order)
    drawn = can.join(start, "score").select("row", place.alias("rank")).where(F.col("rank") <= take)
    return scored.join(drawn, "row", "left")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, min_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null where a row isn't drawn."""
    w = weights(docs, target, n, buckets)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = w.select("row", "doc_id", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"), (F.col("n_words") >= min_words).alias("drawable"))
    return ranked(scored, percent).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
