"""Operators on whole texts: prompt categories, leakage guards, windows, segments and re-identification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloakwork.functions import fixed
from cloakwork.functions.positions import let, matches, running_sum, splice, sums_before
from cloakwork.operators import nearest
from cloakwork.operators.tables import exploded


def signal_counts(text: Column) -> Column:
    """struct of the number of signals of each category that the text holds."""

    def counts(low: Column) -> Column:
        count = lambda ss: F.size(F.filter(F.array(*[F.lit(s) for s in ss]), lambda s: low.contains(s)))
        return F.struct(*[count(ss).alias(c) for c, ss in fixed.SIGNALS.items()])

    return let(F.lower(text), counts)


def prompt_category(text: Column) -> Column:
    """The category of most signals (ties in the order of the table), or general."""

    def best(n: Column) -> Column:
        most = F.greatest(*[n[c] for c in fixed.SIGNALS])
        out = F.when(most == 0, "general")
        for c in fixed.SIGNALS:
            out = out.when(n[c] == most, c)
        return out

    return let(signal_counts(text), best)


def leak_guard(texts: DataFrame, excluded: DataFrame, text_col: str = "text") -> DataFrame:
    """texts that equal no excluded text: an anti-join on a digest, so long texts aren't compared as keys."""
    gone = excluded.select(F.sha2(F.col(text_col), 256).alias("_d")).distinct()
    return texts.withColumn("_d", F.sha2(F.col(text_col), 256)).join(gone, "_d", "left_anti").drop("_d")


def values_of(spans: DataFrame) -> DataFrame:
    """Excluded values (column value) that are long enough to mean anything: with a blank and 8 characters, or of 14."""
    n = F.length("value")
    return spans.where(((F.instr("value", " ") > 0) & (n >= 8)) | (n >= 14)).select("value").distinct()


#: Excluded values are looked for by their first characters. Values of at most so many characters in all are sent to the tasks; a
#: filter of hashes has at most 2 to the power of FILTER_BITS bits for each length of anchors.
ANCHOR, MAX_SENT, FILTER_BITS = 8, 8_000_000, 29
_BASE, _MIX = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)


def rolled(text: str, n: int) -> np.ndarray:
    """A hash of every run of n characters of a text: a polynomial of the characters, all at once."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(len(c) - n + 1, 0), np.uint64)
    for k in range(n):
        h *= _BASE
        h += c[k : k + len(h)]
    h ^= h >> np.uint64(29)
    return h * _MIX


class AnchorFilter:
    """Which runs of characters may be anchors: a bit a hash, for each length of anchors. Its size is bounded, whatever the values."""

    def __init__(self, bits: int, words: dict[int, np.ndarray]):
        self.shift, self.words = np.uint64(64 - bits), words

    def may_start(self, text: str) -> Iterator[str]:
        """The distinct runs of the text that may be anchors."""
        for n, words in self.words.items():
            place = rolled(text, n) >> self.shift
            hits = np.flatnonzero(words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
            yield from {text[i : i + n] for i in hits.tolist()}


def anchor_filter(values: DataFrame, bits: int) -> AnchorFilter:
    """Of a table of values. Bits are set where the values are and joined a word at a time; the driver gets the words that have any."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            heads = {v[:ANCHOR] for v in pdf["value"]}
            places = [(len(h), int(rolled(h, len(h))[0] >> shift)) for h in heads]
            yield pd.DataFrame([(n, p >> 6, np.uint64(1 << (p & 63)).astype(np.int64)) for n, p in places], columns=["n", "word", "bit"])

    rows = values.select("value").mapInPandas(run, "n int, word long, bit long").groupBy("n", "word").agg(F.bit_or("bit").alias("bits")).toArrow()
    n, word, of_word = (rows[c].to_numpy() for c in ("n", "word", "bits"))
    words = {}
    for k in np.unique(n).tolist():
        words[k] = np.zeros(1 << bits - 6, np.uint64)
        words[k][word[n == k]] = of_word[n == k].astype(np.uint64)
    return AnchorFilter(bits, words)


def holding(texts: DataFrame, values: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, value) of the texts that hold a value; texts without a key can't be named and are left out. Null and empty values are in none.

    Hashes of the values' first characters make a filter that is sent; of a text's runs of characters only those that pass it go on.
    Values that are few are sent too, and compared where the text is. More of them are joined by their anchors; only the pairs that
    are left meet the text again and are compared.
    """
    values = values.where("value <> ''")
    size, count = values.agg(F.coalesce(F.sum(F.length("value") + 16), F.lit(0)), F.count("*")).first()
    bits = min(max(int(16 * count).bit_length(), 12), FILTER_BITS)
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(anchor_filter(values, bits))
    named = texts.where(F.col(key).isNotNull())
    if size <= MAX_SENT:
        heads: dict[str, list[str]] = {}
        for v in sorted(r["value"] for r in values.distinct().collect()):
            heads.setdefault(v[:ANCHOR], []).append(v)
        known = spark.sparkContext.broadcast(heads)

        @F.pandas_udf("array<string>")
        def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for some in batches:
                yield pd.Series([[v for h in sent.value.may_start(t) for v in known.value.get(h, ()) if v in t] if t else [] for t in some])

        return exploded(named, held(F.col(text_col)), "value", key).distinct()

    @F.pandas_udf("array<string>")
    def starts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield pd.Series([list(sent.value.may_start(t)) if t else [] for t in some])

    v = values.select("value", F.substring("value", 1, ANCHOR).alias("_a")).distinct()
    near = exploded(named, starts(F.col(text_col)), "_a", key).join(v, "_a").select(key, "value").distinct()
    hit = named.select(key, text_col).join(near, key).where(F.contains(F.col(text_col), F.col("value")))
    return hit.select(key, "value").distinct()


def windows(text: Column, size: int = 6000, overlap: int = 200) -> Column:
    """array<struct<start,end>> of overlapping windows, each cut at the last blank of its second half."""

    def step(acc: Column, _: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        start = F.coalesce(F.greatest(last["end"] - overlap, last["start"] + 1), F.lit(0))
        done = F.coalesce(last["end"] >= F.length(text), F.length(text) == 0)
        half = F.substring(text, start + size // 2 + 1, F.lit(size - size // 2))
        cut = F.length(F.regexp_extract(half, r"(?s)^.*\s", 0))
        end = F.when(start + size >= F.length(text), F.length(text)).otherwise(start + F.when(cut > 0, size // 2 + cut).otherwise(size)).cast("int")
        return F.when(done, acc).otherwise(F.concat(acc, F.array(F.struct(start.cast("int").alias("start"), end.alias("end")))))

    rounds = F.sequence(F.lit(0), F.floor(F.length(text) / max(1, size // 2 - overlap)).cast("int") + 1)
    return F.aggregate(rounds, F.array().cast("array<struct<start:int,end:int>>"), step)


def occurrences(text: Column, value: Column) -> Column:
    """Occurrences of a value, which may differ by row, not inside a word where the value's edge is one; if none, whatever the case; if
    none still, whatever blanks stand between its words."""
    edge = lambda pattern, guard: F.when(value.rlike(pattern), guard).otherwise("")
    quoted = lambda v: F.concat(F.lit("\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    bounded = lambda flags, body: F.concat(F.lit(flags), edge(r"^[\p{L}\p{N}_]", r"(?<!\w)"), body, edge(r"[\p{L}\p{N}_]$", r"(?!\w)"))

    def place(pattern: Column) -> Column:
        hits, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
        return let(
            F.struct(hits.alias("h"), running_sum(F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))).alias("e")),
            lambda s: F.transform(s["h"], lambda h, i: F.struct((F.get(s["e"], i) - F.length(h)).alias("start"), F.get(s["e"], i).alias("end"))),
        )

    def first(tries: list[Column]) -> Column:
        if len(tries) == 1:
            return place(tries[0])
        return let(place(tries[0]), lambda found: F.when(F.size(found) > 0, found).otherwise(first(tries[1:])))

    words = F.filter(F.split(value, r"\s+", -1), lambda w: w != "")
    loose = F.array_join(F.transform(words, quoted), "\\s*")
    return F.when(F.trim(value) != "", first([bounded("(?U)", quoted(value)), bounded("(?iuU)", quoted(value)), bounded("(?iuU)", loose)]))


def hard_case(case_keys: Column, category: Column, tags: Column, hard: frozenset[str] = frozenset({"hard", "wrapped", "obfuscated"})) -> Column:
    """Is a case one of the hard ones: by a key of its own that isn't empty (hard_case), by its category, or by a tag?"""
    named = F.coalesce(F.trim(case_keys) != "", F.lit(False))
    return named | F.coalesce(F.lower(category).contains("hard"), F.lit(False)) | F.coalesce(F.exists(tags, lambda t: F.lower(t).isin(*hard)), F.lit(False))


def filled(template: Column, values: Column) -> Column:
    """struct<text, spans> of a template with <<slot>>s and a map slot -> struct<value, label, tier>: the text with the values in it, and
    where they lie; a slot without a label (or a value) makes no span. Null if a slot isn't in the map."""
    found = matches(template, r"<<[A-Za-z0-9_]+>>")
    slot = lambda m: F.substring(m["value"], F.lit(3), F.length(m["value"]) - 4)

    def build(ms: Column) -> Column:
        sizes = F.transform(ms, lambda m: F.length(F.try_element_at(values, slot(m))["value"]) - F.length(m["value"]))

        def placed(m: Column, shift: Column) -> Column:
            v = F.try_element_at(values, slot(m))
            return F.struct((m["start"] + shift).alias("start"), (m["start"] + shift + F.length(v["value"])).alias("end"), v["label"].alias("label"), v["tier"].alias("tier"))

        edits = F.transform(ms, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.try_element_at(values, slot(m))["value"].alias("replacement")))
        every = let(sums_before(sizes), lambda shifts: F.transform(ms, lambda m, i: placed(m, F.get(shifts, i))))
        spans = F.filter(every, lambda x: x["label"].isNotNull() & (x["start"] < x["end"]))
        known = F.forall(edits, lambda e: e["replacement"].isNotNull())
        return F.when(known, F.struct(splice(template, edits).alias("text"), spans.alias("spans")))

    return let(found, build)


def alias_table(weights: list[float]) -> tuple[list[float], list[int]]:
    """For each of n choices the share of its 1/n that it keeps, and the choice that has the rest."""
    if not weights or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be above zero")
    n, total = len(weights), sum(weights)
    left = [w * n / total for w in weights]
    other = list(range(n))
    kept = [1.0] * n
    poor, rich = [i for i in range(n) if left[i] < 1], [i for i in range(n) if left[i] >= 1]
    while poor and rich:
        i, j = poor.pop(), rich[-1]
        kept[i], other[i] = left[i], j
        left[j] -= 1 - left[i]
        if left[j] < 1:
            poor.append(rich.pop())
    return kept, other


def weighted_choice(key: Column, weights: dict[str, float], seed: str = "") -> Column:
    """One of the choices with a probability by its weight, drawn by a hash of seed and key: a row has the same one in every run and place."""
    names = list(weights)
    kept, other = alias_table(list(weights.values()))
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    part = lambda i: F.conv(F.substring(h, i, 8), 16, 10).cast("long")
    slot = F.pmod(part(1), F.lit(len(names))).cast("int")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i)
    return F.when(part(9) < F.floor(pick(kept, slot) * 4294967296.0), pick(names, slot)).otherwise(pick([names[i] for i in other], slot))


def entity_chunks(words: Column, most: int = 8, size: int = 6) -> Column:
    """An entity of more than `most` words as even pieces of at most `size` words; a shorter one as it is. words: its words."""
    n = F.size(words)
    pieces = F.ceil(n / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.slice(words, F.floor(i * n / pieces).cast("int") + 1, (F.floor((i + 1) * n / pieces) - F.floor(i * n / pieces)).cast("int")))
    return F.transform(F.when(n > most, cut).otherwise(F.array(words)), lambda w: F.array_join(w, " "))


def training_rows(made: DataFrame, excluded: DataFrame, labels: list[str], lower_share: float = 0.06) -> DataFrame:
    """input, output (JSON: {"entities": {label: [value]}}) of generated rows (text, spans of label and value): each text once, none that equals
    an excluded one (text), long values in pieces, labels without a value as empty lists, and a share of the texts in lower case."""
    once = leak_guard(made.dropDuplicates(["text"]), excluded)
    low = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("double") / 4294967296.0 < lower_share
    said = lambda t: F.when(low, F.lower(t)).otherwise(t)
    values = lambda label: F.array_distinct(F.flatten(F.transform(F.filter("spans", lambda s: s["label"] == label), lambda s: entity_chunks(F.split(said(s["value"]), " ", -1)))))
    entities = F.create_map(*[x for label in labels for x in (F.lit(label), values(label))])
    return once.select(said(F.col("text")).alias("input"), F.to_json(F.struct(entities.alias("entities"))).alias("output"))


def clip(span_start: Column, span_end: Column, piece_start: Column, piece_end: Column) -> Column:
    """The part of a span inside a piece, in the piece's own offsets; null if none."""
    a, b = F.greatest(span_start, piece_start), F.least(span_end, piece_end)
    return F.when(a < b, F.struct((a - piece_start).alias("start"), (b - piece_start).alias("end")))


def pieces_of_batch(texts: Column) -> Column:
    """Where each text lies in the batch joined by newlines: array<struct<start,end>>."""
    return let(
        running_sum(F.transform(texts, lambda t: F.length(t) + 1)),
        lambda e: F.transform(texts, lambda t, i: F.struct((F.get(e, i) - 1 - F.length(t)).alias("start"), (F.get(e, i) - 1).alias("end"))),
    )


def edit_runs(runs: Column, edits: Column) -> Column:
    """Edits of a paragraph on its formatting runs: a replacement goes into the run that holds the edit's start, covered
    characters leave every run."""
    spans = let(
        running_sum(F.transform(runs, F.length)),
        lambda e: F.transform(runs, lambda r, i: F.struct((F.get(e, i) - F.length(r)).alias("start"), F.get(e, i).alias("end"), r.alias("text"))),
    )

    def one(run: Column) -> Column:
        own = F.filter(edits, lambda e: (e["start"] < run["end"]) & (e["end"] > run["start"]))
        zero = F.struct(run["start"].alias("at"), F.array().cast("array<string>").alias("parts"))

        def step(acc: Column, e: Column) -> Column:
            kept = F.substring(run["text"], acc["at"] - run["start"] + 1, F.greatest(e["start"] - acc["at"], F.lit(0)))
            new = F.when(e["start"] >= run["start"], e["replacement"]).otherwise("")
            return F.struct(F.least(e["end"], run["end"]).alias("at"), F.concat(acc["parts"], F.array(kept, new)).alias("parts"))

        return F.aggregate(own, zero, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(run["text"], acc["at"] - run["start"] + 1, F.length(run["text"]))))

    return F.transform(spans, one)


def marked_prompt(text: Column, labels: list[str]) -> Column:
    """`[[LABEL|value]]` markup: struct<text, spans>, null if a label isn't known."""
    found = matches(text, r"\[\[[^|\[\]]+\|[^\[\]]*\]\]")

    head = lambda x: F.length(F.regexp_extract(x["value"], r"^\[\[[^|]+\|", 0))

    def one(m: Column, shrink: Column) -> Column:
        start = m["start"] - shrink
        n = F.length(m["value"]) - head(m) - 2
        return F.struct(start.alias("start"), (start + n).alias("end"), F.regexp_extract(m["value"], r"^\[\[([^|]+)\|", 1).alias("label"))

    spans = let(found, lambda ms: let(sums_before(F.transform(ms, lambda x: head(x) + 2)), lambda shrunk: F.transform(ms, lambda m, i: one(m, F.get(shrunk, i)))))
    plain = F.regexp_replace(text, r"\[\[[^|\[\]]+\|([^\[\]]*)\]\]", "$1")
    out = F.struct(plain.alias("text"), spans.alias("spans"))
    return F.when(F.forall(spans, lambda s: s["label"].isin(*labels)), out)


def reidentification(vectors: DataFrame, queries: DataFrame, k: int = 3, part: int = nearest.PART) -> DataFrame:
    """query_id, label, vec_id, similarity (cosine), rank: the k best of a stated set of queries (query_id, label, q) among all vectors of their
    label (vec_id, label, embedding). Both are dealt to parts of bounded size, each pair of parts gives its k best, and neither side is
    broadcast."""
    found = ranks(nearest.best(vectors, queries, k, part)).where(F.col("rank") <= k)
    return found.select("query_id", "label", "vec_id", nearest.similarity(F.col("similarity")).alias("similarity"), "rank")


def reid_summary(found: DataFrame) -> DataFrame:
    """label, n, survival_rate, top1, top3, mean_rank of re-identified entities (label, survived, rank from 1), and the same over all as
    'overall'. Nothing for no rows."""
    each = found.select(F.explode(F.array("label", F.lit("overall"))).alias("label"), "survived", "rank")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return each.groupBy("label").agg(
        F.count("*").alias("n"), share(F.col("survived")).alias("survival_rate"), share(F.col("rank") == 1).alias("top1"), share(F.col("rank") <= 3).alias("top3"), F.avg("rank").alias("mean_rank")
    )


def ranks(vectors: DataFrame, w_key: str = "query_id") -> DataFrame:
    """Ranks by similarity, ties by id."""
    return vectors.withColumn("rank", F.row_number().over(W.partitionBy(w_key).orderBy(F.desc("similarity"), "vec_id")))
