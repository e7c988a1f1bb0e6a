"""Resampling against a plain reading of its definition, with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cloakwork.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def features(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plainly(rows, target, n=1, buckets=10_000, seed=2024, percent=10, min_words=20):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for x in texts for f in features(x, n)[1]) for texts in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for i, text in rows:
        words, found = features(text, n)
        weight = sum(gain[of(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, len(words)])
    can = sorted((x for x in out if x[5] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for rank, x in enumerate(can[: percent * len(can) // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=repr)


def rows_of(rng, n):
    words = ["alpha", "Beta", "GAMMA", "straße", "Été", "漢字", "x1", "42", "o'neil", "a_b", "\U0001f600"]
    common = "The same line, again and again."
    out = []
    for i in range(n):
        lines = [rng.choice([common, "", "  ", "-- !!"]) if rng.random() < 0.3 else rng.choice([" ", ", ", "\t"]).join(rng.choices(words, k=rng.randrange(1, 14))) for _ in range(rng.randrange(6))]
        out.append((i, "\n".join(lines)))
    return [*out, (n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, "long " * 30_000), (None, common), (0, "alpha " * 30)]


def table_of(spark, rows):
    """Documents with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, t, "r", 1, 2) for i, t in rows], "doc_id long, text string, row string, weight int, n int")


@pytest.mark.parametrize("n, buckets, percent", [(1, 10_000, 10), (1, 7, 50), (2, 500, 100), (3, 10_000, 10)])
def test_equals_the_definition(spark, n, buckets, percent):
    rng = random.Random(n * buckets)
    rows, target = rows_of(rng, 120), [t for _, t in rows_of(rng, 12)]
    got = resample.resample(table_of(spark, rows), table_of(spark, list(enumerate(target))), n, buckets, percent=percent)
    assert sorted(map(tuple, got.collect()), key=repr) == plainly(rows, target, n, buckets, percent=percent)


def test_empty_tables(spark):
    docs, none = table_of(spark, [(1, "word " * 25), (2, "")]), table_of(spark, [])
    assert resample.resample(none, docs).count() == 0
    assert sorted(map(tuple, resample.resample(docs, none, percent=100).collect()), key=repr) == plainly([(1, "word " * 25), (2, "")], [], percent=100)


def test_repeated_rows_are_ranked_one_after_the_other(spark):
    got = resample.resample(table_of(spark, [(5, "a " * 20)] * 4 + [(6, "b")]), table_of(spark, [(1, "a")]), percent=100).collect()
    assert sorted(r.rank for r in got if r.doc_id == 5) == [1, 2, 3, 4] and len({r.score for r in got if r.doc_id == 5}) == 1
    assert [r.rank for r in got if r.doc_id == 6] == [None]


def test_a_hot_score_and_ranks_over_groups(spark):
    scored = spark.range(3000).select(F.col("id").alias("row"), F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("id") * 7 % 5000 - 2500).cast("long").alias("score"), (F.col("id") % 10 != 0).alias("drawable"))
    got = {r.row: r["rank"] for r in resample.ranked(scored, 30).collect()}
    can = sorted((r for r in scored.collect() if r.drawable), key=lambda r: (-r.score, r.doc_id))
    want = {r.row: i for i, r in enumerate(can[: len(can) * 30 // 100], 1)}
    assert {k: v for k, v in got.items() if v} == want and len(got) == 3000
