"""The ten operators against brute force, the libraries and exact round trips, on small tables with awkward rows."""

import hashlib
import html.parser
import math
import random
import time
from collections import Counter

import pandas as pd
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from cloakwork.llm import decontaminate, exact_dedup, html_text, licences, pieces, queries, shared, simhash, substring_dedup, token_counts, toxicity, url_filters
from tests.conftest import SMALL

DOC = "doc_id long, text string, keep_id string, digest string, fp string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOC)


@pytest.fixture(scope="module")
def texts():
    return pd.read_parquet(f"{SMALL}/documents.parquet").text.tolist()


# ---- 2 exact dedup
def brute_dedup(rows):
    strip = str.maketrans("", "", " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(strip), []).append((-len(t or ""), i))
    return {(i, min(g)[1], len(g)) for g in groups.values() for _, i in g}


def test_exact_dedup(spark):
    rows = [(5, "a b"), (2, "ab"), (3, "a  b"), (4, "a  b"), (7, None), (6, ""), (8, " \n"), (9, "é"), (10, "x" * 200_000), (11, "x" * 200_000 + " ")]
    index = exact_dedup.DigestIndex(spark, "digest_test_a")
    got = index.dedup(docs_of(spark, rows)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == brute_dedup(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    # the index persists: a later batch keeps only what is new, and a batch that runs again changes nothing
    later = {r.doc_id: (r.keep_id, r.kept) for r in index.dedup(docs_of(spark, [(20, "a b"), (21, "new")])).collect()}
    assert later == {20: (3, False), 21: (21, True)}
    again = index.dedup(docs_of(spark, rows)).collect()
    assert {(r.doc_id, r.keep_id) for r in again} == {(r.doc_id, r.keep_id) for r in got}
    n = spark.table("digest_test_a").count()
    assert n == spark.table("digest_test_a").select("digest").distinct().count()


def test_exact_dedup_empty_and_null_ids(spark):
    assert exact_dedup.DigestIndex(spark, "digest_test_b").dedup(docs_of(spark, [])).count() == 0
    got = exact_dedup.DigestIndex(spark, "digest_test_c").dedup(docs_of(spark, [(None, "q"), (1, "q"), (1, "q")])).collect()
    assert [r.keep_id for r in got] == [1, 1, 1] and {r.group_size for r in got} == {3}
    assert [r.kept for r in got if r.doc_id is None] == [False] and sum(r.kept for r in got) == 1


def test_a_whole_table_in_batches(spark):
    rng = random.Random(21)
    rows = [(i, " " * rng.randrange(4) + rng.choice("abcdefg") + " " * rng.randrange(4)) for i in range(200)] + [(300, None), (301, ""), (302, "long " * 30_000)]
    for batches in (1, 2, 5):
        got = exact_dedup.dedup_table(docs_of(spark, rows), batches=batches).collect()
        assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == brute_dedup(rows) and len(got) == len(rows)
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    repeated = exact_dedup.dedup_table(docs_of(spark, [(1, "ab"), (1, "a b"), (1, "a b"), (None, "a b")])).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in repeated) == [(0, False), (1, False), (1, False), (1, True)]
    assert exact_dedup.dedup_table(docs_of(spark, [])).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digests_")]


def test_the_index_is_met_by_a_sort_merge_anti_join(spark):
    index = exact_dedup.DigestIndex(spark, "digest_test_d", buckets=4, settled=False)
    index.take(exact_dedup.digests(docs_of(spark, [(1, "a"), (2, "b  ")])))
    later = exact_dedup.digests(docs_of(spark, [(3, "a"), (4, "b"), (5, "a "), (6, "c")])).selectExpr("digest", "doc_id as keep_id", "n")
    new = index.unknown(later)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    assert sorted(r.keep_id for r in new.collect()) == [5, 6]
    again = exact_dedup.DigestIndex(spark, "digest_test_d", buckets=99, settled=False)
    assert again.buckets == 4
    again.append(later)
    held = {r.keep_id for r in again.held().collect()}
    again.compact()
    assert held == {5, 2, 6} == {r.keep_id for r in again.known().collect()}
    again.drop()


# ---- 10 SimHash
def brute_components(rows):
    def fp(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    f = {i: fp(t) for i, t in rows}
    root = {i: i for i in f}
    for _ in f:
        for a in f:
            for b in f:
                if (f[a] ^ f[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    return {(i, f"{f[i]:016x}", root[i]) for i in f}


def test_simhash(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(12):
        base = rng.choices(words, k=120)
        for j in range(4):
            t = list(base)
            if j:
                t[rng.randrange(120)] = "changed"
            rows.append((i * 10 + j, " ".join(t)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "two words"), (906, "word " * 50_000)]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute_components(rows)
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    repeated = simhash.near_duplicates(docs_of(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c")])).collect()
    assert [r.component_id for r in repeated] == [1, 1, 1]


@pytest.mark.parametrize(("levels", "crowd"), [(3, False), (0, True), (1, True), (3, True)])
def test_bk_tree_and_crowded_shards(spark, monkeypatch, levels, crowd):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    if crowd:  # a ball around one fingerprint: however often its shard is dealt again, most of it stays together
        fps |= {min(fps) ^ (1 << i) ^ (1 << j) for i in range(9) for j in range(i)}
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "LEVELS", levels)
    want = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    tree = simhash.BKTree()
    assert {frozenset((a, b)) for a in fps for b in tree.add(a, 3)} == want
    monkeypatch.setattr(simhash, "SHARD_MAX", 16 if crowd else 1)  # shards are dealt again
    signed = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    sizes = Counter(r.key for r in simhash.shards(signed, len(fps)).collect())
    assert max(sizes.values()) <= simhash.SHARD_MAX or not crowd
    found = shared.components(simhash.links(signed, len(fps)))
    root = {f: f for f in fps}
    for _ in range(6):
        for a, b in map(tuple, want):
            root[a] = root[b] = min(root[a], root[b], key=simhash._signed)
    linked = {x for p in want for x in p}
    assert {(r.node, r.component) for r in found.collect()} == {(simhash._signed(f), simhash._signed(root[f])) for f in linked}


def test_components_of_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 150)] + [(5000, 5000)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(150)}}


# ---- 1 toxicity
def test_nearest_equals_brute_force():
    rng = random.Random(1)
    terms = [f"t{i:02}" for i in range(40)]
    index = toxicity.ToxicityIndex(pd.Series(range(500)).to_numpy(), pd.Series([i % 2 for i in range(500)]).to_numpy(), terms, pd.Series([1 + i / 10 for i in range(40)]).to_numpy())
    vectors = [index.vector(Counter(rng.choices(terms, k=rng.randint(0, 6)))) for _ in range(500)]
    flat = [(i, r, x) for i, (rs, xs) in enumerate(vectors) for r, x in zip(rs.tolist(), xs.tolist())]
    index.build(*(pd.Series(c).to_numpy() for c in zip(*flat)))
    held = [dict(zip(rs.tolist(), xs.tolist())) for rs, xs in vectors]
    for _ in range(100):
        r, x = index.vector(Counter(rng.choices([*terms, "unknown"], k=rng.randint(0, 8))))
        scores = [(sum(y * v.get(t, 0) for t, y in zip(r.tolist(), x.tolist())), i) for i, v in enumerate(held)]
        want = sorted(((-round(s, 12), i) for s, i in scores if s > 0))[: toxicity.K]
        assert [i for _, i in index.search(r, x)] == [i for _, i in want]


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=40) + (rng.sample(["vile", "nasty", "awful"], 2) if i % 5 == 0 else []))) for i in range(600)]
    docs = docs_of(spark, rows + [(700, None), (701, ""), (702, "vile nasty " + "word1 " * 30_000)])
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(0, 1), (None, 1), (9999, 0)], "doc_id long, label int").where(~toxicity.held_out())
    got = {r.doc_id: r.tox_score for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(600))
    assert got[700] < 0.5 and got[701] < 0.5 and got[702] >= 0.5
    none = toxicity.toxicity(docs_of(spark, [(1, "a")]), labels.where("false")).first()
    assert none.tox_score == 0.0
    assert toxicity.toxicity(docs_of(spark, []), labels).count() == 0
    only = toxicity.toxicity(docs_of(spark, [(1, "a"), (2, "b")]), spark.createDataFrame([(1, 1)], "doc_id long, label int")).collect()
    assert {r.tox_score for r in only} == {1.0}


def brute_scores(rows, labels, other):
    """fit and score in plain Python: every pair of texts, no index."""
    tf = {i: Counter(shared.words(t)) for i, t in rows}
    total, df = len(rows), Counter(t for c in tf.values() for t in c)
    ids = [i for i, _ in labels]
    y = dict(labels)
    n, pos = len(ids), sum(y.values())
    own = Counter(t for i in ids for t in tf[i])
    with_label = Counter(t for i in ids if y[i] for t in tf[i])
    idf, unseen = {}, other * (math.log((1 + total) / 2) + 1)
    for t, m in own.items():
        a = with_label[t]
        chi2 = n * (a * n - m * pos) ** 2 / max(m * pos * (n - m) * (n - pos), 1)
        share = 1.0 if m >= 3 and m < n and chi2 >= 25 else other
        idf[t] = share * (math.log((1 + total) / (1 + df[t])) + 1)

    def vector(c):
        v = {t: (1 + math.log(k)) * idf.get(t, unseen) for t, k in c.items()}  # all terms of the text, also those of no example
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    examples = {i: vector(tf[i]) for i in ids}
    bare = [y[i] for i in ids if not examples[i]]
    base = sum(bare) / len(bare) if bare else 0.0

    def vote(v, skip=None):
        found = sorted((-round(sum(x * e.get(t, 0.0) for t, x in v.items()), 12), k) for k, (i, e) in enumerate(examples.items()) if i != skip)
        best = [(-s, ids[k]) for s, k in found if s < 0][:15]
        return (0.5 * base + sum(s * s * y[i] for s, i in best)) / (0.5 + sum(s * s for s, _ in best)), [i for _, i in best]

    some = [i for i in ids if examples[i]]
    slope, shift = toxicity.calibrate(pd.Series([vote(examples[i], i)[0] for i in some]).to_numpy(), pd.Series([float(y[i]) for i in some]).to_numpy())
    out = {}
    for i, _ in rows:
        v = vector(tf[i])
        p, evidence = vote(v) if v else (0.0, [])
        out[i] = (1 / (1 + math.exp(-(slope * p + shift))), evidence) if evidence else (base, [])
    return out


@pytest.mark.parametrize("other", [1.0, toxicity.OTHER])
def test_fit_and_score_equal_brute_force(spark, other):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    known = pd.read_parquet(f"{SMALL}/labels.parquet").groupby("doc_id").toxic.max().to_dict()
    rows = list(zip(docs.doc_id.tolist(), docs.text)) + [(90_001, None), (90_002, ""), (90_003, "unseen")]
    some = spark.createDataFrame([(i,) for i in known], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    labels = [(r.doc_id, int(known[r.doc_id])) for r in some if r.doc_id in set(docs.doc_id)]
    index = toxicity.fit(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, label int"), other=other)
    assert index.ids.tolist() == [i for i, _ in labels]
    want = brute_scores(rows, labels, other)
    for i, t in rows:
        score, evidence = index.score(t)
        assert evidence == want[i][1] and abs(score - want[i][0]) < 1e-6


def test_toxicity_keeps_columns_and_takes_several_texts_of_an_id(spark):
    docs = spark.createDataFrame([(1, "vile words", "mine", 0.5), (1, "other words", "mine", 0.5), (2, "plain words", "mine", 0.5)], "doc_id long, text string, tox string, tox_score double")
    got = toxicity.toxicity(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int"))
    assert got.columns == ["doc_id", "text", "tox", "tox_score", "tox_evidence"] and {r.tox for r in got.collect()} == {"mine"}


def test_one_word_of_a_long_text_is_not_its_score(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choices([f"word{j}" for j in range(100)], k=10) + ["vile"] * (i % 5 == 0))) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, label int")
    index = toxicity.fit(docs_of(spark, rows), labels)
    long = " ".join(f"fresh{i}" for i in range(10_000))
    assert index.score("vile")[0] > 0.9 and index.score(f"vile {long}")[0] < 0.5
    (r, x), (r2, x2) = index.vector({"vile": 1}), index.vector(Counter(f"vile {long}".split()))
    assert x[0] == 1.0 and r2.tolist() == r.tolist() and x2[0] < 0.2


def test_toxicity_indexes_every_term(spark):
    rng = random.Random(12)
    rows = [(i, " ".join([f"only{i}", *rng.choices([f"word{j}" for j in range(200)], k=20), *(["vile"] * (i % 4 == 0))])) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, label int")
    queries_ = [(1000 + i, f"Only{i}, unseen") for i in range(200)] + [(2000, "unseen"), (2001, " ".join(f"word{j}" for j in range(40)))]
    got = {r.doc_id: r.tox_evidence for r in toxicity.toxicity(docs_of(spark, rows + queries_), labels).collect()}
    assert all(got[1000 + i] == [i] for i in range(200))  # a word of one example finds it, whatever its label
    assert got[2000] == [] and len(got[2001]) == toxicity.K


# ---- 3 decontamination
def test_decontamination(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(3000)]
    sentence = lambda n: " ".join(rng.choices(vocabulary, k=n)).capitalize() + "."
    items = [(i, f"{sentence(rng.randint(12, 90))} {sentence(rng.randint(3, 12))}") for i in range(40)] + [(40, None), (41, ""), (5, None)]
    rows, want = [], set()
    for d in range(120):
        body = [sentence(15) for _ in range(12)]
        if d % 3 == 0:
            item = d % 40
            body.insert(rng.randrange(12), items[item][1].upper() if d % 2 else items[item][1].replace(" ", "  "))
            want.add((d, item))
        rows.append((d, " ".join(body)))
    rows += [(500, None), (501, ""), (0, rows[0][1])]
    rows.append((502, " ".join(sentence(20) for _ in range(3000)) + " " + items[7][1]))
    want.add((502, 7))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs_of(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    # the size of parts, and how many go in a pass, change nothing: not a score
    for most, parts in ((1, 50), (2000, 2)):
        again = decontaminate.contamination(docs_of(spark, rows), bench, most=most, parts=parts).collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert decontaminate.contamination(docs_of(spark, rows), bench.where("false")).count() == 0
    assert decontaminate.contamination(docs_of(spark, []), bench).count() == 0


def entries_of(items):
    df = Counter(t for _, text in items for w in decontaminate.units_of(text) for t in set(w))
    sizes = [len(w) for _, text in items for w in decontaminate.units_of(text)]
    return [decontaminate.Entry(i, text, {t: df[t] for t in decontaminate.words(text)}) for i, text in items], len(sizes), sum(sizes) / len(sizes)


def brute_bm25(items, w):
    """(item, start, score) of every passage against every unit."""
    units = [(i, u) for i, text in items for u in decontaminate.units_of(text)]
    mean = sum(len(u) for _, u in units) / len(units)
    df = Counter(t for _, u in units for t in set(u))
    out = set()
    for item, u in units:
        own = {t: math.log(1 + (len(units) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(u) / mean)) for t, n in Counter(u).items()}
        for s in range(0, max(1, len(w) - decontaminate.PASSAGE + decontaminate.STRIDE), decontaminate.STRIDE):
            score = sum(own.get(t, 0.0) for t in set(w[s : s + decontaminate.PASSAGE])) / sum(own.values())
            if score >= decontaminate.THRESHOLD:
                out.add((item, s, round(score, 9)))
    return out


@pytest.mark.parametrize("n", [3, 90, 900])
def test_retrieval_equals_exhaustive_bm25(n):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(200)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 150)))) for i in range(n)]
    entries, n_units, mean = entries_of(items)
    w = rng.choices(vocabulary, k=700) + items[2][1].split() + items[n // 2][1].split()[:30]
    want = brute_bm25(items, w)
    assert want
    for size in (n, 7):  # one index, or parts of seven items
        got = set()
        for lo in range(0, n, size):
            index = decontaminate.ItemIndex(entries[lo : lo + size], n_units, mean)
            got |= {(index.item[k], s, round(x, 9)) for k, hits in index.retrieve(w).items() for x, s in hits}
        assert got == want


def test_verification_equals_plain_counting():
    rng = random.Random(18)
    vocabulary = [f"v{i}" for i in range(40)]
    for _ in range(300):
        part, around = rng.choices(vocabulary, k=rng.randint(0, 9)), rng.choices(vocabulary, k=rng.randint(0, 60))
        if part and rng.random() < 0.6:
            at = rng.randrange(len(around) + 1)
            around[at:at] = part[: rng.randint(1, len(part))]
        n = min(5, len(part))
        hay = "".join(f" {x} " for x in around)
        runs = ["".join(f" {x} " for x in part[i : i + n]) for i in range(len(part) - n + 1)] if part else []
        want = sum(r in hay for r in runs) / len(runs) if runs else 1.0
        assert decontaminate.overlap(part, around) == want
    assert decontaminate.question_answer("One two. Three four! Five six?") == (["one", "two", "three", "four"], ["five", "six"])
    assert decontaminate.question_answer("a b c d e f") == (["a", "b", "c", "d"], ["e", "f"])


# ---- 4 pieces
def test_pieces_equal_the_library(texts):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    mine = pieces.Pieces(model)
    rng = random.Random(5)
    odd = ["".join(rng.choice(" aaabetthinoé1\n漢😀<s>") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    some = texts + odd + ["", None, " ", "a" * 20_000, "no blank " * 20_000]
    found = mine.encode_batch(some)
    assert [x.tolist() for x in found] == [sp.encode(t or "") for t in some]
    assert [mine.decode(x) for x in found] == [t or "" for t in some]


def test_decode_table(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (7000, None), (7001, ""), (7002, "漢😀 two  blanks "), (1, texts[1])]
    model = P.path("piece_bpe_32k.model")
    encoded = pieces.encode(docs_of(spark, rows), model)
    back = pieces.decode(encoded.withColumn("text", F.lit("clash")), model).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in rows)
    assert pieces.decode(encoded.where("false"), model).count() == 0
    assert [r.text for r in pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, pieces array<int>"), model).collect()] == [""]


def test_encode_table(spark):
    got = {r.doc_id: r for r in pieces.encode(docs_of(spark, [(1, "Hello world"), (2, None), (3, ""), (1, "Hello world")]), P.path("piece_bpe_32k.model")).collect()}
    assert got[2].n_pieces == 0 and got[3].pieces == [] and all(r.decodes for r in got.values())
    assert pieces.encode(docs_of(spark, []), P.path("piece_bpe_32k.model")).count() == 0


# ---- 5 URL filters
def test_url_filters(spark):
    caps = [
        (1, "https://user:pw@A.Example.COM:8080/x/y.html?q#f", "2024-03-10"), (2, "http://b.example.com./x", "2024-03-10"), (3, "http://other.org/", "2024-03-10"),
        (4, None, "2024-03-10"), (5, "not a url", "2024-03-10"), (6, "http://a.example.com/x/y.html", None), (7, "http://a.example.com/x/y.html", "2024-05-01"), (1, "https://user:pw@A.Example.COM:8080/x/y.html?q#f", "2024-03-10"),
    ]
    entries = [
        ("example.com", "ads", "2024-01-01", "add"), ("example.com", "ads", "2024-04-01", "remove"), ("example.com", "ads", "2024-04-01", "add"),
        ("a.example.com/x/", "adult", "2024-03-10", "add"), ("Other.org", "ads", "2024-03-11", "add"), (None, "ads", "2024-01-01", "add"), ("example.com", "ads", "2024-01-01", "add"),
    ]
    c = spark.createDataFrame(caps, "capture_id long, url string, fetched string").withColumn("fetched", F.to_timestamp("fetched")).withColumn("pattern", F.lit("clash"))
    e = spark.createDataFrame(entries, "pattern string, category string, day string, action string")
    got = {r.capture_id: (r.blocked, r.n_active, r.pattern, r.category) for r in url_filters.evaluate(c, e).collect()}
    no = (False, 0, None, None)
    assert got == {1: (True, 2, "a.example.com/x/", "adult"), 2: (True, 1, "example.com", "ads"), 3: no, 4: no, 5: no, 6: no, 7: (True, 1, "a.example.com/x/", "adult")}
    assert url_filters.evaluate(c, e.where("false")).where("blocked").count() == 0
    assert url_filters.evaluate(c.where("false"), e).count() == 0


# ---- 6 HTML
@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("a<b>b</b> c", "ab c"), ("<p>one<p>two", "one\n\ntwo"), ("<ul><li>x<li>y</ul>", "- x\n- y"),
        ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"),
        ("<table><tr><th>k<th>v<tr><td>long<td>1</table>", "k     v\nlong  1"), ("<div hidden>n</div><div style='color:red;display: none'>n</div>y", "y"),
        ("<script>if (a<b) x</script><style>p{}</style>t", "t"), ("<pre> a\n  b</pre>", " a\n  b"), ("a&amp;b &lt;&nbsp;c", "a&b <\xa0c"), ("x<br>y", "x\ny"),
        ("<details><summary>s</summary>hidden</details>", "s"), ("</div></p>a<unknown>b", "ab"), ("<!-- c --><!DOCTYPE html>t<!-- open", "t"), ("<h1>T</h1>b<div>c</div>d", "T\n\nb\nc\nd"),
        ("<table><tr><td><table><tr><td>in</table><td>out</table>", "in  out"), ("<a href='x>y'>l</a>", "l"), ("1 < 2", "1 < 2"),
    ],
)
def test_html(page, text):
    assert html_text.extract(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.", "so x=2."), ("a <math><mfrac><mn>1</mn><mn>2</mn></mfrac></math> b", "a 1 2 b"),
        ("<math><semantics><mi>y</mi><annotation>tex</annotation></semantics></math>", "y"),
        ("a<svg><title>t</title><defs><text>no</text></defs><text>one</text><text>two</text></svg>b", "a one two b"), ("<svg><title/><circle/></svg>rest", "rest"),
        ("<textarea>\na &lt;b&gt;\n  c</textarea>d", "a <b>\n  c\nd"), ("<textarea placeholder=say></textarea>", "say"),
        ("x<select><optgroup label=G><option>a<option selected>b</optgroup></select>y", "x\nG\na\nb\ny"), ("<datalist><option>n</datalist>y", "y"),
        ("<object data=x><p>instead</object>", "instead"), ("<label>Name<input value='A B'></label>:", "Name A B :"), ("<input type=hidden value=n><input type=submit value=Go>", "Go"),
        ("<table><tr><td rowspan=2>ab<td>c<tr><td>d<tr><td>e<td>f</table>", "ab  c\n    d\ne   f"), ("<table><tr><td>a<td rowspan=2 colspan=2>b<td>c<tr><td>d<td>e</table>", "a  b   c\nd      e"),
        ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "a  b\n   c\nd  e"), ("<pre>a<input value=v></pre>", "av"),
    ],
)
def test_html_shows_formulas_drawings_fields_and_spanning_rows(page, text):
    assert html_text.extract(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</p>z", "yes\n\nz"), ("<style>.x{display:none} #y , i { visibility : hidden }</style>a<b class='k x'>n</b><b id=y>n</b><i>n</i>c", "ac"),
        ("<style>b.x{display:none}.x{color:red}</style><b class=x>n</b><i class=x>y</i>", "y"), ("<style>.x{display:none}</style><b class=x style='display:inline'>y</b>", "y"),
        ("<style>.x{display:none} .x{display:block}</style><b class=x>y</b>", "y"), ("<style>p > b, .a .b {display:none}</style><p><b>y</b>", "y"), ("<style>/* .x{} */ .z{display:none}</style><pre>a<b class=z>n</b>c</pre>", "ac"),
        ("<div hidden style='display:block'>y</div>", "y"), ("<style>{}}{b{display</style>t", "t"), ("<ul style='visibility:hidden'><li>n<li style='visibility:visible'>y</ul>", "- y"),
        ("a <a b='c>d", "a d"), ("x<a title=it's>y</a>", "xy"), ("<a b = \"1>2\" c='3>4'>t</a>", "t"), ("a<b", "a<b"), ("<p title=\"a'b\">q</p>", "q"),
    ],
)
def test_html_reads_styles_and_broken_tags(page, text):
    assert html_text.extract(page) == text


@pytest.mark.parametrize("bad", ["<a ", "<a b='", '<a b="c', "<", "<!--", "<!", "<script>", "</p", "<style>", "<li", '<a b=">', "<a '>", "<td>", "<p>", "&", "&#", "<svg>", "<style>{"])
def test_html_takes_linear_time(bad):
    page = bad * (1_000_000 // len(bad))
    start = time.time()
    html_text.extract(page)
    assert time.time() - start < 2 * (5 if bad.endswith(">") else 1)  # a million characters; whole tags make a tree


def test_html_of_deep_and_wide_tables_takes_linear_time():
    n = 1_000_000
    pages = {
        "nested": "<table><tr><td>x" * (n // 16), "second column": "<table><tr><td>x<td>" * (n // 20), "stray": "<i><table><td>" + "<b>" * (n // 8) + "</i>" * (n // 8) + "y",
        "rows": "<table>" + "<tr><td rowspan=60000>a" * (n // 23), "columns": "<table><tr>" + "<td colspan=1000>a" * (n // 18), "quotes": "<blockquote>q" * (n // 13), "lists": "<ul><li>q" * (n // 9),
        "sheet": "<style>" + "a@" * (n // 2) + "</style>t", "at": "<style>" + "@media x{" * (n // 9) + "</style>t", "p": "<p><table><td>" * (n // 14) + "y", "rules": "<style>" + "@a;b{}" * (n // 6) + "</style>t",
    }
    for name, page in pages.items():
        start = time.time()
        text = html_text.extract(page)
        assert time.time() - start < 10, name
        words = PlainWords()
        if name not in ("sheet", "at", "rules"):
            words.feed(page)
            assert [w for w in text.split() if w != "-"] == words.words, name


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<style>@charset 'utf-8'; .x{display:none}</style><b class=x>n</b>y", "y"), ("<style>@media print { .y{display:none} p{color:red} } .x{display:none}</style><b class=x>n</b><b class=y>y</b>", "y"),
        ("<style>.x{display:none}@font-face{font-family:a}</style><b class=x>n</b>y", "y"), ("<style>@import 'a';@supports (a){@media b{.y{display:none}}}.x{display:none</style><b class=x>n</b><b class=y>y</b>", "y"),
        ("<dialog>n</dialog><dialog open>y</dialog>", "y"), ("<i><table><td><b>a</i>b</td></table>", "ab"), ("<table><tr><td>a<b>b</td><td>c</table>", "ab  c"),
    ],
)
def test_html_reads_sheets_with_at_rules_and_closed_dialogs(page, text):
    assert html_text.extract(page) == text


class PlainWords(html.parser.HTMLParser):
    """The words of a well-formed page, by the standard library's parser: another reading of what is hidden."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in html_text.VOID:
            a = dict(attrs)
            self.hidden.append(tag in ("script", "style", "head", "title", "template") or "hidden" in a or "none" in (a.get("style") or "") or bool(self.hidden and self.hidden[-1]))

    def handle_endtag(self, tag):
        if tag not in html_text.VOID and self.hidden:
            self.hidden.pop()

    def handle_data(self, data):
        if not (self.hidden and self.hidden[-1]):
            self.words += data.split()


def test_html_words_of_generated_pages_like_the_standard_parser():
    rng = random.Random(41)
    numbers = iter(range(10**9))
    words = lambda: " ".join(f"w{next(numbers)}" for _ in range(rng.randint(1, 4)))

    def piece(depth):
        kind = rng.choice(["text", "p", "div", "b", "ul", "table", "hidden", "script", "pre", "h2", "span", "none", "br", "comment"])
        inner = lambda: "".join(piece(depth - 1) for _ in range(rng.randint(1, 3))) if depth else words()
        if kind in ("div", "span", "b"):
            return f"<{kind}> {inner()} </{kind}>"
        if kind in ("p", "pre", "h2"):
            return f"<{kind}>{words()} <i>{words()}</i></{kind}>"
        return {
            "text": lambda: f" {words()} ", "ul": lambda: "<ul>" + "".join(f"<li>{words()}</li>" for _ in range(3)) + "</ul>", "hidden": lambda: f"<div hidden>{inner()}</div>",
            "table": lambda: "<table>" + "".join(f"<tr><td>{words()}</td><th colspan=2>{words()}</th></tr>" for _ in range(3)) + "</table>", "script": lambda: f"<script>{words()}</script>",
            "none": lambda: f"<p style='display: none'>{words()}</p>", "br": lambda: "<br>", "comment": lambda: f"<!-- {words()} -->",
        }[kind]()

    for _ in range(200):
        page = "<html><head><title>t</title></head><body>" + "".join(piece(3) for _ in range(4)) + "</body></html>"
        plain = PlainWords()
        plain.feed(page)
        assert [x for x in html_text.extract(page).split() if x != "-"] == plain.words


def test_html_depth_and_table(spark):
    assert html_text.extract("<div>" * 50_000 + "deep" + "</div>" * 50_000) == "deep"
    pages = spark.createDataFrame([(1, "<p>a", "t"), (2, None, "t"), (1, "<p>a", "t"), (None, "b", "t")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extraction(pages).collect()) == [(0, "b"), (1, "a"), (1, "a"), (2, "")]
    assert html_text.extraction(pages.where("false")).count() == 0


# ---- 7 licences
def brute_licences(text, texts, threshold=0.8):
    words = licences.normalise(text)
    best = []
    for k, t in texts.items():
        a = Counter(licences.bigrams(licences.normalise(t)))
        for i in range(len(words)):
            for j in range(i + 2, min(len(words), i + 60) + 1):
                d = licences.dice(a, Counter(licences.bigrams(words[i:j])))
                if d >= threshold:
                    best.append((-round(d, 12), -(j - i), i, k))
    taken, out = [], []
    for d, n, i, k in sorted(best):
        if all(i >= e or i - n <= s for s, e in taken):
            taken.append((i, i - n))
            out.append((k, -d, i, -n))
    return sorted(out, key=lambda m: m[2])


def test_licences(spark):
    short = {k: v for k, v in licences.TEMPLATES.items() if len(v) < 90}
    index = licences.Templates(short)
    rng = random.Random(6)
    for _ in range(60):
        words = rng.choices(["the", "of", "license", "under", "mit", "filler", "version"], k=30)
        t = short[rng.choice(list(short))].split()
        if rng.random() < 0.5:
            t[rng.randrange(len(t))] = "changed"
        words[10:10] = t
        text = " ".join(words)
        assert index.matches(text) == brute_licences(text, short)
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, None), (3, ""), (4, licences.TEMPLATES["MIT-text"]), (5, "word " * 100_000 + "Licensed under CC BY-NC 4.0."), (1, "Released under the MIT License.")]
    got = sorted((r.doc_id, r.licence, r.dice) for r in licences.scan(docs_of(spark, rows)).collect())
    assert got == [(1, "MIT", 1.0), (1, "MIT", 1.0), (4, "MIT-text", 1.0), (5, "CC-BY-NC-4.0", 1.0)]
    assert licences.scan(docs_of(spark, [])).count() == 0


def test_licences_tell_versions_and_whole_texts_apart():
    index = licences.Templates(licences.TEMPLATES)
    name = lambda text: [m[0] for m in index.matches(text)]
    assert name("x Licensed under the GNU General Public License v3.0. y") == ["GPL-3.0-notice"]
    assert name("x Licensed under CC BY 3.0. y") == ["CC-BY-3.0"] and name("Licensed under CC BY-NC-ND 2.5.") == ["CC-BY-NC-ND-2.5"]
    for k in ("BSD-2-Clause-full", "BSD-3-Clause-text", "Unlicense-text", "GPL-2.0-later", "AGPL-3.0-later", "LGPL-2.1-later", "CC0-1.0-full"):
        assert name(f"before it {licences.TEMPLATES[k]} after it") == [k]
    start = time.time()
    assert name(licences.TEMPLATES["GPL-2.0-full"]) == ["GPL-2.0-full"] and name(licences.TEMPLATES["GPL-3.0-full"]) == ["GPL-3.0-full"]
    assert time.time() - start < 4
    assert index.matches("Copyright (c) 2020 A. Person\n(c) B\n  © C\nReleased under the MIT License.") == [("MIT", 1.0, 0, 5)]


# ---- 8 token counts
def test_licences_of_many_notices_take_linear_time():
    known = licences.Templates(licences.TEMPLATES)
    one = "Licensed under CC BY 4.0. some other words stand here now\n"
    start = time.time()
    found = known.matches(one * (1_000_000 // len(one)))
    assert time.time() - start < 15
    assert len(found) == 1_000_000 // len(one) and {(k, d) for k, d, _, _ in found} == {("CC-BY-4.0", 1.0)}


@pytest.mark.parametrize("seed", range(6))
def test_licence_passages_equal_the_best_of_every_passage(seed):
    rng = random.Random(seed)
    texts = {f"t{i}": " ".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9))) for i in range(6)}
    known = licences.Templates(texts, 0.75)
    for _ in range(25):
        words = [rng.choice("abcde") for _ in range(rng.randrange(2, 45))]
        grams = licences.bigrams(words)
        ways = []
        for k, grams_of in known.grams.items():
            for start in range(len(grams)):
                for end in range(start, len(grams)):
                    # a passage starts and ends with a bigram of its template
                    if grams[start] in grams_of and grams[end] in grams_of and end - start + 1 >= grams_of.total() * 0.75 / 1.25:
                        d = licences.dice(Counter(grams[start : end + 1]), grams_of)
                        if d >= 0.75:
                            ways.append((-round(d, 12), -(end - start + 2), start, k))
        want = []
        for d, n, start, k in sorted(ways):
            if all(start >= s + m or s >= start - n for _, _, s, m in want):
                want.append((k, -d, start, -n))
        assert known.matches(" ".join(words)) == sorted(want, key=lambda m: m[2])


def test_token_counts_equal_the_library(spark, texts, monkeypatch):
    counts = token_counts.Counts(P.path("word_bpe_49k.json"))
    some = [*texts, None, "", " \n", "a<|endoftext|>b <|startoftext|>", "é é", "a\x1cb\x85c", "x" * 5000, "it's we'll 12 345", "　wide　"]
    want = [len(e.ids) for e in counts.tokenizer.encode_batch([t or "" for t in some], add_special_tokens=False)]
    assert counts.count(some) == want
    monkeypatch.setattr(token_counts, "HUGE", 0)  # every text in overlapping chunks
    monkeypatch.setattr(token_counts, "CHUNK", 400)
    monkeypatch.setattr(token_counts, "OVERLAP", 16)
    assert counts.count(some) == want
    rng = random.Random(31)
    odd = ["a" * 4001, "漢字仮名" * 700, "".join(rng.choices("漢字仮名交文書", k=3000)), "".join(rng.choices("abcdefgh", k=3000)), "😀" * 900, "-'s" * 900, "x'll" * 800, "it's" * 900, " " * 5000 + "end", "é" * 900, ("a\n" * 300 + "b" * 900) * 3]
    odd += ["".join(rng.choice(" aab'sll.-é漢😀1") for _ in range(2500)) for _ in range(40)]
    assert counts.count(odd) == [len(e.ids) for e in counts.encode(odd)]
    got = token_counts.token_counts(docs_of(spark, [(1, "é a"), (2, None), (1, "é a")]), P.path("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [(1, 4, 2, False), (1, 4, 2, False), (2, 0, 0, False)]
    assert token_counts.token_counts(docs_of(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_huge_texts_without_blanks_take_linear_time():
    counts = token_counts.Counts(P.path("word_bpe_49k.json"))
    rng = random.Random(32)
    for text in ("".join(rng.choices("漢字仮名交文書山川", k=1_000_000)), "".join(rng.choices("abcdefghijklmnop", k=1_000_000)), "ab" * 500_000):
        start = time.time()
        want = len(counts.encode([text])[0].ids)
        whole, start = time.time() - start, time.time()
        assert counts.count([text]) == [want]
        assert time.time() - start < 4 * whole + 1


# ---- 9 substring dedup
def test_substring_dedup(spark):
    rng = random.Random(9)
    sentence = lambda n=12: " ".join(rng.choices([f"s{i}" for i in range(500)], k=n)).capitalize() + "."
    passage = [sentence() for _ in range(5)]
    long = sentence(60)
    rows = []
    for d in range(20):
        body = [sentence() for _ in range(6)]
        if d % 2:
            body[3:3] = passage
        if d % 5 == 0:
            body.insert(2, long)
        rows.append((d, " ".join(body)))
    rows += [(100, None), (101, ""), (102, "Short. Text."), (None, rows[1][1]), (103, " ".join(passage) + "\n" + " ".join(passage))]
    got = {r.doc_id: r for r in substring_dedup.without_repeats(docs_of(spark, rows)).collect()}
    text = dict(rows)
    for d in range(20):
        own = got[d].text
        assert all(s in own for s in passage) == (d == 1)
        if d % 2 and d != 1:
            assert not any(s in own for s in passage) and got[d].n_removed >= 5
        if d % 5 == 0:
            assert (long in own) == (d == 0)
    assert got[0].text == text[0] and got[1].n_removed == (0 if 1 % 5 else 1)
    assert got[100].text is None and got[101].text == "" and got[102].text == "Short. Text."
    assert got[None].text != text[None] and not any(s in got[103].text for s in passage)
    assert substring_dedup.without_repeats(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("sizes", [(52, 45), (60, 3), (15, 15, 3), (3, 15, 15), (70, 2, 2, 60, 4)])
def test_substring_dedup_covers_a_repeated_run_to_its_end(spark, sizes):
    rng = random.Random(10)
    sentence = lambda n=12: " ".join(rng.choices([f"s{i}" for i in range(5000)], k=n)).capitalize() + "."
    passage = [sentence(n) for n in sizes]
    rows = [(d, " ".join([sentence(), sentence(), *passage, sentence(), sentence()])) for d in range(3)]
    got = {r.doc_id: r for r in substring_dedup.without_repeats(docs_of(spark, rows)).collect()}
    assert got[0].text == rows[0][1] and [got[d].n_removed for d in range(3)] == [0, len(sizes), len(sizes)]
    assert not any(x in got[d].text for d in (1, 2) for x in passage)


def brute_repeats(rows):
    """What is left of each (doc_id, text), by a plain dictionary of all runs in order."""
    order = sorted({(i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), i, t) for i, t in rows}, key=lambda x: x[:3])
    first, out = {}, {}
    for none, key, version, i, t in order:
        cut = substring_dedup.sentences(t) if t else []
        said = [(k, w) for k, (a, b) in enumerate(cut) if (w := shared.words(t[a:b]))]
        runs = [[x] for x in said if len(x[1]) >= 50] + [said[x : x + 2] for x in range(len(said) - 1)]
        for run in runs:
            first.setdefault(" ".join(w for _, ws in run for w in ws), []).append(((none, key, version, run[0][0]), run[0][0], run[-1][0], (i, t)))
        out[i, t] = (cut, set())
    for found in first.values():
        head = min(f[0] for f in found)
        for at, a, b, doc in found:
            if at != head:
                out[doc][1].update(range(a, b + 1))
    return {(i, t): ("".join(t[a:b] for k, (a, b) in enumerate(cut) if k not in gone) if t else t, len(cut), len(gone)) for (i, t), (cut, gone) in out.items()}


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(51)
    pool = [" ".join(rng.choices("abcdefghij", k=rng.choice([1, 2, 3, 60]))) + rng.choice([".", "!", "?", "\n", "...", ""]) for _ in range(12)] + ["--", "\n\n", " . "]
    rows = [(rng.choice([None, *range(30)]), " ".join(rng.choices(pool, k=rng.randint(0, 8)))) for _ in range(80)]
    rows += [rows[0], (5, "repeated passage. of two."), (5, "unique passage. of another."), (6, "repeated passage. of two."), (7, None), (7, "")]
    want = brute_repeats(rows)
    got = substring_dedup.without_repeats(docs_of(spark, rows)).collect()
    assert Counter((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in got) == Counter((i, *want[i, t]) for i, t in rows)
    assert (5, "unique passage. of another.", 2, 0) in {tuple(r) for r in got}


def test_registered_queries_have_a_number_each():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, len(queries.QUERIES) + 1))
