"""Reports, models, requests, texts and policies on small tables, each against plain Python."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import audit, bank, detect, evaluate, mask, nearest, policy, scan, texts, vault_store
from cloakwork.operators.recognizers import SPANS
from cloakwork.operators.tables import exploded
from cloakwork.sources import requests

GOLD = "array<struct<start:int,end:int,label:string,tier:int>>"
PREDS = "array<struct<start:int,end:int,label:string,score:double>>"


def one(spark, column, schema="x string", row=("",)):
    return spark.createDataFrame([row], schema).select(column.alias("c")).first().c


def test_report_and_files(spark, tmp_path):
    rows = [("a", "x" * 100, ["t"], [(0, 4, "A", 1), (10, 14, "B", 2)], [(0, 4, "A", 0.9), (12, 20, "A", 0.5)]), ("b", "y" * 50, ["t", "u"], [], [(1, 3, "A", 0.4)])]
    s = evaluate.scored(spark.createDataFrame(rows, f"id string, text string, tags array<string>, gold {GOLD}, preds {PREDS}"), [1]).cache()
    timed = spark.createDataFrame([(float(i), 100) for i in range(1, 101)], "ms double, chars int")
    got = {(r.section, r.key, r.metric): r.value for r in evaluate.report(s, timed).collect()}
    assert got["mode", "strict", "tp"] == 1 and got["leak", "", "char_recall"] == 1.0 and got["scope", "", "out_of_scope_gold_spans"] == 1 and got["benign", "", "cases_with_fp"] == 1
    assert [got["latency", "", m] for m in ("p50", "p95", "max", "ms_per_kb")] == [51.0, 96.0, 100.0, 505.0] and got["label_leak", "A", "low"] == 0.51
    evaluate.write_reports(s, "id", str(tmp_path / "r"))
    wrong = [json.loads(x) for f in (tmp_path / "r" / "false_positives").glob("*.json") for x in f.read_text().splitlines()]
    assert wrong == [{"id": "b", "label": "A", "start": 1, "text": "yy"}]
    assert evaluate.markdown(spark.createDataFrame([("a|b", 0.5), ("c", None)], "k string, v double"), "T") == "## T\n\n| k | v |\n|-|-|\n| a\\|b | 0.5 |\n| c |  |"


def test_predictions_by_digest_and_floors(spark):
    cases = spark.createDataFrame([(1, "abc def"), (2, "other")], "id int, text string")
    from cloakwork.functions.validators import text_key

    preds = cases.where("id = 1").select(text_key(F.col("text")).alias("key"), F.lit(None).cast(PREDS).alias("p")).withColumn("preds", F.expr("array(named_struct('start', 0, 'end', 3, 'label', 'A', 'score', 1.5D), named_struct('start', 4, 'end', 99, 'label', 'A', 'score', 0.5D))")).drop("p")
    got = {r.id: [tuple(p) for p in r.preds] for r in evaluate.with_predictions(cases, preds).collect()}
    assert got == {1: [(0, 3, "A", 1.0)], 2: []}
    both = spark.createDataFrame([(1, [(0, 3, "A", 0.5)], [(0, 3, "A", 0.5), (4, 5, "B", 0.2)])], f"id int, p {PREDS}, q {PREDS}")
    assert len(evaluate.combined(both, {"p": "m1", "q": "m2"}).first().preds) == 2
    floors = both.select(F.size(evaluate.above_floor(F.col("q"), {"B": 0.1})).alias("a"), F.size(evaluate.above_floor(F.col("q"), {"*": 0.6})).alias("b"), F.size(evaluate.above_floor(F.col("q"), {})).alias("c")).first()
    assert tuple(floors) == (2, 0, 1)


def test_verdicts_and_comparison(spark):
    t = spark.createDataFrame([("a", 0.99, 0.9, 50), ("b", 0.9, 0.9, 50), ("c", 0.99, 0.5, 50), ("d", 0.1, 0.1, 5)], "label string, recall double, precision double, n int")
    assert [r.v for r in t.orderBy("label").select(evaluate.verdict(F.col("recall"), F.col("precision"), F.col("n")).alias("v")).collect()] == ["ok", "WEAK", "NOISY", "FEW SAMPLES"]
    after = t.where("label <> 'd'").withColumn("recall", F.col("recall") - F.when(F.col("label") == "a", 0.05).otherwise(0.0))
    assert {r.label: r.note for r in evaluate.compare_reports(t, after).collect()} == {"a": "recall fell", "b": "", "c": "", "d": "gone"}
    sweep = spark.createDataFrame([(0.1, 1.0), (0.5, 0.96), (0.9, 0.2)], "threshold double, recall double")
    assert tuple(evaluate.recommended(sweep).first()) == (0.45, True)
    assert one(spark, evaluate.nearest_rank(F.array(*map(F.lit, [3, 1, 2, 4])), 0.5)) == 3


def test_models_plug_in(spark):
    docs = spark.createDataFrame([(1, "Ann met Bob. " * 40), (2, "fails"), (3, ""), (4, None)], "id int, text string")

    def load():
        def predict(windows, labels):
            return [None if "fails" in w else json.dumps({"entities": {"person": ["Ann"]}}) for w in windows]

        return predict

    got = {r.id: r.report for r in detect.model_report(docs, detect.Model("m", ("PERSON",), load, size=100, overlap=20)).collect()}
    text = "Ann met Bob. " * 40
    assert got[1].status == "ok" and sorted((s.start, s.end) for s in got[1].spans) == [(i, i + 3) for i in range(0, len(text), 13)]
    assert got[2].status == "failed" and got[2].spans == [] and got[3].status == "ok"
    off = detect.model_report(docs, detect.Model("m", ("PERSON",))).select("report.status").distinct().collect()
    assert [r.status for r in off] == ["unavailable"]
    bare = one(spark, detect.entities_of(F.lit('{"org": ["Acme"]}'), F.lit("at Acme"))["spans"])
    assert [(s.start, s.end, s.label) for s in bare] == [(3, 7, "ORG")]


def test_a_slow_model_keeps_what_it_found_in_time(spark):
    docs = spark.createDataFrame([(1, "Ann met Bob. " * 40), (2, "Ann"), (3, None), (4, "Ann fails " * 30), (5, "")], "id int, text string")

    def load():
        def predict(windows, labels):
            if any("fails" in w for w in windows):
                raise ValueError("no")
            time.sleep(0.05)
            return [json.dumps({"entities": {"person": ["Ann"]}}) for _ in windows]

        return predict

    slow = detect.Model("m", ("PERSON",), load, size=100, overlap=20, budget=detect.Budget(0.12, 0.0, 10.0))
    got = detect.model_report(docs, slow).cache()
    rows = {r.id: r for r in got.collect()}
    one_, done = rows[1].report, [w.processed for w in rows[1].report_windows]
    assert one_.status == "timeout" and 1 <= sum(done) <= 4 < len(done) and done == sorted(done, reverse=True)
    assert {s.start for s in one_.spans} == {i for i in range(0, 520, 13) if i + 3 <= max(s.end for s in one_.spans)} and one_.spans
    assert [rows[i].report.status for i in (2, 3, 4, 5)] == ["ok", "failed", "failed", "ok"] and rows[4].report.spans == []
    told = audit.scan_summary(exploded(got.where("id in (1, 2)"), "report_windows", "w").select("w.*")).first()
    assert told.windows_total == len(done) + 1 and told.processed == sum(done) + 1 and told.skipped == len(done) - sum(done) and told.infer_max_ms >= 50
    covers = got.where("id = 1").select(detect.coverage(F.array("report")).alias("c")).first().c
    assert covers.degraded and covers.uncovered == ["PERSON"]

    def broken():
        raise OSError("missing")

    got.unpersist()
    assert {r.status for r in detect.model_report(docs.where("id < 3"), detect.Model("m", ("PERSON",), broken)).select("report.status").collect()} == {"unavailable"}


def test_span_rows_match_like_arrays(spark):
    rng = random.Random(11)
    gold, preds = [], []
    for k in range(40):
        some = lambda n: [(a := rng.randrange(60), a + rng.randrange(1, 9), rng.choice("AB")) for _ in range(n)]
        gold += [(k, *x) for x in some(rng.randrange(6))]
        preds += [(k, *x, i) for i, x in enumerate(some(rng.randrange(6)))]
    g = spark.createDataFrame(gold, "k int, start int, end int, label string")
    p = spark.createDataFrame(preds, "k int, start int, end int, label string, pos int")
    rows = [(str(k), "", [(*x[1:], 1) for x in sorted(gold) if x[0] == k], [(*x[1:4], 0.5) for x in preds if x[0] == k]) for k in range(40)]
    cases = spark.createDataFrame(rows, f"id string, text string, gold {GOLD}, preds {PREDS}").withColumn("tags", F.array(F.lit("t")))
    want = sorted(map(tuple, evaluate.totals(evaluate.scored(cases)).collect()))
    assert sorted(map(tuple, evaluate.totals_of_spans(g, p, "k").collect())) == want
    # islands are what a sweep over the sorted spans gives, whatever the blocks
    for block in (4, 7, 1 << 16):
        found = {}
        for r in evaluate.islands(g, "k", block).collect():
            found.setdefault((r.k, r.island), []).append((r.start, r.end))
        for k in range(40):
            reach, n = -1, 0
            for _, a, b, _ in sorted(x for x in gold if x[0] == k):
                n, reach = n + (a >= reach), max(reach, b)
            assert n == sum(key[0] == k for key in found)
    assert evaluate.totals_of_spans(g.limit(0), p.limit(0), "k").count() == 0


def test_a_hundred_thousand_spans_in_one_text(spark):
    one_text = spark.range(100_000).select(F.lit(1).alias("k"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 6).cast("int").alias("end"), F.lit("A").alias("label"), F.col("id").alias("pos"))
    begun = time.time()
    got = {r["mode"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.totals_of_spans(one_text.drop("pos"), one_text.withColumn("start", F.col("start") + (F.col("pos") % 2).cast("int")), "k").collect()}
    assert got == {"strict": (50_000, 50_000, 50_000), "overlap": (100_000, 0, 0), "type_agnostic": (100_000, 0, 0)} and time.time() - begun < 60


def test_weighted_choices(spark):
    for weights in ([1.0], [0.0, 5.0], [14, 6, 6, 8, 3, 0.5]):
        kept, other = texts.alias_table(weights)
        shares = [sum(k for i, k in enumerate(kept) if i == j) + sum(1 - k for i, k in enumerate(kept) if other[i] == j) for j in range(len(weights))]
        assert shares == pytest.approx([w * len(weights) / sum(weights) for w in weights])
    with pytest.raises(ValueError):
        texts.alias_table([0.0])
    drawn = spark.range(20_000).select(texts.weighted_choice(F.col("id"), {"a": 1, "b": 3, "c": 0}, "s").alias("c")).groupBy("c").count().collect()
    assert {r.c for r in drawn} == {"a", "b"} and abs(next(r["count"] for r in drawn if r.c == "a") - 5000) < 300


def test_lists_of_a_tenant(spark):
    seen = spark.createDataFrame([("o", "a", 5, True), ("o", "b", None, True), ("o", "c", 9, False), ("p", "d", 7, True)], "org_id string, endpoint string, last_seen int, is_active boolean")
    assert [r.endpoint for r in audit.endpoint_list(seen, "o").collect()] == ["c", "a", "b"]
    assert [r.endpoint for r in audit.endpoint_list(seen, "o", True).collect()] == ["a", "b"]
    log = spark.createDataFrame([(i, "op"[i % 2]) for i in range(9)], "id int, org_id string")
    assert [r.id for r in audit.newest(log, "o", 3).collect()] == [8, 6, 4]
    with pytest.raises(ValueError):
        audit.newest(log, "o", 0)
    rules = spark.createDataFrame([("w", "keep"), ("x", "redact"), ("y", "BLOCK"), ("z", "other"), ("v", "faker")], "label string, action string")
    assert [r.label for r in audit.by_severity(rules).collect()] == ["y", "x", "v", "z", "w"]
    found = spark.createDataFrame([("P", True, 1), ("P", False, 4), ("Q", True, 3)], "label string, survived boolean, rank int")
    assert {r.label: (r.n, r.survival_rate, r.top1, r.top3, r.mean_rank) for r in texts.reid_summary(found).where("label != 'Q'").collect()} == {
        "P": (2, 0.5, 0.5, 0.5, 2.5), "overall": (3, pytest.approx(2 / 3), pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx(8 / 3)),
    }


def test_labels_of_a_model(spark):
    at = lambda x: one(spark, detect.mapped_label(F.lit(x)))
    assert at(" first_name ") == "PERSON" and at("card_cvv") == "CVV" and at("New_Kind") == "NEW_KIND" and at(None) is None


def test_occurrences(spark):
    at = lambda text, value: [(x.start, x.end) for x in one(spark, texts.occurrences(F.lit(text), F.lit(value))) or []]
    assert at("Ann, Annex ann", "Ann") == [(0, 3)] and at("ann x", "Ann") == [(0, 3)] and at("Ann  Lee\nann lee", "Ann Lee") == [(9, 16)] and at("Ann\nLee", "Ann Lee") == [(0, 7)]
    assert at("(+1 555", "(+1") == [(0, 3)] and at("x", " ") == []


def test_bank_and_source_priority(spark):
    rules = bank.bank_rules()
    texts_ = {
        "EGYPTIAN_NATIONAL_ID": ("id 29001011234567.", "id 29013011234567."), "PASSPORT_NUMBER": ("no C01234567.", "no C0123."), "POSTAL_ADDRESS": ("at 12 Oak Tree Lane, Springfield, IL 62704 now", "at 12 oak lane"), "NATIONAL_ID_OTHER": ("nino QQ123456C.", "nino QQ12345C."),
        "DATE_OF_BIRTH": ("born 3 March 1990 in", "born in March"), "USERNAME": ("by @some_one now", "by @ab now"), "EMPLOYEE_ID": ("EMP-12345 here", "EMP-1 here"), "TICKET_ID": ("see ABC-123", "see abc-123"), "PROJECT_CODE_NAME": ("Project Falcon", "project falcon"),
        "IP_ADDRESS": ("mac 0a:1b:2c:3d:4e:5f up", "mac 0a:zz up"), "DRIVER_LICENSE": ("dl A1234567 ok", "dl A123 ok"), "TAX_ID": ("pan ABCDE1234F ok", "pan ABCDE123F ok"), "IBAN": ("DE89370400440532013000", "DE88370400440532013000"), "ABA_ROUTING": ("no 111000025", "no 111000026"),
        "CREDIT_CARD": ("4242 4242 4242 4242", "4242 4242 4242 4243"), "CRYPTO_WALLET": ("0x" + "a1" * 20, "0x" + "a1" * 19),
    }
    rows = [(k, i, t) for k, pair in texts_.items() for i, t in enumerate(pair)]
    found = scan.scan(spark.createDataFrame(rows, "label string, lure int, text string"), recognizers=rules)
    got = {(r.label, r.lure): {s.label for s in r.spans} for r in found.collect()}
    assert not [k for k in texts_ if k not in got[k, 0] or k in got[k, 1]]
    spans = [(0, 9, "PERSON", 0.9, "model", None, False), (0, 4, "PERSON", 0.5, "rules", None, False), (2, 6, "CREDIT_CARD", 0.5, "rules", True, False), (20, 24, "X", 0.5, "model", None, False)]
    s = spark.createDataFrame([(spans,)], f"spans {SPANS}").select(bank.by_source(F.col("spans"), {"CREDIT_CARD": "rules"}, "model").alias("s")).first().s
    assert [(x.start, x.source) for x in s] == [(2, "rules"), (20, "model")]


def test_requests(spark, tmp_path):
    body = "--B\r\nContent-Disposition: form-data; name=\"a\"\r\n\r\none\r\n--B\r\nContent-Disposition: form-data; name=\"f\"; filename=\"x.txt\"\r\nContent-Type: text/plain\r\n\r\nli\nne\r\n--B--\r\n"
    b = spark.createDataFrame([(1, body, "B")], "k int, body string, boundary string")
    parts = requests.form_parts(b, "k", "body", "boundary")
    assert [tuple(r)[1:] for r in parts.collect()] == [("a", None, None, "one"), ("f", "x.txt", "text/plain", "li\nne")]
    back = requests.form_bodies(parts.withColumns({"pos": F.when(F.col("name") == "a", 0).otherwise(1), "boundary": F.lit("B")}), "k", "boundary").first().body
    assert back == body
    form = "f.req=" + __import__("urllib.parse").parse.quote(json.dumps([None, json.dumps([["my prompt", 0], None])])) + "&at=1"
    assert [tuple(r) for r in requests.form_slots(spark.createDataFrame([(1, form), (2, "x=1"), (3, None)], "k int, b string"), "k", "b").collect()] == [(1, "part", "my prompt"), (2, "error", "unknown shape"), (3, "error", "unknown shape")]
    shapes = ['{"entities":[{"start":0,"end":3,"label":"FULL_NAME"}]}', '{"privacy_mask":[{"start":0,"end":3,"label":"full-name"}]}', '{"span_labels":[[0,3,"full_name"]]}', '{"entities":[{"start":0,"end":3,"entity_type":"FULL NAME"}]}', "{}", "[", None]
    got = [r.g for r in spark.createDataFrame([(i, x) for i, x in enumerate(shapes)], "i int, r string").orderBy("i").select(requests.gold_of(F.col("r")).alias("g")).collect()]
    assert [[tuple(s) for s in g] for g in got] == [[(0, 3, "full name")]] * 4 + [[]] * 3
    for name, text in (("one", '{"id":"1","text":"a","spans":[{"start":0,"end":1,"label":"PERSON"}]}'), ("two", '{"text":"b","tags":["x"]}')):
        (tmp_path / f"{name}.jsonl").write_text(text + "\n")
    cases = {r.text: r for r in requests.read_cases(spark, [str(tmp_path / "one.jsonl"), str(tmp_path / "two.jsonl")], ["PERSON"]).collect()}
    assert cases["a"].gold[0].tier == 2 and cases["a"].tags == ["set:one"] and cases["b"].tags == ["x", "set:two"] and cases["b"].id.startswith("two-")
    (tmp_path / "e.csv").write_text('prompt_id,category,hard_case,entity_type,surface,canonical,variant,action,start,end\np1,HR,,PERSON,"Ann\nLee",Ann,exact,faker,3,10\n')
    assert requests.read_entities(spark, str(tmp_path / "e.csv")).select("surface", "start", "end").first()[:] == ("Ann\nLee", 3, 10)
    assert one(spark, requests.file_name_parts(F.lit("a.tar.gz")))[:] == ("a.tar", "gz")


def test_texts(spark):
    slots = F.create_map(F.lit("a"), F.struct(F.lit("xyz").alias("value"), F.lit("L").alias("label"), F.lit(1).alias("tier")), F.lit("b"), F.struct(F.lit("").alias("value"), F.lit(None).cast("string").alias("label"), F.lit(1).alias("tier")))
    f = one(spark, texts.filled(F.lit("<<a>>-<<b>>-<<a>>!"), slots))
    assert f.text == "xyz--xyz!" and [(s.start, s.end) for s in f.spans] == [(0, 3), (5, 8)]
    assert one(spark, texts.filled(F.lit("<<c>>"), slots)) is None and one(spark, texts.filled(F.lit("plain"), slots)).text == "plain"
    rng = random.Random(6)
    for n in (1, 8, 9, 13, 40):
        words = [str(rng.randrange(99)) for _ in range(n)]
        c = one(spark, texts.entity_chunks(F.array(*map(F.lit, words))))
        assert " ".join(c) == " ".join(words) and (n <= 8 or max(len(x.split()) for x in c) - min(len(x.split()) for x in c) <= 1 and max(len(x.split()) for x in c) <= 6)
    made = spark.createDataFrame([("Ann of Acme", [("PERSON", "Ann")]), ("Ann of Acme", [("PERSON", "Ann")]), ("gone", [])], "text string, spans array<struct<label:string,value:string>>")
    rows = texts.training_rows(made, spark.createDataFrame([("gone",)], "text string"), ["PERSON", "ORG"], lower_share=0.0).collect()
    assert [(r.input, json.loads(r.output)) for r in rows] == [("Ann of Acme", {"entities": {"PERSON": ["Ann"], "ORG": []}})]
    assert texts.training_rows(made, made.where("false").select("text"), ["PERSON"], lower_share=1.1).first().input.islower()
    values = spark.createDataFrame([("needle in hay",), ("absent value",)], "value string")
    docs = spark.createDataFrame([(1, "a needle in hay."), (2, "needle  in hay"), (None, "needle in hay")], "k int, text string")
    assert [tuple(r) for r in texts.holding(docs, values, "k").collect()] == [(1, "needle in hay")]
    flag = texts.hard_case(F.col("k"), F.col("c"), F.col("t"))
    h = spark.createDataFrame([("inflection", "HR", []), ("", "HR", []), ("", "HARD_HR", []), (None, None, ["wrapped"]), (None, None, None)], "k string, c string, t array<string>")
    assert [r.x for r in h.select(flag.alias("x")).collect()] == [True, False, True, True, False]


def test_many_values_are_joined(spark, monkeypatch):
    monkeypatch.setattr(texts, "MAX_SENT", 0)
    test_texts(spark)


def test_policy_audit_and_vault(spark, tmp_path):
    rows = [("a", [" Falcon ", "falcon", "X1"], ["*.Corp.acme.com", "corp.acme.com"], None), ("b", ["x"], [], None), ("c", [], ["not a host"], None), ("d", [], [], "odd"), ("e", None, None, "warn"), ("f", ["a\tb"], [], None)]
    good, bad = policy.tenant_configs(spark.createDataFrame(rows, "org_id string, deny_terms array<string>, tenant_domains array<string>, image_policy string"))
    assert {r.org_id: (r.deny_terms, r.tenant_domains, r.image_policy) for r in good.collect()} == {"a": (["Falcon", "X1"], ["corp.acme.com"], "default"), "e": ([], [], "warn")}
    assert {r.org_id: r.reason for r in bad.collect()} == {"b": "term", "c": "domain", "d": "image_policy", "f": "term"}
    seeded = policy.seeded(spark.createDataFrame([("o", "SSN", "BLOCK", False), ("o", "IPV4", "KEEP", True), ("o", "EMAIL", "BLOCK", False)], "org_id string, label string, action string, is_default boolean"), spark, "o")
    own = {r.label: r.action for r in seeded.collect()}
    assert own["US_SSN"] == "BLOCK" and own["EMAIL"] == "BLOCK" and "SSN" not in own and "IPV4" not in own and own["PERSON"] == "FAKER"
    now = F.lit("2024-01-02T00:00:00Z").cast("timestamp")
    stamps = ["2024-01-01T23:59:40", "2024-01-01T23:30:00Z", "2024-01-01T23:00:00+01:00", "2023-12-30T00:00:00"]
    d = spark.createDataFrame([(s,) for s in stamps], "s string").select(audit.relative(audit.utc(F.col("s")), now).alias("r"))
    assert [r.r for r in d.collect()] == ["just now", "30m ago", "2h ago", "3d ago"]
    w = spark.createDataFrame([(True, 10.0), (True, 30.0), (False, None)], "processed boolean, ms double")
    assert tuple(audit.scan_summary(w).first()) == (3, 2, 1, 20.0, 30.0)
    vault = spark.createDataFrame([("c", "EMAIL", "r1", "f1", "i", 50.0), ("c", "EMAIL", "r2", "f2", "j", 200.0), ("d", "EMAIL", "r3", "f3", "k", 200.0)], "conv_id string, label string, real string, fake string, idx string, expires_at double")
    at = F.lit(100.0)
    asked = spark.createDataFrame([("c", None), ("d", 1), ("x", None), ("c", 3)], "conv_id string, since_version long")
    out, events = mask.mapping(vault, asked, at)
    assert sorted((r.conv_id, r.version, r.changed, [tuple(e) for e in r.entries]) for r in out.collect()) == [("c", 3, False, []), ("c", 3, True, [("f2", "r2")]), ("d", 1, False, []), ("x", -1, True, [])]
    assert [tuple(r) for r in events.collect()] == [("demask", "c", 1)] and [tuple(r) for r in mask.items(vault, "d", at).collect()] == [("f3", "r3")] and mask.cleared(vault, ["c"]).count() == 1


@pytest.mark.parametrize("n", [0, 1, 7])
def test_latency_of_few_values(spark, n):
    t = spark.createDataFrame([(float(i * i), 10) for i in range(n)], "ms double, chars int")
    got = evaluate.latency(t).collect()
    values = [float(i * i) for i in range(n)]
    assert [tuple(r)[:3] for r in got] == ([(values[min(n - 1, n // 2)], values[min(n - 1, int(0.95 * n))], values[-1])] if n else [])


@pytest.mark.parametrize("sent", [8_000_000, 0])
def test_held_values_equal_a_search_of_every_value(spark, monkeypatch, sent):
    monkeypatch.setattr(texts, "MAX_SENT", sent)
    rng = random.Random(sent + 1)
    word = lambda k: "".join(rng.choice("abé漢\U0001f600 ") for _ in range(rng.randrange(1, k)))
    rows = [(i, word(120)) for i in range(150)] + [(200, None), (201, ""), (None, "abcdefgh")]
    known = [t[a : a + rng.randrange(1, 30)] for _, t in rows[:40] for a in [rng.randrange(len(t))]] + [word(14) for _ in range(60)]
    docs = spark.createDataFrame(rows, "k long, text string")
    got = texts.holding(docs, spark.createDataFrame([(v,) for v in [*known, "", None]], "value string"), "k").collect()
    assert sorted(map(tuple, got)) == sorted({(k, v) for k, t in rows if k is not None and t for v in known if v and v in t})
    assert texts.holding(docs, spark.createDataFrame([], "value string"), "k").count() == 0


def test_rolled_hashes_tell_runs_apart():
    text = "".join(random.Random(4).choice("abcdefgh") for _ in range(50_000))
    hashes = texts.rolled(text, 8)
    runs = [text[i : i + 8] for i in range(len(text) - 7)]
    assert len(hashes) == len(runs) and len(set(hashes.tolist())) == len(set(runs)) and texts.rolled("abc", 8).size == 0


ENTRY = "conv_id string, label string, real string, fake string, idx string, expires_at double"


def test_vault_store_keeps_batches_whole(spark, tmp_path, monkeypatch):
    seal, folder = b"s" * 16, f"file://{tmp_path}/vault"
    store = vault_store.VaultStore(spark, folder, seal, buckets=8)
    held = lambda s=store: sorted((r.conv_id, r.real, r.fake, r.expires_at) for r in s.read().collect())
    batch = lambda rows, key=b"k": spark.createDataFrame([(c, "EMAIL", r, f, None, float(e)) for c, r, f, e in rows], ENTRY).withColumn("idx", mask.index_of(key, F.col("label"), F.col("real")))
    assert held() == [] and store.merge(batch([(f"c{i}", f"r{i}", f"f{i}", 100) for i in range(40)] + [("c1", "r1", "late", 200)])) == 1
    first = held()
    assert len(first) == 40 and ("c1", "r1", "late", 200.0) in first
    data = [p for p in (tmp_path / "vault").rglob("*.parquet")]
    assert len(data) <= 8 and not any(b"r17" in p.read_bytes() for p in data)  # buckets, not conversations; values are sealed
    # a batch rewrites the buckets that it touches
    before = store.manifest()[1]
    store.merge(batch([("c1", "r1", "new", 300)]))
    after = store.manifest()[1]
    assert sum(before[b] != after[b] for b in before) == 1
    assert held() == sorted([e for e in first if e[0] != "c1"] + [("c1", "r1", "new", 300.0)])
    # a writer that dies before its manifest changes nothing
    whole = held()
    with monkeypatch.context() as m:
        m.setattr(store, "_place", lambda *_: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            store.merge(batch([("c2", "r2", "torn", 300)]))
    assert held() == whole and held(vault_store.VaultStore(spark, folder, seal)) == whole
    # two writers of one version: the second one fails
    with pytest.raises(RuntimeError):
        store._place(store.manifest()[0], {})
    # another index key: entries are found by it, and not doubled
    store.reindexed(b"other")
    store.merge(batch([("c3", "r3", "again", 400)], b"other"))
    assert held() == sorted([e for e in whole if e[0] != "c3"] + [("c3", "r3", "again", 400.0)])
    store.purge(F.lit(150.0), ["c3"])
    assert held() == [("c1", "r1", "new", 300.0)]
    store.clean()
    assert held() == [("c1", "r1", "new", 300.0)] and len(list((tmp_path / "vault").glob("manifest-*.json"))) == 2


def test_policy_versions_and_what_was_in_force(spark):
    changes = spark.createDataFrame(
        [("o", "EMAIL", "REDACT", 10, 1), ("o", "EMAIL", "REDACT", 20, 2), ("o", "EMAIL", "KEEP", 30, 4), ("o", "EMAIL", "BLOCK", 30, 5), ("o", "EMAIL", "KEEP", None, 6), ("p", "EMAIL", "FAKER", 5, 7)],
        "org_id string, label string, action string, at int, change_id int",
    )
    versions = policy.history(changes)
    assert sorted(map(tuple, versions.where("org_id = 'o'").collect())) == [("o", "EMAIL", 1, "REDACT", 10, 30), ("o", "EMAIL", 2, "KEEP", 30, 30), ("o", "EMAIL", 3, "BLOCK", 30, None)]
    events = spark.createDataFrame([(i, o, "EMAIL", t) for i, (o, t) in enumerate([("o", 9), ("o", 10), ("o", 29), ("o", 30), ("o", None), ("p", 99), ("q", 99)])], "id int, org_id string, label string, ts int")
    got = {r.id: (r.version, r.action) for r in policy.in_force(events, versions).collect()}
    assert got == {0: (0, None), 1: (1, "REDACT"), 2: (1, "REDACT"), 3: (3, "BLOCK"), 4: (0, None), 5: (1, "FAKER"), 6: (0, None)}
    assert policy.in_force(events, policy.history(changes.limit(0))).where("version > 0").count() == 0


def test_policy_in_force_is_that_of_long_histories(spark, capsys):
    """Versions and events over many blocks of time against brute force: events far after the last version, at its very time, of no key and
    of no time; and none reads its key's whole history."""
    import bisect
    import datetime

    start = datetime.datetime(2024, 3, 30, 22)
    tell = lambda m: None if m is None else start + datetime.timedelta(minutes=m)
    made = {o: sorted({(i * i * 37 + seed) % 9000 for i in range(60)}) for o, seed in (("o", 1), ("p", 500), ("late", 8000))}
    changes = [(o, "EMAIL", f"A{i}", tell(m), i) for o, ms in made.items() for i, m in enumerate(ms)]
    wanted = {}
    rows = []
    for i in range(1500):
        o, m = [("o", i * 7), ("p", made["p"][i % len(made["p"])]), ("late", i), ("none", i), (None, i), ("o", None)][i % 6]
        rows.append((i, o, "EMAIL", tell(m), "own"))
        n = 0 if m is None else bisect.bisect_right(made.get(o, []), m)
        wanted[i] = (n, f"A{n - 1}" if n else None, "own")
    for kind in ("timestamp", "timestamp_ntz"):
        history = policy.history(spark.createDataFrame(changes, f"org_id string, label string, action string, at {kind}, change_id int"))
        got = policy.in_force(spark.createDataFrame(rows, f"id int, org_id string, label string, ts {kind}, near string"), history)
        assert {r.id: (r.version, r.action, r.near) for r in got.collect()} == wanted
        assert got.columns == ["org_id", "label", "id", "ts", "near", "version", "action"]
        got.explain()
        assert "collect_list" not in capsys.readouterr().out
    seconds = lambda rows, i: [(*r[:i], None if r[i] is None else (r[i] - start).total_seconds(), *r[i + 1 :]) for r in rows]
    history = policy.history(spark.createDataFrame(seconds(changes, 3), "org_id string, label string, action string, at double, change_id int"))
    got = policy.in_force(spark.createDataFrame(seconds(rows, 3) + [(9999, "o", "EMAIL", float("nan"), "own")], "id int, org_id string, label string, ts double, near string"), history)
    assert {r.id: (r.version, r.action, r.near) for r in got.collect()} == wanted | {9999: (len(made["o"]), f"A{len(made['o']) - 1}", "own")}


def test_nearest_vectors_of_parts_are_those_of_all_pairs(spark):
    """Ranks over many parts against brute force: copies of equal similarity by their ids, a vector that is its own query, nulls and vectors of
    another size last, a zero vector (which is no number) first."""
    import math

    rng = random.Random(5)
    shapes = [[rng.choice([-1.5, 0.25, 1.0, 3.0]) for _ in range(5)] for _ in range(9)]
    rows = [(i, "few" if i % 11 == 0 else "many", None if i == 7 else [None, 1.0, 2.0, 3.0, 4.0] if i == 18 else [1.0, 2.0] if i == 29 else [0.0] * 5 if i == 41 else shapes[rng.randrange(9)]) for i in range(240)]
    v = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    q = v.where("vec_id % 6 = 1").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return -math.inf
        dot, x, y = 0.0, 0.0, 0.0
        for s, t in zip(a, b):
            dot, x, y = dot + s * t, x + s * s, y + t * t
        return dot / (math.sqrt(x) * math.sqrt(y)) if x * y else math.inf

    told = lambda s: None if s == -math.inf else "no number" if s == math.inf or math.isnan(s) else s
    order = {i: sorted((-cosine(b, e), j) for j, other, b in rows if other == label and j != i) for i, label, e in rows if i % 6 == 1}
    for k, part in ((3, 16), (9, 7), (3, 4096)):
        got = texts.reidentification(v, q, k, part).collect()
        found = {(r.query_id, r["rank"]): (r.vec_id, None if r.similarity is None else told(r.similarity)) for r in got}
        assert found == {(i, n + 1): (j, told(-s)) for i, near in order.items() for n, (s, j) in enumerate(near[:k])} and len(got) == len(found)
    first = {i: next((n + 1, near) for n, (_, j) in enumerate(near) if j % 20 == 13) for i, near in order.items() if any(j % 20 == 13 for _, j in near)}
    for part in (16, 4096):
        got = nearest.own_ranks(v.withColumn("own", F.col("vec_id") % 20 == 13), q, part).collect()
        assert {r.query_id: (r["rank"], r.top) for r in got} == {i: (n, -near[0][0]) for i, (n, near) in first.items()} and len(got) == len(first)
    small = nearest.compared(v, q, lambda left, right, rows, near, other: {"row": rows[:1], "most": [len(left)], "asked": [len(right)]}, "most long, asked long", part=16)
    most = small.agg(F.max("most"), F.max("asked")).first()
    assert most[0] < 48 and most[1] < 48
    assert texts.reidentification(v.limit(0), q).count() == 0 and nearest.own_ranks(v.withColumn("own", F.lit(False)), q).count() == 0


def test_greedy_matches_of_many_spans_are_those_of_all_pairs(spark):
    """Of texts with many spans too, in any order, overlapping, empty, of equal labels and not."""
    rng = random.Random(3)
    span = lambda top, wide: (lambda a: (a, a + rng.randrange(wide), rng.choice(["card number", "payment-card", "tax id"])))(rng.randrange(top))
    texts_ = [([span(top, wide) for _ in range(n)], [span(top, wide) for _ in range(m)]) for n, m, top, wide in [(0, 3, 9, 4), (3, 0, 9, 4), (12, 9, 40, 9), (150, 140, 3000, 30), (150, 140, 400, 30), (90, 300, 10**6, 5)]]

    def brute(preds, gold, same):
        free, tp = list(gold), 0
        for p in preds:
            hit = next((i for i, g in enumerate(free) if p[0] < g[1] and g[0] < p[1] and same(p[2], g[2])), None)
            if hit is not None:
                tp += 1
                del free[hit]
        return tp

    kind = "array<struct<start:int,end:int,label:string>>"
    cases = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(texts_)], f"id int, preds {kind}, gold {kind}").repartition(2)
    got = cases.select("id", evaluate.greedy_matches(F.col("preds"), F.col("gold"), True).alias("same"), evaluate.greedy_matches(F.col("preds"), F.col("gold"), False).alias("any")).collect()
    assert {r.id: (r.same, r["any"]) for r in got} == {i: (brute(p, g, lambda a, b: a == b), brute(p, g, lambda a, b: True)) for i, (p, g) in enumerate(texts_)}
    classes = {"card number": "card", "payment-card": "card"}
    by_class = {r.id: r.tp for r in evaluate.class_totals(cases, ["id"]).collect()}
    assert by_class == {i: brute(p, g, lambda a, b: classes.get(a, a) == classes.get(b, b)) for i, (p, g) in enumerate(texts_)}


def test_classes_of_a_text_with_thousands_of_spans(spark):
    n = 5000
    spans = lambda long, short: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 10).alias("start"), (i * 10 + 6).alias("end"), F.when(i % 3 == 0, long).otherwise(short).alias("label")))
    case = spark.range(1).select(spans("CARD_NUMBER", "full name").alias("gold"), spans("payment-card", "passport_number").alias("preds"))
    began = time.time()
    r = evaluate.class_totals(case).first()
    assert (r.tp, r.fp, r.fn) == (1667, 3333, 3333) and time.time() - began < 60
