"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import byte_bpe
from cloakwork.llm.conversations import damaged, repair
from cloakwork.llm.decontaminate import contamination
from cloakwork.llm.exact_dedup import dedup_table
from cloakwork.llm.html_text import extraction
from cloakwork.llm.licences import scan
from cloakwork.llm.pieces import encode
from cloakwork.llm.resample import resample
from cloakwork.llm.shared import table
from cloakwork.llm.simhash import near_duplicates
from cloakwork.llm.substring_dedup import without_repeats
from cloakwork.llm.token_counts import token_counts
from cloakwork.llm.toxicity import held_out, toxicity
from cloakwork.llm.url_filters import captures_of, entries_of, evaluate


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file; another can be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    return toxicity(docs, labels).select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.5).cast("int").alias("predicted"),
        F.col("tox_evidence").alias("evidence"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_table(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return evaluate(captures_of(pages), entries_of(pages)).select(F.col("capture_id").alias("page_id"), "url", "blocked", "n_active", "pattern", "category")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction(table(spark, sf_dir, "pages"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer("byte_bpe_50k.tiktoken")
    coded = byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, apart=True)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(*damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_exact_dedup, op3_decontaminate, op4_sentencepiece, op5_url_filters,
        op6_html_extraction, op7_licence_scan, op8_token_counts, op9_substring_dedup, op10_simhash,
        op11_byte_bpe, op12_resample, op13_conversation_repair,
    )
}

#: The unsigned crc32 of a list of bytes: its table, and the fold over the bytes (list `b`, table `crc.t`).
CRC_TABLE = """
        crc AS (SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) AS c FROM range(256) r(i)))"""
CRC = "xor(list_reduce({b}, lambda a, x: xor(a // 256, crc.t[xor(a % 256, x) + 1]), 4294967295), 4294967295)"


def bytes_of(text: str) -> str:
    """SQL for the bytes of a text, as a list of numbers."""
    return f"list_transform(range(0, length(hex(encode({text}))) // 2), lambda k: CAST('0x' || substr(hex(encode({text})), 2 * k + 1, 2) AS BIGINT))"


def _repair_sql() -> str:
    """The cheapest edits from the last row to the first, by their cost and then their initials, with what they leave: f0 to f3 are
    those from the four states (nothing yet, after system, after user, after assistant)."""

    def edits(cost: str, initials: str, rest: str, line: str | None = None) -> str:
        return f"{{'c': {cost} + {rest}.c, 'a': '{initials}' || {rest}.a, 'o': {rest}.o" + (f" || [{line}]" if line else "") + "}"

    follow = {0: "f2", 1: "f2", 2: "f3", 3: "f2"}
    named = {"f2": "'user:'", "f3": "'assistant:'"}
    stays = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    own = []
    for q in range(4):
        kept = {0: {"s": "f1", "u": "f2"}, 1: {"u": "f2"}, 2: {"a": "f3"}, 3: {"u": "f2"}}[q]
        ways = [edits("4", "D", f"f{q}")]
        for initial, then in kept.items():
            ways.append(f"CASE WHEN c = '{initial}' AND stay THEN {edits(stays, 'K', then, 'line')} END")
        ways.append(f"CASE WHEN stay THEN {edits('3 + ' + stays, 'R', follow[q], named[follow[q]] + ' || text')} END")
        own.append(f"list_min([{', '.join(ways)}]) AS f{q}")
    with_one = [f"list_min([f{q}, {edits('3', 'I', follow[q], named[follow[q]])}]) AS f{q}" for q in range(4)]
    return f"""
        WITH RECURSIVE {CRC_TABLE.strip()},
        w AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
        o AS (SELECT w.*, {CRC.format(b=bytes_of("key"))} % 20 AS k FROM w, crc),
        d AS (
            SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM o),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
        e AS (
            SELECT *, role[1] AS c, role || ':' || text AS line,
                   CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                        WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault,
                   lead(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS later FROM n),
        s AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (later IS NOT NULL AND c || later NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM e GROUP BY conv_id),
        r AS (
            SELECT conv_id, n + 1 AS i, {{'c': 0, 'a': '', 'o': []::VARCHAR[]}} AS f0, {{'c': 6, 'a': 'II', 'o': ['assistant:', 'user:']}} AS f1,
                   {{'c': 3, 'a': 'I', 'o': ['assistant:']}} AS f2, {{'c': 0, 'a': '', 'o': []::VARCHAR[]}} AS f3 FROM s
            UNION ALL
            SELECT conv_id, i, {", ".join(with_one)} FROM (SELECT conv_id, i, {", ".join(with_one)} FROM (
                SELECT conv_id, i, {", ".join(own)} FROM (
                    SELECT r.*  EXCLUDE (i), e.i, e.c, e.text, e.line, e.fault, e.fault NOT IN ('blank', 'duplicate') AS stay FROM r JOIN e ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = r.i - 1)))),
        b AS (SELECT conv_id, f0 FROM r WHERE i = 1)
        SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(f0.c, 0) AS BIGINT) AS cost, coalesce(f0.a, '') AS audit, sha256(coalesce(array_to_string(list_reverse(f0.o), chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON a.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN b ON a.conv_id IS NOT DISTINCT FROM b.conv_id"""


ORACLES = {
    "op13_conversation_repair": _repair_sql(),
    "op12_resample": rf"""
        WITH {CRC_TABLE.strip()},
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        q AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
        dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
        v AS (SELECT w, {CRC.format(b=bytes_of("w"))} % 10000 AS bucket FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM q)), crc),
        s AS (SELECT bucket, count(*) AS s FROM dw JOIN v USING (w) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM q JOIN v USING (w) GROUP BY bucket),
        g AS (
            SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM q) + 10000)::DOUBLE))) AS BIGINT) AS gain
            FROM s LEFT JOIN t USING (bucket)),
        f AS (SELECT doc_id, count(*) AS n, sum(gain) AS gain FROM dw JOIN v USING (w) JOIN g USING (bucket) GROUP BY doc_id),
        w AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE CAST(floor(gain / n) AS BIGINT) END AS weight FROM d LEFT JOIN f USING (doc_id)),
        h AS (SELECT *, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM w),
        r AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h),
        k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM r WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM r LEFT JOIN k USING (doc_id)""",
    "op2_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
        r AS (
            SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS n,
                   first_value(doc_id) OVER (PARTITION BY h ORDER BY length(t) DESC, doc_id) AS keep_id FROM d)
        SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r""",
    "op5_url_filters": r"""
        WITH p AS (
            SELECT page_id, url, rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '.') AS h,
                   regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path,
                   CAST(to_timestamp(1704067200 + ((page_id * 97) % (366 * 1440)) * 60) AT TIME ZONE 'UTC' AS DATE) AS day FROM pages),
        m AS (
            SELECT page_id, regexp_replace(h, '^[^.]+\.([^.]+\.[^.]+\.)', '\1') AS pattern, CASE WHEN page_id % 2 = 0 THEN 'ads' ELSE 'malware' END AS category FROM p WHERE page_id % 7 = 0
            UNION ALL SELECT page_id, h || regexp_extract(path, '^(/[^/]*/?)', 1), 'adult' FROM p WHERE page_id % 11 = 0),
        log AS (
            SELECT lower(pattern) AS pattern, category, DATE '2024-01-01' + CAST((page_id * 13) % 366 AS INT) AS day, 0 AS removed FROM m
            UNION ALL SELECT lower(pattern), category, DATE '2024-01-01' + CAST((page_id * 29) % 366 AS INT), 1 FROM m),
        daily AS (SELECT pattern, category, day, max(removed) AS removed FROM log GROUP BY ALL),
        v AS (SELECT *, lead(day) OVER (PARTITION BY pattern, category ORDER BY day) AS until FROM daily),
        k AS (
            SELECT DISTINCT page_id, url, day, unnest(list_distinct(list_concat(
                list_transform(range(1, len(string_split(h, '.')) + 1), lambda i: array_to_string(string_split(h, '.')[i:], '.')),
                list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: h || array_to_string(string_split(path, '/')[1:i], '/') || '/'),
                [h || path]))) AS pattern FROM p),
        hit AS (
            SELECT k.page_id, k.url, k.pattern, v.category FROM k JOIN v ON v.pattern = k.pattern AND v.removed = 0 AND v.day <= k.day AND (v.until IS NULL OR k.day < v.until)),
        r AS (SELECT *, count(*) OVER (PARTITION BY page_id, url) AS n, row_number() OVER (PARTITION BY page_id, url ORDER BY length(pattern) DESC, pattern DESC, category) AS i FROM hit)
        SELECT p.page_id, p.url, r.n IS NOT NULL AS blocked, coalesce(r.n, 0) AS n_active, r.pattern, r.category FROM p LEFT JOIN r ON r.page_id = p.page_id AND r.url = p.url AND r.i = 1""",
}
