"""Detectors side by side: their budgets and statuses, what a text is covered for, and spans from a model's reply.

A detector is a column of spans; null spans are a failure of that row, never of
the job. Everything but found_everywhere() stays in the row.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import fixed
from cloakwork.functions.positions import let
from cloakwork.operators.recognizers import SPAN, SPANS, Recognizer
from cloakwork.operators.tables import exploded, free_name
from cloakwork.operators.texts import occurrences, windows

OK, FAILED, TIMEOUT, UNAVAILABLE, INVALID = "ok", "failed", "timeout", "unavailable", "invalid_output"


@dataclass(frozen=True)
class Budget:
    """Seconds a text may take: base, and more for each thousand characters up to a cap of its own for prompts and files."""

    base: float = 15.0
    per_kchar: float = 0.05
    prompt_cap: float = 10.0
    file_cap: float = 60.0

    def seconds(self, n_chars: Column, is_file: bool = False) -> Column:
        return F.least(F.lit(self.base) + n_chars * F.lit(self.per_kchar) / 1000, F.lit(self.file_cap if is_file else self.prompt_cap))


def sound(spans: Column, text: Column) -> Column:
    """Every span has a label, isn't empty and lies in the text."""
    return F.forall(spans, lambda s: F.coalesce((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)) & s["label"].isNotNull(), F.lit(False)))


def report(name: str, labels: list[str], critical: bool, spans: Column, text: Column, available: Column | None = None, in_time: Column | None = None) -> Column:
    """struct<name,status,critical,labels,spans> of one detector; only a status of ok keeps its spans."""
    status = (
        F.when(~F.coalesce(available if available is not None else F.lit(True), F.lit(False)), UNAVAILABLE)
        .when(~F.coalesce(in_time if in_time is not None else F.lit(True), F.lit(False)), TIMEOUT)
        .when(spans.isNull(), FAILED).when(~sound(spans, text), INVALID).otherwise(OK)
    )
    return F.struct(
        F.lit(name).alias("name"), status.alias("status"), F.lit(critical).alias("critical"), F.array(*[F.lit(x) for x in labels]).cast("array<string>").alias("labels"),
        F.when(status == OK, spans).otherwise(F.array().cast(SPANS)).alias("spans"),
    )


def coverage(reports: Column) -> Column:
    """struct<degraded,blocked,covered,uncovered> of an array of reports: a label is covered if a detector of it is ok."""
    labels = lambda keep: F.array_distinct(F.flatten(F.transform(F.filter(reports, keep), lambda r: r["labels"])))
    covered = labels(lambda r: r["status"] == OK)
    return F.struct(
        F.exists(reports, lambda r: r["status"] != OK).alias("degraded"), F.exists(reports, lambda r: (r["status"] != OK) & r["critical"]).alias("blocked"),
        F.array_sort(covered).alias("covered"), F.array_sort(F.array_except(labels(lambda r: F.lit(True)), covered)).alias("uncovered"),
    )


def all_found(reports: Column) -> Column:
    """The spans of every detector that is ok."""
    return F.flatten(F.transform(reports, lambda r: r["spans"]))


def dictionary(entries: list[tuple[str, str, float, list[str]]]) -> list[Recognizer]:
    """Recognizers of (name, label, score, words): whole words, longest first; what stands in for a model where there is none."""
    by_length = lambda words: sorted(set(words), key=lambda w: (-len(w), w))
    return [
        Recognizer(name, (label,), r"(?<![A-Za-z0-9_])(?:" + "|".join(rf"\Q{w}\E" for w in by_length(words)) + r")(?![A-Za-z0-9_])", score=score, words=tuple(by_length(words)), cased=True)
        for name, label, score, words in entries
    ]


def entities_of(reply: Column, text: Column, label_of=lambda label: F.upper(F.translate(label, " -", "__"))) -> Column:
    """struct<spans,unlocated> of a model's reply {"entities": {label: [value or object]}}, or {label: [value or object]} alone.

    An object has text, confidence or score (0.5 if neither is a number) and
    perhaps offsets, which hold if the text has the value there; otherwise every
    occurrence is a span. Values that the text doesn't have are counted. A reply
    of another shape, or null, has no spans.
    """
    item = "text string, confidence string, score string, start string, start_char string, end string, end_char string"
    bare = F.map_filter(F.from_json(reply, "map<string,array<string>>"), lambda k, v: v.isNotNull())
    groups = F.map_entries(F.coalesce(F.from_json(reply, "struct<entities:map<string,array<string>>>")["entities"], bare))
    told = F.flatten(
        F.transform(groups, lambda g: F.transform(F.coalesce(g["value"], F.array().cast("array<string>")), lambda v: F.struct(g["key"].alias("label"), F.when(v.startswith("{"), F.from_json(v, item)).otherwise(F.from_json(F.to_json(F.struct(v.alias("text"))), item)).alias("x"))))
    )

    def placed(t: Column) -> Column:
        x, value = t["x"], F.trim(t["x"]["text"])
        sure = F.coalesce(x["confidence"].try_cast("double"), x["score"].try_cast("double"), F.lit(0.5))
        start, end = F.coalesce(x["start"], x["start_char"]).try_cast("int"), F.coalesce(x["end"], x["end_char"]).try_cast("int")
        there = F.substring(text, start + 1, end - start)
        lead = F.length(there) - F.length(F.ltrim(there))
        holds = F.coalesce((start >= 0) & (start < end) & (end <= F.length(text)) & (F.trim(there) == value), F.lit(False))
        told_place = F.array(F.struct((start + lead).alias("start"), (start + lead + F.length(value)).alias("end")))
        places = F.when(holds, told_place).otherwise(occurrences(text, value))
        one = lambda p: F.struct(
            p["start"].alias("start"), p["end"].alias("end"), label_of(t["label"]).alias("label"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("score"),
            F.lit("tier2.model").alias("source"), F.lit(None).cast("boolean").alias("validated"), F.lit(False).alias("context"),
        ).cast(SPAN)
        return F.transform(places, one)

    named = F.filter(told, lambda t: F.trim(t["x"]["text"]) != "")
    lost = lambda found: F.size(F.filter(found, lambda f: F.size(f) == 0))
    return let(
        F.coalesce(F.transform(named, placed), F.array().cast(f"array<{SPANS}>")),
        lambda found: F.struct(F.array_distinct(F.flatten(found)).alias("spans"), lost(found).alias("unlocated")),
    )


def found_everywhere(found: DataFrame, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, start, end, label, score: what windows of a text found, (key, label, entity, score), at its best score wherever the text has it."""
    best = found.groupBy(key, "label", "entity").agg(F.max("score").alias("score"))
    rows = texts.select(key, text).join(best, key)
    return exploded(rows, occurrences(F.col(text), F.col("entity")), "p", key, "label", "score").select(key, "p.start", "p.end", "label", "score")


def mapped_label(label: Column, names: dict[str, str] = fixed.MODEL_LABELS) -> Column:
    """The canonical label of a model's own, in any case and without blanks around it; one that isn't in the table stays, in upper case."""
    up = F.upper(F.trim(label))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), up), up)


def canonical_of(label: Column, mapping: dict[str, str]) -> Column:
    """The canonical label of a model's own: the first entry that equals it, or of "prefix*" starts it, in any case; else null."""
    low = F.lower(F.trim(label))
    fits = lambda k: low.startswith(k[:-1].lower()) if k.endswith("*") else low == k.lower()
    return F.coalesce(*[F.when(fits(k), v.upper()) for k, v in mapping.items()], F.lit(None).cast("string"))


@dataclass(frozen=True)
class Model:
    """A model behind the scan. load() is called once a task and gives a function of (texts, labels) that returns, for each text, a reply
    as entities_of() reads it, or None where it failed. Without load the model is unavailable, which coverage() tells; where load raises,
    its rows are unavailable too. budget: the seconds that a text may take; without one all windows of a batch are asked at once."""

    name: str
    labels: tuple[str, ...]
    load: Callable[[], Callable[[list[str], list[str]], list[str | None]]] | None = None
    size: int = 6000
    overlap: int = 200
    budget: Budget | None = None
    clock: Callable[[], float] = time.perf_counter


def replies_of(predict: Callable, labels: list[str], pieces: list[str]) -> list[str | None]:
    """A reply for each piece; one that raises fails its pieces, never the job."""
    try:
        told = list(predict(pieces, labels))
    except Exception:  # whatever a plugged-in model raises is a status of these rows
        told = []
    return told if len(told) == len(pieces) else [None] * len(pieces)


def replies_in_time(predict: Callable, labels: list[str], pieces: list[str], seconds: float, clock: Callable[[], float]) -> tuple[list[str | None], list[float]]:
    """Replies and milliseconds of the pieces that were begun before the time was over: the clock is read between pieces."""
    begun, told, took = clock(), [], []
    for piece in pieces:
        at = clock()
        if at - begun > seconds:
            break
        told += replies_of(predict, labels, [piece])
        took.append((clock() - at) * 1000)
    return told, took


def model_report(docs: DataFrame, model: Model, text_col: str = "text", critical: bool = False, column: str = "report", is_file: bool = False) -> DataFrame:
    """docs with the model's report, its spans of all windows of the text in the text's offsets, and `<column>_windows`: array<struct<processed,
    ms>>, a window each, for audit.scan_summary().

    A window that fails makes the text's status 'failed' without spans. A text that runs out of time is a 'timeout' which keeps the spans of
    the windows that were done. Neither stops the job. Null texts are 'failed', empty ones 'ok'.
    """
    text = F.col(text_col)
    if model.load is None:
        nothing = F.lit(None).cast(SPANS)
        none = F.array().cast("array<struct<processed:boolean,ms:double>>")
        return docs.withColumns({column: report(model.name, list(model.labels), critical, nothing, text, available=F.lit(False)), f"{column}_windows": none})
    load, labels, clock, bounded = model.load, list(model.labels), model.clock, model.budget is not None

    @F.pandas_udf("struct<replies:array<string>,ms:array<double>,error:string>")
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        try:
            predict, error = load(), None
        except Exception as e:  # whatever a model's load raises is a status of these rows
            predict, error = None, f"load_failed:{type(e).__name__}"
        for some, seconds in batches:
            asked = [list(w) if w is not None else [] for w in some]
            if predict is None:
                answers = [([], [])] * len(asked)
            elif bounded:
                answers = [replies_in_time(predict, labels, w, s, clock) for w, s in zip(asked, seconds)]
            else:
                flat, at = [x for w in asked for x in w], clock()
                told = iter(replies_of(predict, labels, flat) if flat else [])
                mean = (clock() - at) * 1000 / max(1, len(flat))
                answers = [([next(told) for _ in w], [mean] * len(w)) for w in asked]
            yield pd.DataFrame({"replies": [r for r, _ in answers], "ms": [m for _, m in answers], "error": pd.Series([error] * len(asked), dtype="object")})

    cut = windows(text, model.size, model.overlap)
    pieces = lambda ws: F.transform(ws, lambda w: F.substring(text, w["start"] + 1, w["end"] - w["start"]))
    seconds = F.coalesce(model.budget.seconds(F.length(text), is_file), F.lit(0.0)) if bounded else F.lit(0.0)
    named = {x: free_name(docs, x) for x in ("windows", "asked", "located", "full")}
    ws, answer = F.col(named["windows"]), F.col(named["asked"])
    windowed = docs.withColumn(named["windows"], cut).withColumn(named["asked"], ask.asNondeterministic()(pieces(ws), seconds.cast("double")))

    def moved(r: Column, i: Column) -> Column:
        w = F.get(ws, i)
        found = entities_of(r, F.substring(text, w["start"] + 1, w["end"] - w["start"]))["spans"]
        return F.transform(found, lambda x: x.withField("start", x["start"] + w["start"]).withField("end", x["end"] + w["start"]))

    replies, done = answer["replies"], F.size(answer["replies"])
    failed = F.exists(replies, lambda r: r.isNull()) | text.isNull()
    spans = F.when(~F.coalesce(failed, F.lit(True)), F.array_distinct(F.flatten(F.transform(replies, moved))))
    # columns of their own: what is named twice in one expression is computed twice
    located = windowed.withColumn(named["located"], spans)
    located = located.withColumn(named["full"], report(model.name, labels, critical, F.col(named["located"]), text, available=answer["error"].isNull()))
    full = F.col(named["full"])
    kept = F.when(answer["error"].isNull() & (done < F.size(ws)) & (full["status"] == OK), full.withField("status", F.lit(TIMEOUT))).otherwise(full)
    told = F.transform(ws, lambda w, i: F.struct((i < done).alias("processed"), F.get(answer["ms"], i).alias("ms")))
    return located.withColumns({column: kept, f"{column}_windows": told}).drop(*named.values())
