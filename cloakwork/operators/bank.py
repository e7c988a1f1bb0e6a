"""The archived bank of looser patterns, beside the recognizers: for comparing models with rules, not for masking by default.

Each rule is a pattern with at most a check; what it finds has no cue and no
proof beyond that. `bank_rules()` are recognizers like any other, so scan() and
Config(extra=...) take them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions import fixed as P
from cloakwork.functions import validators as V
from cloakwork.operators.describing import quickly
from cloakwork.operators.merge import evidence
from cloakwork.operators.recognizers import Recognizer


def loose_luhn(v: Column) -> Column:
    """Twelve to nineteen digits with a right checksum, whatever stands between them."""
    d = V.digits_only(v)
    return F.when(F.length(d).between(12, 19), V.luhn(d)).otherwise(False)


def egyptian_id(v: Column) -> Column:
    """Fourteen digits: a century (2 or 3), then a date that the calendar has."""
    d = V.digits_only(v)
    year = F.when(F.substring(d, 1, 1) == "2", "19").otherwise("20")
    date = F.concat_ws("-", F.concat(year, F.substring(d, 2, 2)), F.substring(d, 4, 2), F.substring(d, 6, 2))
    return F.when(d.rlike(r"^[23]\d{13}$"), date.try_cast("date").isNotNull()).otherwise(False)


def loose_iban(v: Column) -> Column:
    s = F.upper(F.regexp_replace(v, " ", ""))
    moved = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    step = lambda a, c: F.when(c.rlike("[A-Z]"), a * 100 + F.ascii(c) - 55).otherwise(a * 10 + V.number(c)) % 97
    rest = F.aggregate(V.chars(moved), F.lit(0).cast("long"), lambda a, c: step(a, c).cast("long"))
    return F.when(s.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$"), rest == 1).otherwise(False)


def loose_swift(v: Column) -> Column:
    return F.upper(F.regexp_replace(v, " ", "")).rlike(r"^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$")


def loose_aba(v: Column) -> Column:
    d = V.digits_only(v)
    total = sum((F.substring(d, i + 1, 1).cast("int") * (3, 7, 1)[i % 3] for i in range(9)), F.lit(0))
    return F.when(F.length(d) == 9, total % 10 == 0).otherwise(False)


def loose_wallet(v: Column) -> Column:
    n, low = F.length(v), F.lower(v)
    return F.when(low.startswith("bc1"), n.between(42, 62)).when(low.startswith("0x"), low.rlike("^0x[0-9a-f]{40}$")).otherwise(v.rlike("^[13]") & n.between(26, 35))


CHECKS: dict[str, Callable[[Column], Column]] = {
    "luhn": loose_luhn, "egyptian": egyptian_id, "iban": loose_iban, "swift": loose_swift, "aba": loose_aba, "wallet": loose_wallet, "ssn": V.ssn,
}


def bank_rules(labels: frozenset[str] | None = None) -> list[Recognizer]:
    """The bank's rules as recognizers named bank_..., of some labels or of all."""
    return [
        Recognizer(f"bank_{label.lower()}", (label,), pattern, score=0.5, validator=CHECKS.get(check), guard=pattern)
        for label, pattern, check in P.BANK
        if labels is None or label in labels
    ]


def by_source(spans: Column, primary: dict[str, str], default: str) -> Column:
    """Spans of several sources, merged by who is trusted for a label: each label's primary source counts first (another label's
    is `default`'s), then evidence, score and length; a span stays if it meets none that stays before it."""
    table = F.create_map(*[F.lit(x) for kv in primary.items() for x in kv]) if primary else None

    def rank(s: Column) -> Column:
        trusted = F.coalesce(F.try_element_at(table, s["label"]), F.lit(default)) if table is not None else F.lit(default)
        other = (~s["source"].startswith(trusted)).cast("int")
        return F.struct(other.alias("other"), (-evidence(s["validated"], s["context"])).alias("proof"), (-s["score"]).alias("score"), (s["start"] - s["end"]).alias("size"), s["start"].alias("start"), s.alias("s"))

    ordered = F.transform(F.array_sort(F.transform(spans, rank)), lambda r: r["s"])
    free = lambda kept, s: ~F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
    kept = F.aggregate(ordered, F.slice(spans, 1, 0), lambda acc, s: F.when(free(acc, s), F.concat(acc, F.array(s))).otherwise(acc))
    return F.array_sort(kept)
