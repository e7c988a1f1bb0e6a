"""Residual scan of masked text: hard evidence only, stated apart from the recognizers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions import fixed
from cloakwork.functions.positions import after, before, matches
from cloakwork.operators.describing import quickly

FINDING = "struct<type:string,start:int,end:int,reason:string>"


def _finding(kind: str, start: Column, end: Column, reason: str) -> Column:
    return F.struct(F.lit(kind).alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(reason).alias("reason"))


def _issuer(d: Column) -> Column:
    n = F.length(d)
    p = lambda k: F.substring(d, 1, k).cast("int")
    return (
        (d.startswith("4") & n.isin(13, 16, 19)) | ((n == 16) & (p(2).between(51, 55) | p(4).between(2221, 2720))) | ((n == 15) & p(2).isin(34, 37))
        | (n.between(16, 19) & ((p(4) == 6011) | p(2).isin(62, 65) | p(3).between(644, 649)))
        | (n.between(14, 19) & (p(3).between(300, 305) | p(2).isin(36, 38, 39))) | (n.between(16, 19) & p(4).between(3528, 3589))
    )


def _sum97(v: Column) -> Column:
    moved = F.concat(F.substring(v, 5, 99), F.substring(v, 1, 4))
    digits = F.transform(F.regexp_extract_all(moved, F.lit("."), F.lit(0)), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda a, d: ((a * F.when(d > 9, 100).otherwise(10) + d) % 97).cast("int"))


@quickly
def residual_scan(text: Column) -> Column:
    """array<FINDING>; never the value. Empty: nothing was left."""
    none = F.array().cast(f"array<{FINDING}>")
    guarded = lambda guard, found: F.when(text.rlike(guard), found).otherwise(none)

    def cards(m: Column) -> Column:
        d = F.regexp_replace(m["value"], "[^0-9]", "")
        return F.when(F.length(d).between(13, 19), F.call_function("luhn_check", d) & _issuer(d)).otherwise(False)

    def in_long_run(m: Column) -> Column:
        """Is m among numbers, single blanks or hyphens between, with more digits than a card has? The nearest 16 characters tell."""
        digits = lambda part: F.length(F.regexp_replace(part, "[^0-9]", ""))
        first, last = F.regexp_extract(before(text, m["start"], 16), "(?:[0-9]+[ -])+$", 0), F.regexp_extract(after(text, m["end"], 16), "^(?:[ -][0-9]+)+", 0)
        return digits(first) + digits(m["value"]) + digits(last) > 19

    # there a number that is long enough counts by itself, whatever those beside it make with it
    several = lambda m: m["value"].rlike("[ -]") & m["value"].rlike("[0-9]{13}")
    alone = (fixed.RESIDUAL_CARD, lambda m: F.when(cards(m), ~F.when(several(m), in_long_run(m)).otherwise(False)).otherwise(False))
    grouped = (fixed.RESIDUAL_CARD_GROUP, lambda m: F.when(cards(m), in_long_run(m)).otherwise(False))

    def signed(m: Column) -> Column:
        head = F.translate(F.substring_index(m["value"], ".", 1), "-_", "+/")
        padded = F.concat(head, F.repeat(F.lit("="), F.pmod(-F.length(head), F.lit(4))))
        return F.coalesce(F.get_json_object(F.try_to_binary(padded, F.lit("base64")).cast("string"), "$.alg").isNotNull(), F.lit(False))

    def kind(pattern: str, label: str, reason: str, keep=None) -> Column:
        found = matches(text, pattern)
        if keep is not None:
            found = F.filter(found, keep)
        return F.transform(found, lambda m: _finding(label, m["start"], m["end"], reason))

    key = lambda prefix, pattern: F.when(text.contains(prefix), kind(pattern, "API_KEY", "API key prefix survived")).otherwise(none)
    keys = F.flatten(F.array(*[key(*k) for k in fixed.RESIDUAL_KEYS]))
    block = F.when(
        text.contains("-----BEGIN") & text.contains("PRIVATE KEY"),
        F.array(_finding("PRIVATE_KEY", F.instr(text, "-----BEGIN") - 1, F.length(text), "PEM block survived")),
    ).otherwise(none)
    return F.concat(
        guarded(r"[0-9](?:[ -]?[0-9]){12}", F.array_sort(F.array_union(*[kind(p, "CREDIT_CARD", "Luhn-valid card survived", keep) for p, keep in (alone, grouped)]))),
        F.when(text.contains("eyJ"), kind(fixed.RESIDUAL_JWT, "AUTH_TOKEN", "Valid JWT survived", signed)).otherwise(none),
        keys,
        guarded(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10}", kind(fixed.RESIDUAL_IBAN, "IBAN", "Valid IBAN survived", lambda m: _sum97(m["value"]) == 1)),
        block,
    )


def safe_to_send(findings: Column, covered: Column, strict: bool = False) -> Column:
    return (F.size(findings) == 0) & (covered | F.lit(not strict))
