"""Positions of regular-expression matches as native columns.

Spark gives the strings of all matches and the strings between them; their
lengths, summed up, are the positions. Offsets are half-open and count code
points.

Spark's arrays can't be added to in place, and a string is counted from its start
to reach a character. So sums run within blocks of an array, blocks of blocks and
so on, and pieces of a text are cut from its blocks: the work grows with the number
of matches or edits, and with the length of the text, not with their product.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of an array that are summed one after the other; characters of a text's block.
RUN, BLOCK = 128, 2048


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _short(steps: Column, op, zero: int) -> Column:
    empty = F.array().cast("array<int>")
    return F.aggregate(steps, empty, lambda acc, x: F.concat(acc, F.array(op(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(zero)), x))))


def running(steps: Column, op=_plus, zero: int = 0) -> Column:
    """What op makes of each element and all before it, of an array of ints: within blocks of RUN elements, and of what the blocks come to."""

    def in_blocks(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / RUN).cast("int")), lambda i: _short(F.slice(s, i * RUN + 1, F.lit(RUN)), op, zero))
        return let(blocks, lambda parts: let(_short(F.transform(parts, lambda p: F.element_at(p, -1)), op, zero), lambda sums: moved(parts, sums)))

    def moved(parts: Column, sums: Column) -> Column:
        return F.flatten(F.transform(parts, lambda p, i: let(F.coalesce(F.get(sums, i - 1), F.lit(zero)), lambda start: F.transform(p, lambda x: op(x, start)))))

    return let(steps, lambda s: F.when(F.size(s) <= RUN, _short(s, op, zero)).otherwise(in_blocks(s)))


def running_sum(steps: Column) -> Column:
    """Inclusive running sums of an array of ints."""
    return running(steps)


def running_max(values: Column) -> Column:
    """The greatest so far, for each of an array of ints."""
    return running(values, F.greatest, -(2**31))


def sums_before(steps: Column) -> Column:
    """The sum of the elements before each: 0 first."""
    return let(running_sum(steps), lambda sums: F.transform(sums, lambda _, i: F.coalesce(F.get(sums, i - 1), F.lit(0))))


def sql_text(value: str) -> str:
    """A string as a SQL literal, whatever the session's rules on escapes."""
    return f"cast(X'{value.encode().hex()}' AS STRING)"


def _sum_sql(steps: str) -> str:
    """running_sum() as SQL."""
    short = lambda a: f"aggregate({a}, cast(array() AS array<int>), (acc, z) -> concat(acc, array(coalesce(try_element_at(acc, -1), 0) + z)))"
    let_ = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    moved = f"flatten(transform(p, (q, j) -> {let_('coalesce(get(m, j - 1), 0)', 'o', 'transform(q, y -> y + o)')}))"
    sums = let_(short("transform(p, q -> element_at(q, -1))"), "m", moved)
    blocks = f"transform(sequence(0, cast(floor((size(a) - 1) / {RUN}) AS int)), k -> {short(f'slice(a, k * {RUN} + 1, {RUN})')})"
    return let_(steps, "a", f"if(size(a) <= {RUN}, {short('a')}, {let_(blocks, 'p', sums)})")


def matches_in(name: str, pattern: str, group: int = 0) -> Column:
    """matches() in the column of that name, as one expression: quicker to describe where there are many."""
    p = sql_text(pattern)
    value = f", 'v', regexp_extract_all({name}, {p}, {group})" if group else ""
    parts = f"named_struct('h', regexp_extract_all({name}, {p}, 0), 'g', split({name}, {p}, -1){value})"
    ends = _sum_sql("transform(s.h, (h, i) -> length(get(s.g, i)) + length(h))")
    found = "transform(t.v, (v, i) -> named_struct('start', get(t.e, i) - length(v), 'end', get(t.e, i), 'value', v, 'hit', get(t.h, i)))"
    placed = f"element_at(transform(array(named_struct('h', s.h, 'v', s.{'v' if group else 'h'}, 'e', {ends})), t -> {found}), 1)"
    return F.expr(f"element_at(transform(array({parts}), s -> {placed}), 1)")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start,end,value,hit>> of the non-overlapping matches. With a group, value is that group, which must end
    the match; hit is the whole match. The pattern must not match the empty string."""
    p = F.lit(pattern)
    hits = [F.regexp_extract_all(text, p, F.lit(0)).alias("h")]
    values = [F.regexp_extract_all(text, p, F.lit(group)).alias("v")] if group else []
    parts = F.struct(*hits, F.split(text, pattern, -1).alias("g"), *values)

    def place(s: Column) -> Column:
        steps = F.transform(s["h"], lambda h, i: F.length(F.get(s["g"], i)) + F.length(h))
        ends = running_sum(steps)
        return let(
            F.struct(s["h"].alias("h"), s["v" if group else "h"].alias("v"), ends.alias("e")),
            lambda t: F.transform(
                t["v"],
                lambda v, i: F.struct((F.get(t["e"], i) - F.length(v)).alias("start"), F.get(t["e"], i).alias("end"), v.alias("value"), F.get(t["h"], i).alias("hit")),
            ),
        )

    return let(parts, place)


def before(text: Column, start: Column, n: int) -> Column:
    """The n characters before start, or as many as there are."""
    return F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))


def after(text: Column, end: Column, n: int) -> Column:
    return F.substring(text, end + 1, F.lit(n))


def blocks_of(text: Column) -> Column:
    """text in pieces of BLOCK characters; an array of the text itself where it is short."""
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text in blocks."""
    a, z = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    head = F.substring(F.get(blocks, a), start - a * BLOCK + 1, F.least(end - start, F.lit(BLOCK)))
    tail = F.substring(F.get(blocks, z), F.lit(1), end - z * BLOCK)
    middle = F.when(z - a > 1, F.array_join(F.slice(blocks, a + 2, z - a - 1), "")).otherwise("")
    return F.when(end <= start, "").when(a == z, head).otherwise(F.concat(head, middle, tail))


def splice(text: Column, edits: Column) -> Column:
    """text with edits, an array of disjoint struct<start,end,replacement> in order."""
    kept_from = lambda e, i: F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1)["end"])

    def spliced(s: Column) -> Column:
        parts = F.transform(s["e"], lambda x, i: F.concat(cut(s["b"], kept_from(s["e"], i), x["start"]), x["replacement"]))
        rest = cut(s["b"], F.coalesce(F.try_element_at(s["e"], F.lit(-1))["end"], F.lit(0)), s["n"])
        return F.concat(F.array_join(parts, ""), rest)

    return let(F.struct(blocks_of(text).alias("b"), edits.alias("e"), F.length(text).alias("n")), spliced)
