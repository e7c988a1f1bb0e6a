"""Scan: normalise, run every recognizer, collapse duplicates, map back to the text's own offsets.

Everything stays in the row (an array of spans), so a scan is a narrow
projection whatever the size of the table; explode_spans() gives a row a span.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.functions.positions import let
from cloakwork.operators.describing import quickly
from cloakwork.operators.recognizers import Config, Recognizer, folded, no_spans, registry, spans_of
from cloakwork.operators.tables import exploded

#: Characters that are dropped, and dashes that become '-'.
DROPPED = "\u200B\u200C\u200D\u2060\uFEFF\u00AD"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
#: What needs the slow path: the above, and the blocks with compatibility forms.
ODD = (
    r"[\u00A0-\u00BF\u0132-\u0133\u013F-\u0140\u0149\u017F\u01C4-\u01CC\u01F1-\u01F3\u02B0-\u02DD\u02E0-\u02E4\u0340-\u0344\u0374\u037A\u037E\u0384-\u0387\u03D0-\u03D6\u03F0-\u03FA\u0587\u0675-\u0678\u0E33\u0EB3\u0EDC-\u0ED"
    r"D\u0F0C\u0F77\u0F79\u10FC\u1D2C-\u1DBF\u1E9A-\u1E9B\u1FBD-\u1FFE\u2000-\u2BFF\u2C7C-\u2C7D\u2D6F\u2E9F\u2EF3\u2F00-\u2FD5\u3000-\u33FF\uA69C-\uA69D\uA770\uA7F1-\uA7F9\uAB5C-\uAB69\uF900-\uFDFF\uFE00-\uFEFF\uFF00-\uFFEF\x{1D400}-\x{1F2FF}\x{2F800}-\x{2FA1F}]"
)


@lru_cache(maxsize=65_536)
def plain(char: str) -> str:
    """What a character counts as: its compatibility form, with one kind of dash; nothing for those that are dropped."""
    return "" if char in DROPPED else unicodedata.normalize("NFKC", char).translate(dict.fromkeys(map(ord, DASHES), "-"))


def normalised(text: str) -> tuple[str, np.ndarray]:
    """The text of plain characters, and the place in text that each of them came from."""
    parts = list(map(plain, text))
    return "".join(parts), np.repeat(np.arange(len(parts), dtype=np.int32), list(map(len, parts)))


#: Bits of the word index; of more rules several share one, and run if a word of any of them is there.
BITS = 62


@lru_cache(maxsize=4)
def word_index(words: tuple[tuple[str, int], ...]):
    """An automaton of all rules' words in lower case: one pass over a text finds them all. Each word has the bits of its rules."""
    import ahocorasick

    bits: dict[str, int] = {}
    for word, bit in words:
        bits[word.lower()] = bits.get(word.lower(), 0) | 1 << bit
    found = ahocorasick.Automaton()
    for word, of_rules in bits.items():
        found.add_word(word, of_rules)
    found.make_automaton()
    return found, reduce(int.__or__, bits.values())


def hinted(text: str, index) -> int:
    """The bits of the rules that have a word in the text."""
    if index is None:
        return 0
    automaton, all_bits = index
    out = 0
    low = text.lower() if text.isascii() else text.translate(_I).lower()
    for _, bits in automaton.iter(low):
        out |= bits
        if out == all_bits:
            break
    return out


_I = {0x130: "i", 0x131: "i"}  # as recognizers.folded has them
READ = T.StructType([T.StructField("text", T.StringType()), T.StructField("index", T.ArrayType(T.IntegerType())), T.StructField("hints", T.LongType())])


@lru_cache(maxsize=64)
def reader(words: tuple[tuple[str, int], ...]):
    """(odd text or null, text) to the plain form of an odd text with its index, and the hints of every text's plain form."""

    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = word_index(words) if words else None
        for odd, texts in batches:
            plain_ = [normalised(t) if t is not None else (None, None) for t in odd]
            hints = [0 if t is None else hinted(t if p is None else p, index) for t, (p, _) in zip(texts, plain_)]
            yield pd.DataFrame({"text": [t for t, _ in plain_], "index": [i for _, i in plain_], "hints": hints})

    return F.pandas_udf(read, READ)


def collapse(spans: Column) -> Column:
    """Of spans with equal (start, end, label) the one of most evidence, then score; in order of start, longest first, label."""
    rank = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), (-s["end"]).alias("back"), s["label"].alias("label"), (~F.coalesce(s["validated"], F.lit(False))).alias("unproved"),
            (-s["score"]).alias("low"), s.alias("s"),
        ),
    )
    ordered = F.array_sort(rank)
    same = lambda a, b: (a["start"] == b["start"]) & (a["back"] == b["back"]) & (a["label"] == b["label"])
    return let(
        ordered,
        lambda r: F.transform(F.filter(r, lambda x, i: (i == 0) | ~same(x, F.get(r, i - 1))), lambda x: x["s"]),
    )


@quickly
def raw_spans(text: Column, recognizers: list[Recognizer], low: Column | None = None, hints: Column | None = None, name: str | None = None) -> Column:
    """The spans of all recognizers. hints: bit i % BITS is set where the text has a word of rule i. name: of text's column, if it is one."""
    has = lambda i: None if hints is None else hints.bitwiseAND(F.lit(1 << i % BITS)) != 0
    return collapse(F.flatten(F.array(*[spans_of(text, r, low, has(i) if r.words else None, name) for i, r in enumerate(recognizers)])))


def mapped_back(spans: Column, index: Column) -> Column:
    """The spans in the offsets of the text that index came from; a null index leaves them."""
    moved = lambda s: s.withField("start", F.get(index, s["start"])).withField("end", F.get(index, s["end"] - 1) + 1)
    return F.transform(spans, lambda s: F.when(index.isNull(), s).otherwise(moved(s)))


@lru_cache(maxsize=16)
def _spans_column(recognizers: tuple[Recognizer, ...], gateway: int) -> Column:
    """The spans of the column _t, _low being its lower case and _hints its hints. Some fifty recognizers are thousands of calls to the
    JVM, so the column is kept for later scans. They are the body of one lambda: an expression of that size is too large to be
    compiled, and each task would try; so the rest of the plan compiles, and of the rules only those run that have a word in the text."""
    return let(F.lit(0), lambda _: raw_spans(F.col("_t"), list(recognizers), F.col("_low"), F.col("_hints"), "_t"))


@quickly
def scan(docs: DataFrame, text_col: str = "text", config: Config = Config(), recognizers: list[Recognizer] | None = None) -> DataFrame:
    """docs with the column spans: array<SPAN>. A null text has no spans; texts of any length are scanned whole.

    One pass: in Python each text's words are looked up in an index of all rules' words, and texts with odd characters get their
    normal form; rules are native.
    """
    chosen = tuple(registry(config) if recognizers is None else recognizers)
    text = F.col(text_col)
    words = tuple((w, i % BITS) for i, r in enumerate(chosen) for w in r.words)
    read = docs.withColumn("_n", reader(words)(F.when(text.rlike(ODD), text), text))
    n = read.withColumns({"_t": F.coalesce("_n.text", text_col), "_hints": F.col("_n.hints")}).withColumn("_low", folded(F.col("_t")))
    found = F.when(text.isNull(), no_spans()).otherwise(_spans_column(chosen, id(docs.sparkSession.sparkContext._gateway)))
    return n.withColumn("spans", mapped_back(found, F.col("_n.index"))).drop("_n", "_t", "_low", "_hints")


def explode_spans(scanned: DataFrame, keys: list[str], text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """One row a span: the keys, the span's fields and its value."""
    one = exploded(scanned, spans_col, "s", *keys, text_col)
    value = F.substring(F.col(text_col), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return one.select(*keys, "s.*", value.alias("value"))
