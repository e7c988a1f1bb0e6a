"""Fakes put back: each text against all fakes of its conversation, in one pass over the text.

A conversation's fakes can have any shape. They are compiled into one automaton,
which finds every occurrence of every fake while it reads a text once; of those that
overlap, the one that starts first wins, and of those that start at one place the
longest. A fake that starts or ends with a letter, digit or underscore isn't taken
out of a longer word.

Scale: entries and texts of a conversation are dealt to one part and sorted entries
first, so a task holds the entries of one conversation (their number is capped) and
streams its texts. A conversation of very many texts is dealt to several parts, each
of which gets the entries.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.operators.tables import materialised

#: Texts of a conversation that one part takes, and the most conversations that are dealt to more than one.
PART_TEXTS, HOT = 4096, 1000
#: Automata that a worker keeps, for the next part of a conversation with the same entries.
KEPT = 8


def in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Finder:
    """All fakes of a conversation."""

    def __init__(self, real_of: dict[str, str]):
        import ahocorasick

        self.real_of = {f: r for f, r in real_of.items() if f}
        self.found = ahocorasick.Automaton()
        for fake in self.real_of:
            self.found.add_word(fake, (len(fake), in_word(fake[0]), in_word(fake[-1]), fake))
        if self.real_of:
            self.found.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, fake) of those that are put back, in order."""
        if not self.real_of:
            return []
        whole = []
        for last, (n, left, right, fake) in self.found.iter(text):
            start, end = last + 1 - n, last + 1
            if left and start and in_word(text[start - 1]) or right and end < len(text) and in_word(text[end]):
                continue
            whole.append((start, -end, fake))
        whole.sort()
        out, at = [], 0
        for start, back, fake in whole:
            if start >= at:
                at = -back
                out.append((start, at, fake))
        return out

    def restored(self, text: str) -> tuple[str, int]:
        hits = self.hits(text)
        parts, at = [], 0
        for start, end, fake in hits:
            parts += text[at:start], self.real_of[fake]
            at = end
        return "".join(parts) + text[at:], len(hits)


_kept: OrderedDict[tuple, Finder] = OrderedDict()


def finder(conv: str | None, real_of: dict[str, str]) -> Finder:
    """The conversation's automaton; kept as long as its entries stay the same."""
    key = conv, len(real_of), hash(frozenset(real_of.items()))
    known = _kept.pop(key, None) or Finder(real_of)
    _kept[key] = known
    while len(_kept) > KEPT:
        _kept.popitem(last=False)
    return known


def restore(masked: DataFrame, key_col: str, conv: str, vault: DataFrame, text: str = "masked_text") -> DataFrame:
    """key, restored_text, n_restored of every row of masked; a null text stays null. vault: conv_id, fake, real; where a conversation
    has a fake twice, the least of its values is taken."""
    kind = masked.schema[key_col].dataType
    texts = materialised(masked.select(F.col(conv).cast("string").alias("conv_id"), F.col(key_col).alias("key"), F.col(text).alias("a")))
    entries = vault.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("fake").alias("a"), F.col("real").alias("b"))
    parts = F.least(F.ceil(F.col("n") / PART_TEXTS), F.lit(int(masked.sparkSession.conf.get("spark.sql.shuffle.partitions")))).cast("int")
    many = texts.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > PART_TEXTS).orderBy(F.desc("n"), "conv_id").limit(HOT)
    many = F.broadcast(materialised(many.select(F.col("conv_id").alias("many"), parts.alias("parts"))))
    dealt = lambda df: df.join(many, F.col("conv_id").eqNullSafe(F.col("many")), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = dealt(texts).select("conv_id", F.pmod(F.xxhash64("key", "a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("is_text"), "key", "a", F.lit(None).cast("string").alias("b"))
    theirs = dealt(entries).select(
        "conv_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("is_text"), F.lit(None).cast(kind).alias("key"), "a", "b"
    )
    rows = own.unionByName(theirs).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "is_text", F.desc("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, real_of, known = None, {}, None
        for b in batches:
            places, done, counts = [], [], []
            columns = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "part", "is_text", "a", "b"))
            for i, (conv_id, part, is_text, a, real) in enumerate(zip(*columns)):
                if now != (conv_id, part):
                    now, real_of, known = (conv_id, part), {}, None
                if not is_text:
                    if a is not None and real is not None:
                        real_of[a] = real
                    continue
                known = known or finder(conv_id, real_of)
                out, n = (None, 0) if a is None else known.restored(a)
                places.append(i)
                done.append(out)
                counts.append(n)
            keys = b.column(b.schema.get_field_index("key")).take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(done, pa.string()), pa.array(counts, pa.int32())], names=[key_col, "restored_text", "n_restored"])

    schema = T.StructType([T.StructField(key_col, kind), T.StructField("restored_text", T.StringType()), T.StructField("n_restored", T.IntegerType())])
    return rows.mapInArrow(run, schema)
