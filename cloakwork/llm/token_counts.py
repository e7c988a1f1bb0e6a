"""Token counts of whole texts, huge ones by overlapping chunks that are spliced.

A text of at most HUGE characters is counted by the library word by word: the
vocabulary's pre-tokenizer drops white space and never joins across it, so a
text's count is the sum over its words, and each distinct word is encoded once a
worker (a bounded memo).

A longer text is encoded in chunks of CHUNK characters that overlap, with
offsets. Their splice is a place of the overlap where both chunks start the same
AGREE tokens: the count takes the first chunk's tokens before it and the second's
from it on. Such a place is stable. A merge vocabulary's encoding of a word is the
one sequence of which every two neighbours, merged by themselves, stay apart; all
neighbours of the spliced sequence are neighbours in one of the chunks (the token
after the splice is in both), so it is the encoding of the whole. That holds
inside a word as well as after a blank, so texts without blanks are spliced too.
Where the overlap has no such place, it widens, at last to the whole left chunk,
and then the two are encoded as one, which doubles. A chunk's encoding is dropped once it is
spliced, so memory holds two chunks.

The vocabulary is checked on loading: its encodings must be cut at blanks.

Defined results
* Null and empty texts have 0 tokens and 0 bytes.
* One row per input row, repeated rows too; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUGE, CHUNK, OVERLAP, AGREE = 32_768, 16_384, 512, 4
MEMO, LONG, LIMIT = 400_000, 64, 2048
#: Blanks for Python and for the library's expressions alike; others stay inside a word and are left to the library.
_WORDS = re.compile(r"[^ \t\n\r]+")
_BLANKS = " \t\n\r"


class Counts:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[str, int] = {}
        for a, b in (("it'", "s"), ("ab", "cd"), ("1", "2"), ("漢", "字"), ("é", "e"), ("-", "-"), (".", "'ll")):
            for blank in _BLANKS:
                apart, whole = self.encode([a, b]), self.encode([a + blank + b])[0]
                if apart[0].ids + apart[1].ids != whole.ids:
                    raise ValueError("the vocabulary joins over blanks: words can't be counted apart")

    def encode(self, texts: list[str]):
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)

    def ordinary(self, texts: list[str]) -> list[int]:
        """Counts by the words of the texts."""
        found = [_WORDS.findall(t) for t in texts]
        memo = self.memo
        new = {w for ws in found for w in ws}.difference(memo)
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = {w for ws in found for w in ws}
        some = list(new)
        for lo in range(0, len(some), 8192):
            part = some[lo : lo + 8192]
            memo.update(zip(part, (len(e) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        out = [sum(map(memo.__getitem__, ws)) for ws in found]
        for w in new:
            if len(w) > LONG:
                del memo[w]
        return out

    def chunk(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Token ids, and the positions in the text where they start."""
        e = self.encode([text[start:end]])[0]
        return np.array(e.ids, dtype=np.int64), np.array([a for a, _ in e.offsets], dtype=np.int64) + start

    def splice(self, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[int, int] | None:
        """Where, in the left and in the right tokens, both go on with the same AGREE tokens: the middle one of such places."""
        (ids, at), (ids2, at2) = left, right
        _, i, j = np.intersect1d(at, at2, return_indices=True)
        good = (i + AGREE <= len(at)) & (j + AGREE <= len(at2)) & (j > 0)
        i, j = i[good], j[good]
        for k in range(AGREE):
            same = (at[i + k] == at2[j + k]) & (ids[i + k] == ids2[j + k])
            i, j = i[same], j[same]
        return (int(i[len(i) // 2]), int(j[len(j) // 2])) if len(i) else None

    def rest(self, text: str, begin: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens from begin, where one starts, to stop: with words before begin, which may lie inside one."""
        back = OVERLAP
        while True:
            ids, at = self.chunk(text, max(0, begin - back), stop)
            k = int(np.searchsorted(at, begin))
            if back >= begin or (k > 0 and k < len(at) and at[k] == begin):
                return ids[k:], at[k:]
            back *= 2

    def huge(self, text: str) -> int:
        total, begin, end = 0, 0, min(CHUNK, len(text))
        left = self.chunk(text, 0, end)
        while end < len(text):
            stop, overlap, found = min(len(text), end + CHUNK), OVERLAP, None
            while found is None and (start := end - overlap) > begin:
                right = self.chunk(text, start, stop)
                found = self.splice(left, right)
                overlap = 2 * overlap + 1  # an odd step: a text that repeats itself may need another start
            if found is None:  # nothing to align: one chunk of both, and more of the text
                end = min(len(text), end + max(CHUNK, end - begin))
                left = self.rest(text, begin, end)
                continue
            i, j = found
            total += i
            left, begin, end = (right[0][j:], right[1][j:]), int(right[1][j]), stop
        return total + len(left[0])

    def count(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        small = [i for i, t in enumerate(texts) if t and len(t) <= HUGE]
        for i, n in zip(small, self.ordinary([texts[i] for i in small])):
            out[i] = n
        for i, t in enumerate(texts):
            if t and len(t) > HUGE:
                out[i] = self.huge(t)
        return out


@lru_cache(maxsize=1)
def loaded(path: str) -> Counts:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    return Counts(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. path: a tokenizer file that drops white space in its pre-tokenizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = loaded(path)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                texts = part.column(1).to_pylist()
                n = pa.array(counts.count(texts), pa.int64())
                size = pa.array([len((t or "").encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, n], names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
