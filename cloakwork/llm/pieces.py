"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is cut into marked words: a run of word marks and the characters up to
the next mark. No piece of the vocabulary has a mark after another character
(checked on loading), so no merge crosses a cut and words are encoded apart.
The distinct words of a batch are sorted, which walks their trie depth-first:
each word goes on from the forward states of the prefix that it shares with the
one before.

The vocabulary at hand is a merge vocabulary, not a unigram one, so the best sum
of scores isn't what the library returns. The forward state of a prefix is
instead the last piece of its one valid encoding: a piece that ends here may
follow the state where it starts only if merging the two together leaves them
apart. Every text has exactly one encoding whose neighbours are all valid, so the
pass is exact, and one state a position is kept, as in Viterbi's. Characters that
have no piece become byte pieces.

Defined results
* Null and empty texts have no pieces; decoding them gives the empty text.
* Texts of any length are whole: words are walked without recursion.
* Repeated rows give equal rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.shared import giving_back

MARK = "▁"
#: Marked words, and pairs of pieces, that a worker remembers: bounds its memory.
MEMO, PAIRS = 200_000, 300_000
#: Documents whose words are sorted together.
DOCS = 1024
#: A word longer than this is encoded but not remembered.
LONG = 64
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_UNKNOWN = -1


class Pieces:
    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.control = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        plain = [i for i in range(n) if i not in self.control and i not in self.byte_of and not sp.is_unused(i)]
        self.id = {self.piece[i]: i for i in plain}
        self.score = {self.piece[i]: sp.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has a word mark inside: words can't be encoded apart")
        # a piece that merging its own characters doesn't give can't be in any encoding
        self.id = {p: i for p, i in self.id.items() if len(p) == 1 or self.merged(p) == [p]}
        #: a trie of the pieces read backwards; "" holds the id of a piece that starts here
        self.back: dict = {}
        for p, i in self.id.items():
            node = self.back
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = i
        #: what each piece decodes to by itself; bytes over 7F need their neighbours
        self.plain = ["" if i in self.control else chr(self.byte_of[i]) if i in self.byte_of else p for i, p in enumerate(self.piece)]
        self.needs_bytes = np.array([self.byte_of.get(i, 0) > 0x7F for i in range(n)])
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, by merging neighbours, best score first and leftmost of equals."""
        parts, score = list(text), self.score.get
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = score(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether piece b may come right after piece a."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        x, y = self.piece[a], self.piece[b]
        known = self.pairs[a << 20 | b] = x + y not in self.id and self.merged(x + y) == [x, y]
        return known

    def forward(self, word: str, ends: list[tuple[int, int]], start: int) -> None:
        """Extends ends, where ends[i] is (length, id) of the last piece of word[:i], from position start."""
        del ends[start + 1 :]
        back, pairs, may_follow = self.back, self.pairs, self.may_follow
        for i in range(start, len(word)):
            node, found, j = back, [], i
            while j >= 0 and (node := node.get(word[j])) is not None:
                if (p := node.get("")) is not None:
                    found.append((j, p))
                j -= 1
            state = (1, _UNKNOWN)
            for j, p in reversed(found):
                if j:
                    a = ends[j][1]
                    if a != _UNKNOWN:
                        ok = pairs.get(a << 20 | p)
                        if not (may_follow(a, p) if ok is None else ok):
                            continue
                state = (i + 1 - j, p)
                break
            ends.append(state)

    def read_back(self, word: str, ends: list[tuple[int, int]]) -> tuple[int, ...]:
        out: list[int] = []
        i = len(word)
        while i:
            size, p = ends[i]
            if p == _UNKNOWN:
                out.extend(self.byte_id[b] for b in reversed(word[i - size : i].encode("utf-8", "surrogatepass")))
            else:
                out.append(p)
            i -= size
        return tuple(reversed(out))

    def learn(self, new: set[str]) -> dict[str, tuple[int, ...]]:
        """Encodes the words in sorted order, each from the prefix shared with the one before."""
        found: dict[str, tuple[int, ...]] = {}
        ends: list[tuple[int, int]] = [(0, _UNKNOWN)]
        last = ""
        for word in sorted(new):
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            self.forward(word, ends, shared)
            found[word] = self.read_back(word, ends)
            last = word
        return found

    def cut(self, text: str | None) -> list[str]:
        return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        # a word of many texts is held once, not once a place: the memory that words leave behind lies among those that are remembered
        once: dict[str, str] = {}
        cut = [list(map(once.setdefault, ws, ws)) for ws in map(self.cut, texts)]
        new = set(once).difference(self.words)
        if len(self.words) + len(new) > MEMO:
            self.words.clear()
            new = set(once)
        collecting = gc.isenabled()
        gc.disable()  # many small tuples and no cycles
        try:
            self.words.update(self.learn(new))
            get = self.words.__getitem__
            return [np.fromiter(chain.from_iterable(map(get, ws)), dtype=np.int32) for ws in cut]
        finally:
            for w in new:
                if len(w) > LONG:
                    self.words.pop(w, None)
            if collecting:
                gc.enable()

    def decode(self, ids) -> str:
        """The text of the pieces; control pieces give nothing."""
        ids = np.asarray(ids, dtype=np.int32)
        if not self.needs_bytes[ids].any():
            text = "".join(map(self.plain.__getitem__, ids.tolist())).replace(MARK, " ")
            return text[1:] if text.startswith(" ") else text
        parts: list[str] = []
        pending = bytearray()
        for i in ids.tolist():
            b = self.byte_of.get(i)
            if b is not None:
                pending.append(b)
                continue
            if pending:
                parts.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if i not in self.control:
                parts.append(self.piece[i])
        if pending:
            parts.append(pending.decode("utf-8", "replace"))
        text = "".join(parts).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=1)
def loaded(model: str) -> Pieces:
    """One vocabulary a worker, kept with its memory between tasks."""
    return Pieces(model)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """One row per input row: doc_id, n_pieces, pieces (array of ids), decodes (the pieces decode to the text: true but for texts with marks of their own)."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for b in batches:
            for lo in range(0, b.num_rows, DOCS):
                part = b.slice(lo, DOCS)
                texts = part.column(1).to_pylist()
                found = pieces.encode_batch(texts)
                size = np.array([len(x) for x in found], dtype=np.int32)
                flat = np.concatenate(found) if found else np.zeros(0, np.int32)
                ids = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(flat, pa.int32()))
                ok = pa.array([pieces.decode(x) == (t or "") for x, t in zip(found, texts)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), ids, ok], names=["doc_id", "n_pieces", "pieces", "decodes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pieces int, pieces array<int>, decodes boolean")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """One row per input row: doc_id, text. encoded: doc_id, pieces (null: the empty text; an id that isn't in the vocabulary stops the job)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for b in batches:
            texts = [pieces.decode(x) if x is not None and len(x) else "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("pieces").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
