"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by an incremental UTF-8 machine.

The vocabulary is a file of ranks. The merges of a piece of text (a match of the
split pattern) are compiled into a transducer that reads it byte by byte. Two facts
make that possible: a sequence of tokens is the encoding of its bytes if and only if
every two neighbours, merged by themselves, stay apart; so every prefix of a piece
has one encoding, and its last token must go with the one before.

* The transducer before determinisation guesses where tokens end. A path is a node
  of the vocabulary's trie (the bytes of the token being read) and the tokens it has
  given so far. A path that reaches the end of a token may start the next one if the
  two may be neighbours; of all paths exactly one can do so after each byte.
* A state of the determinised one is the set of paths, less the tokens in which all
  of them agree: those are given out at once. A path is no longer than the longest
  token, so tokens wait for a bounded number of bytes. States and their moves are
  built when a text first needs them and kept, up to STATES; beyond, they are built
  anew.
* Many pieces are read abreast, a byte of each at a time: their moves are looked up
  together in one table of numbers. The last few, which are longer than the others,
  are read on one by one.

Decoding reads tokens with a machine whose states are the bytes of a character that
isn't whole yet (at most three). Its moves are built lazily too: a token in a state
gives characters and the next state. Bytes that can't be part of a character become
U+FFFD, one for each longest part of a character, as Python's decoder has it.

Defined results
* Null and empty texts have no tokens; decoding them gives the empty text.
* A piece that is a token as a whole is that token, as in the tiktoken library.
* Texts and pieces of any length are read in one pass and never cut.
* Repeated rows give equal rows; columns besides the named ones are ignored.
* A token that the vocabulary doesn't have makes decoding fail.
"""

from __future__ import annotations

import base64
import gc
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.operators.tables import spread

#: States, pairs of tokens, parts and moves of the decoder that a worker keeps: bounds its memory.
STATES, PAIRS, MEMO, MOVES = 320_000, 340_000, 120_000, 100_000
#: Places of the table of moves, at most half of them taken; a power of 2.
PLACES = 1 << 21
#: Fewer pieces than this aren't read abreast.
FEW = 16
#: A longer part is encoded but not remembered.
LONG = 64
#: Blanks and what follows them up to the next; and white space of another kind before a blank, of which a match may take both.
_PARTS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_UNSURE = re.compile(r"[^\S \n][ \n]")
#: Documents in a batch of the output; characters that are encoded together, and what is taken at once from a longer text.
DOCS, BLOCK = 512, 1 << 20
ROOT, NONE = 0, -1

Path = tuple[int, tuple[int, ...]]


class State:
    """last: the token given before the paths' own. paths: the longest token being read first, at the root last."""

    __slots__ = ("last", "paths", "moves", "number")

    def __init__(self, last: int, paths: tuple[Path, ...], number: int):
        self.last, self.paths, self.number = last, paths, number
        #: of pieces that are read one by one
        self.moves: dict[int, tuple[State, tuple[int, ...]]] | None = None


class Outputs:
    """Runs of tokens by number, one after the other in one array; 0 is the empty run."""

    def __init__(self):
        self.tokens, self.starts, self.numbers = array("i"), array("i", [0, 0]), {(): 0}

    def number(self, tokens: tuple[int, ...]) -> int:
        found = self.numbers.get(tokens)
        if found is None:
            found = self.numbers[tokens] = len(self.starts) - 1
            self.tokens.extend(tokens)
            self.starts.append(len(self.tokens))
        return found

    def join(self, runs: np.ndarray, more: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all runs, and how many each run has; the next numbers stand for more runs, which aren't kept."""
        tokens = np.concatenate([np.array(self.tokens, np.int32), *[np.array(m, np.int32) for m in more]])
        starts = np.concatenate([np.array(self.starts, np.int64), len(self.tokens) + np.cumsum([len(m) for m in more], dtype=np.int64)])
        n = starts[runs + 1] - starts[runs]
        return tokens[np.repeat(starts[runs] - np.cumsum(n) + n, n) + np.arange(n.sum())], n


class Table:
    """(state, byte) to (next state, run of tokens), all of them numbers, looked up many at a time: hashed, to the next free place."""

    def __init__(self):
        self.size = PLACES
        self.keys, self.next, self.runs = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int32), np.zeros(self.size, np.int32)
        self.taken = 0

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B97F4A7C1 >> 24) & (self.size - 1)

    def clear(self) -> None:
        self.keys.fill(-1)
        self.taken = 0

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, and which of the keys aren't there."""
        places = self._first(keys)
        there = self.keys[places]
        odd = np.flatnonzero(there != keys)
        missing = []
        while len(odd):
            free = there[odd] == -1
            missing.append(odd[free])
            odd = odd[~free]
            places[odd] = (places[odd] + 1) & (self.size - 1)
            there[odd] = self.keys[places[odd]]
            odd = odd[there[odd] != keys[odd]]
        return places, np.concatenate(missing) if missing else odd

    def put(self, key: int, state: int, run: int) -> None:
        place = key * 0x9E3779B97F4A7C1 & 0xFFFFFFFFFFFFFFFF
        place = (place - (1 << 64) if place >> 63 else place) >> 24 & self.size - 1
        while self.keys[place] != -1:
            place = (place + 1) & (self.size - 1)
        self.keys[place], self.next[place], self.runs[place] = key, state, run
        self.taken += 1


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Ranks:
    """A vocabulary of ranks and its transducer."""

    def __init__(self, rank: dict[bytes, int]):
        self.rank = rank
        self.token = {rank: token for token, rank in self.rank.items()}
        if missing := [b for b in range(256) if bytes([b]) not in self.rank]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.child: dict[int, int] = {}
        self.ends: list[int] = [NONE]
        self.inner: list[bool] = [False]
        #: the two tokens that are merged last into each token; single bytes have none
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in self.rank.items():
            if len(token) == 1:
                self._grow(token, rank)
            elif len(halves := self.merged(token, 2)) == 2 and self.merged(token) == [rank]:  # else no merging ends in it
                self.halves[rank] = (halves[0], halves[1])
                self._grow(token, rank)
        self.pairs: dict[int, bool] = {}
        #: the tokens that are pieces of text by themselves
        self.whole = {text: rank for token, rank in self.rank.items() if "\ufffd" not in (text := token.decode("utf-8", "replace"))}
        self.states: dict[tuple[int, tuple[Path, ...]], State] = {}
        self.by_number: list[State] = []
        #: the run of tokens that is due if a piece ends in a state
        self.rest = array("i")
        self.outputs, self.table = Outputs(), Table()
        self.start = self._state(NONE, ((ROOT, ()),))
        self.longest_wait = 0

    def merged(self, data: bytes, down_to: int = 1) -> list[int]:
        """The tokens of a few bytes by merging: the pair of least rank first, leftmost of equals, while there are more than down_to."""
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.rank
        while len(parts) > down_to:
            known = [(r, i) for i in range(len(parts) - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
            if not known:
                break
            i = min(known)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [rank[p] for p in parts]

    def _grow(self, token: bytes, rank: int) -> None:
        node = ROOT
        for b in token:
            key = node << 8 | b
            if key not in self.child:
                self.child[key] = len(self.ends)
                self.ends.append(NONE)
                self.inner.append(False)
            self.inner[node] = True
            node = self.child[key]
        self.ends[node] = rank

    def may_follow(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 24 | b)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 24 | b] = self._stay_apart(a, b)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both leaves the two tokens: undone merge by merge, the latest first, no pair that meets at
        the border may have been due before the merge that was undone last (of equal ranks the left one is due first)."""
        rank, token, halves, due = self.rank, self.token, self.halves, len(self.rank) + 256
        while True:
            over = rank.get(token[a] + token[b])
            if over is not None and over < due:
                return False
            left, right = halves.get(a), halves.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and a > b:
                due, a = a, left[1]
            else:
                due, b = b + 1, right[0]

    def _state(self, last: int, paths: tuple[Path, ...]) -> State:
        found = self.states.get((last, paths))
        if found is None:
            if len(self.states) >= STATES:
                self.forget([])
            found = self.states[last, paths] = State(last, paths, len(self.by_number))
            self._enter(found)
        return found

    def _enter(self, state: State) -> None:
        state.number = len(self.by_number)
        self.by_number.append(state)
        self.rest.append(self.outputs.number(state.paths[-1][1]))

    def forget(self, keep: list[State]) -> None:
        """Drops all states but the first and those to keep, which get new numbers, and all moves."""
        for s in self.by_number:
            s.moves = None
        self.states, self.by_number, self.rest = {}, [], array("i")
        self.table.clear()
        for s in (self.start, *keep):
            if (s.last, s.paths) not in self.states:
                self.states[s.last, s.paths] = s
                self._enter(s)

    def move(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """Determinises one move: the next state and the tokens that are sure now."""
        paths, whole = [], None
        child, ends, inner, pairs = self.child, self.ends, self.inner, self.pairs
        for node, given in state.paths:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                paths.append((node, given))
            if whole is None and (token := ends[node]) != NONE:
                before = given[-1] if given else state.last
                ok = before == NONE or pairs.get(before << 24 | token)
                if self.may_follow(before, token) if ok is None else ok:
                    whole = (*given, token)
        paths.append((ROOT, whole))
        given = [g for _, g in paths]
        low, high, sure = min(given), max(given), 0  # all agree in what the first and the last in order agree in
        while sure < len(low) and low[sure] == high[sure]:
            sure += 1
        if len(whole) - sure > self.longest_wait:
            self.longest_wait = len(whole) - sure
        last = whole[sure - 1] if sure else state.last
        kept = tuple([(n, g[sure:]) for n, g in paths]) if sure else tuple(paths)
        if len(low) > sure:
            last = NONE  # each path has a token of its own before the next: states differ in no more
        return self._state(last, kept), whole[:sure]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.rank.get(piece)
        return (whole,) if whole is not None else self.read_on(self.start, piece)

    def read_on(self, state: State, data: bytes) -> tuple[int, ...]:
        """The tokens that data gives from a state on, up to the end of a piece."""
        out = []
        for b in data:
            moves = state.moves
            moved = moves.get(b) if moves is not None else None
            if moved is None:
                moved = self.move(state, b)
                # move may drop all states, so this is noted afterwards
                if state.moves is None:
                    state.moves = {}
                state.moves[b] = moved
            state, sure = moved
            if sure:
                out += sure
        return (*out, *state.paths[-1][1])

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces, and how many each piece has."""
        get = self.whole.get
        token = np.array([get(p, NONE) for p in pieces], np.int32)
        n = np.ones(len(pieces), np.int64)
        merged = token == NONE
        if not (others := np.flatnonzero(merged).tolist()):
            return token, n
        width, found = max(1, min(STATES, PLACES // 2) // 4), []
        for lo in range(0, len(others), width):
            found.append(self._abreast([pieces[i].encode() for i in others[lo : lo + width]]))
        n[merged] = np.concatenate([c for _, c in found])
        out, theirs = np.empty(n.sum(), np.int32), np.repeat(merged, n)
        out[theirs] = np.concatenate([t for t, _ in found])
        out[~theirs] = token[~merged]
        return out, n

    def _abreast(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that aren't tokens, the longest first: those that have a byte i are always the first ones."""
        if len(self.outputs.tokens) > 2 * STATES:
            self.forget([])
            self.outputs = Outputs()
            self.rest = array("i", [self.outputs.number(s.paths[-1][1]) for s in self.by_number])
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-size, kind="stable")
        data, at = np.frombuffer(b"".join(pieces), np.uint8), (np.cumsum(size) - size)[order]
        left = len(pieces) - np.cumsum(np.bincount(size))  # how many are longer than i
        state, i, n = np.zeros(len(pieces), np.int64), 0, len(pieces)
        who, runs = [], []
        while n >= FEW:
            keys = state << 8 | data[at[:n] + i]
            places, missing = self.table.places(keys)
            if len(missing):
                if len(self.states) + len(missing) > STATES or self.table.taken + len(missing) > PLACES // 2:
                    live, which = np.unique(state, return_inverse=True)
                    kept = [self.by_number[s] for s in live.tolist()]
                    self.forget(kept)
                    state = np.array([s.number for s in kept], np.int64)[which]
                    keys = state << 8 | data[at[:n] + i]
                    missing = np.arange(n)
                for key in np.unique(keys[missing]).tolist():
                    after, sure = self.move(self.by_number[key >> 8], key & 255)
                    self.table.put(key, after.number, self.outputs.number(sure))
                places, _ = self.table.places(keys)
            state, run = self.table.next[places].astype(np.int64), self.table.runs[places]
            given = np.flatnonzero(run)
            who.append(given)
            runs.append(run[given])
            i, on = i + 1, int(left[i + 1])
            who.append(np.arange(on, n))
            runs.append(np.array(self.rest, np.int32)[state[on:]] if len(self.rest) < 4 * (n - on) else np.array([self.rest[s] for s in state[on:].tolist()], np.int32))
            state, n = state[:on], on
        states = [self.by_number[s] for s in state[:n].tolist()]
        alone = [self.read_on(s, pieces[k][i:]) for s, k in zip(states, order.tolist())]
        who.append(np.arange(n))
        runs.append(np.arange(n) + len(self.outputs.starts) - 1)
        who, runs = order[np.concatenate(who)], np.concatenate(runs)
        by_piece = np.argsort(who, kind="stable")
        tokens, sizes = self.outputs.join(runs[by_piece], alone)
        return tokens, np.bincount(who[by_piece], sizes, len(pieces)).astype(np.int64)


class Decoder:
    """Tokens to bytes, and to text. A state is the bytes held of a character that isn't whole; moves[held][token] is (text, next state)."""

    def __init__(self, token: dict[int, bytes]):
        self.token = token
        self.moves: dict[bytes, dict[int, tuple[str, bytes]]] = {}
        self.size = 0
        #: what tokens of whole characters give by themselves
        self.plain: dict[int, str] = {}
        self.whole = np.zeros(max(token) + 1, bool)
        self.tokens = pa.array([token.get(t) for t in range(len(self.whole))], pa.binary())
        for t, data in token.items():
            try:
                self.plain[t] = data.decode()
                self.whole[t] = True
            except UnicodeDecodeError:
                pass

    def move(self, held: bytes, token: int) -> tuple[str, bytes]:
        """Compiles one move."""
        if self.size >= MOVES:
            self.moves, self.size = {}, 0
        moved = self.moves.setdefault(held, {})[token] = self.read(held, self.token[token])
        self.size += 1
        return moved

    @staticmethod
    def allowed(held: bytes) -> tuple[int, int]:
        """Which bytes may go on with those held. Fixed values of UTF-8: no overlong forms, no surrogates, nothing over U+10FFFF."""
        if len(held) == 1:
            return {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(held[0], (0x80, 0xBF))
        return 0x80, 0xBF

    @staticmethod
    def length(lead: int) -> int:
        """Of the character that a byte starts; 0 if none starts so."""
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0

    def read(self, held: bytes, data: bytes) -> tuple[str, bytes]:
        out = []
        for b in data:
            if held:
                low, high = self.allowed(held)
                if low <= b <= high:
                    held += bytes([b])
                    if len(held) == self.length(held[0]):
                        out.append(held.decode())
                        held = b""
                    continue
                out.append("�")
                held = b""
            n = self.length(b)
            if n > 1:
                held = bytes([b])
            else:
                out.append(chr(b) if n else "�")
        return "".join(out), held

    def stream(self, tokens: Iterable[int]) -> Iterator[str]:
        """Characters as soon as they are whole."""
        held = b""
        for t in tokens:
            text, held = self.moves.setdefault(held, {}).get(t) or self.move(held, t)
            if text:
                yield text
        if held:
            yield "\ufffd"

    def text(self, ids: np.ndarray) -> str:
        """The characters of all tokens. Runs of tokens that are whole characters leave the machine in the state without held
        bytes, so their texts are looked up; it reads from each other token up to where nothing is held."""
        cuts = np.flatnonzero(~self.whole[ids])
        if not len(cuts):
            return "".join(map(self.plain.__getitem__, ids.tolist()))
        tokens, out, done = ids.tolist(), [], 0
        for at in cuts.tolist():
            if at < done:
                continue
            out += map(self.plain.__getitem__, tokens[done:at])
            held, done = b"", at
            while done < len(tokens):
                text, held = self.moves.setdefault(held, {}).get(tokens[done]) or self.move(held, tokens[done])
                out.append(text)
                done += 1
                if not held:
                    break
            if held:
                out.append("\ufffd")
        out += map(self.plain.__getitem__, tokens[done:])
        return "".join(out)

    def columns(self, ids: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """The bytes and the characters of several texts, whose tokens begin at starts (the last of them is the end).

        Bytes are gathered for all tokens at once. The machine reads the tokens that aren't whole characters: a text where it
        gives no U+FFFD and holds nothing at the end of a run of them has its characters in these bytes, others are read whole."""
        found = self.tokens.take(pa.array(ids))
        if found.null_count:
            raise KeyError("a token that the vocabulary doesn't have")
        _, offsets, data = found.buffers()
        offsets = np.frombuffer(offsets, np.int32)[starts] if len(ids) else np.zeros(len(starts), np.int32)
        at = np.flatnonzero(~self.whole[ids])
        texts = np.searchsorted(starts[:-1], at, "right") - 1
        first = np.diff(at, prepend=-2) != 1
        first[1:] |= texts[1:] != texts[:-1]
        odd, held, before = set(), b"", -1
        for t, begins, i in zip(ids[at].tolist(), first.tolist(), texts.tolist()):
            if begins:
                if held:
                    odd.add(before)
                held = b""
            text, held = self.moves.setdefault(held, {}).get(t) or self.move(held, t)
            if "\ufffd" in text:
                odd.add(i)
            before = i
        if held:
            odd.add(before)
        n, offsets = len(starts) - 1, pa.py_buffer(offsets)
        raw = pa.Array.from_buffers(pa.binary(), n, [None, offsets, data])
        if not odd:
            return raw, pa.Array.from_buffers(pa.string(), n, [None, offsets, data])
        read = [self.text(ids[starts[i] : starts[i + 1]]) if i in odd else raw[i].as_py().decode() for i in range(n)]
        return raw, pa.array(read, pa.string())

    def data(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


class Encoder:
    def __init__(self, rank: dict[bytes, int], pattern: str, apart: bool = False):
        import regex

        self.ranks = Ranks(rank)
        self.split, self.apart = regex.compile(pattern), apart
        #: the ids of parts, as bytes of int32
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def cut(self, text: str) -> Iterator[list[str]]:
        """The text in blocks of parts, each of which can be split by itself."""
        # a part ends before blanks that come after another character: no match goes over that place or looks back over it
        parts = _PARTS if self.apart and not _UNSURE.search(text) else self.split
        if len(text) <= BLOCK:
            yield parts.findall(text)
            return
        found = (m.group() for m in parts.finditer(text))
        while block := list(islice(found, BLOCK // 8)):
            yield block

    def pieces_of(self, parts: list[str]) -> tuple[list[str], np.ndarray]:
        """The pieces of all parts, and how many each part has."""
        if not self.apart:
            return parts, np.ones(len(parts), np.int64)
        # parts that begin with a blank and don't end in white space can be split as one text: each ends before the next one's blank
        easy = [p[0] in " \n" and not p[-1].isspace() for p in parts]
        pieces = self.split.findall("".join(compress(parts, easy)))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        easy = np.array(easy, bool)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        n = np.zeros(len(parts), np.int64)
        n[easy] = np.diff(np.searchsorted(ends, np.cumsum(size[easy]), "right"), prepend=0)
        if easy.all():
            return pieces, n
        out, at = [], 0
        for i, (part, k) in enumerate(zip(parts, n.tolist())):
            if easy[i]:
                out += pieces[at : at + k]
                at += k
            else:
                alone = self.split.findall(part)
                out += alone
                n[i] = len(alone)
        return out, n

    def learn(self, parts: set[str]) -> None:
        memo, older, new = self.memo, self.older, []
        for part in parts:
            ids = older.get(part)
            if ids is None:
                new.append(part)
            else:
                memo[part] = ids
        if not new:
            return
        pieces, n = self.pieces_of(new)
        tokens, sizes = self.ranks.encode_pieces(pieces)
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(n)] * 4
        data, lo = tokens.tobytes(), 0
        for part, hi in zip(new, ends.tolist()):
            memo[part] = data[lo:hi]
            lo = hi

    def encode(self, texts: list[str | None]) -> list[array]:
        collecting = gc.isenabled()
        gc.disable()  # many small tuples, and states that are taken apart when they are dropped
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[array]:
        out, waiting, size = [], [], 0
        for text in texts:
            ids = array("i")
            out.append(ids)
            for parts in self.cut(text or ""):
                waiting.append((ids, parts))
                size += sum(map(len, parts)) if text and len(text) > BLOCK else len(text or "")
                if size >= BLOCK:
                    self._give(waiting)
                    waiting, size = [], 0
        self._give(waiting)
        return out

    def _give(self, waiting: list[tuple[array, list[str]]]) -> None:
        """Encodes parts of several texts, and adds their ids to those of the texts."""
        needed = set().union(*[parts for _, parts in waiting])
        new = needed.difference(self.memo)
        if len(self.memo) + len(new) > MEMO:  # what isn't needed again before the next such time is forgotten
            self.memo, self.older = {}, self.memo
            new = needed
        self.learn(new)
        for ids, parts in waiting:
            ids.frombytes(b"".join(map(self.memo.__getitem__, parts)))
        for p in new:
            if len(p) > LONG:
                del self.memo[p]


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str, apart: bool = False) -> Encoder:
    """One a worker, kept with its memory between tasks."""
    return Encoder(ranks_of(path), pattern, apart)


@lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder({rank: token for token, rank in ranks_of(path).items()})


Batches = Iterator[pa.RecordBatch]


def encoding(path: str, pattern: str, apart: bool) -> Callable[[Batches], Batches]:
    """Batches of (doc_id, text) to (doc_id, n_tokens, ids)."""

    def run(batches: Batches) -> Batches:
        known = encoder(path, pattern, apart)
        for b in batches:
            for lo in range(0, b.num_rows, DOCS):
                part = b.slice(lo, DOCS)
                found = known.encode(part.column(1).to_pylist())
                n = np.array([len(x) for x in found], np.int64)
                starts = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), ids], names=["doc_id", "n_tokens", "ids"])

    return run


def decoding(path: str) -> Callable[[Batches], Batches]:
    """Batches with the column ids to the same with decoded and text."""

    def run(batches: Batches) -> Batches:
        known = decoder(path)
        for b in batches:
            for lo in range(0, b.num_rows, DOCS):
                part = b.slice(lo, DOCS)
                ids = part.column("ids")
                n = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
                starts = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
                columns = [*part.columns, *known.columns(ids.flatten().to_numpy(), starts)]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "decoded", "text"])

    return run


IDS, DECODED = "doc_id long, n_tokens long, ids array<int>", "decoded binary, text string"


def read(docs: DataFrame) -> DataFrame:
    return spread(docs.select(F.col("doc_id").cast("long"), "text"))


def encode(docs: DataFrame, path: str, pattern: str, apart: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids of each text, split by pattern (a regular expression without groups) and encoded by the ranks in path.

    apart: no match of the pattern holds white space after another character, and none looks back. Texts are then cut before
    blanks first, and each distinct part is split and encoded once a worker.
    """
    return read(docs).mapInArrow(encoding(path, pattern, apart), IDS)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) with decoded, the bytes of the tokens, and text, their characters; null ids give the empty text."""
    ids = encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return ids.mapInArrow(decoding(path), f"doc_id long, ids array<int>, {DECODED}")


def round_trip(docs: DataFrame, path: str, pattern: str, apart: bool = False) -> DataFrame:
    """What encode() gives with what decode() gives for it: in one worker, so that ids aren't sent out and back in between."""
    there, back = encoding(path, pattern, apart), decoding(path)
    return read(docs).mapInArrow(lambda batches: back(there(batches)), f"{IDS}, {DECODED}")
