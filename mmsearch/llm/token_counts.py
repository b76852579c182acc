"""Token counts by a finite-state compilation of a byte-level BPE tokenizer.

Two transducers in cascade, both compiled once per worker:

 * The split transducer reads character classes and has 12 states. Its transitions say where a piece
   starts: at this character, at the one before, or both (a run of white space gives its last character
   to the next piece only when that piece is seen). Texts are cut into blocks of ``BLOCK`` characters; all
   blocks run in step from all 12 states, which gives each block a map from its first state to its last.
   The maps are composed by a parallel prefix scan, so every block learns its true first state, and a
   second run in step from those states gives the piece starts.
 * The token transducer reads a piece's bytes and is compiled from the merge table. A pair of tokens stands
   beside each other in a piece if and only if no merge crosses their border, so a prefix has one last token
   that fits what precedes it. A state holds the longest suffix that a token may still begin with, the last
   token at each place of that suffix and the counts there, relative to now; a transition reads one byte and
   carries the change of the token count. States and transitions are compiled when first met, at most
   ``STATES`` of them, and compiled anew beyond. Every piece starts at the root, so a block's map after its
   first piece start doesn't depend on what came before, and sums of counts compose over blocks.

What a whole piece emits is remembered by 64-bit hash (``TRANSITIONS`` entries, emptied and refilled beyond),
so a worker reads each distinct piece once. Counts of a text are the sum of what its transitions emit.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import chunks, splitmix

BLOCK, TRANSITIONS, STATES = 128, 3_000_000, 200_000
_U = np.uint64

# Classes: letters are split further where contractions ('s 't 'm 'd 're 've 'll) need it.
L, N, SP, WS, O, AP, C_STMD, C_R, C_V, C_L, C_E, END = range(12)
_LETTERS = (L, C_STMD, C_R, C_V, C_L, C_E)
# States: nothing open; in letters, numbers, others; one space; one other white space; more, ending in a space or not;
# apostrophe at a piece's start; the same with r, v or l after it.
S0, SL, SN, SO, S_SP, S_WS, S_SPS, S_WSS, S_AP, S_R, S_V, S_LL = range(12)
_END_CHAR = 0x110000


def _classes() -> np.ndarray:
    table = np.full(_END_CHAR + 1, O, np.uint8)
    every = "".join(chr(c) for c in range(_END_CHAR) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((L, r"\p{L}"), (N, r"\p{N}"), (WS, r"\p{White_Space}")):
        table[[ord(c) for c in regex.findall(pattern, every)]] = kind
    table[_END_CHAR] = END
    for kind, chars in ((SP, " "), (AP, "'"), (C_STMD, "stmd"), (C_R, "r"), (C_V, "v"), (C_L, "l"), (C_E, "e")):
        table[[ord(c) for c in chars]] = kind
    return table


def _open(c: int) -> int:
    """The state after a piece starts with class c."""
    return SL if c in _LETTERS else {N: SN, SP: S_SP, WS: S_WS, O: SO, AP: S_AP, END: S0}[c]


def _step(s: int, c: int) -> tuple[int, int]:
    """(next state, starts): starts has 1 for a piece at this character, 2 for one at the character before."""
    letter = c in _LETTERS
    new = (_open(c), 1)
    if c == END:
        return S0, 2 if s in (S_R, S_V, S_LL) else 0
    if s == S0:
        return new
    if s == SL:
        return (SL, 0) if letter else new
    if s == SN:
        return (SN, 0) if c == N else new
    if s == SO:
        return (SO, 0) if c in (O, AP) else new
    white = {SP: S_SPS, WS: S_WSS}
    if s == S_SP:
        return (white[c], 0) if c in white else (SL if letter else SN if c == N else SO, 0)
    if s == S_WS:
        return (white[c], 0) if c in white else new
    if s == S_SPS:
        return (white[c], 0) if c in white else (SL if letter else SN if c == N else SO, 2)
    if s == S_WSS:
        return (white[c], 0) if c in white else (new[0], 3)
    if s == S_AP:
        if c == C_STMD:
            return S0, 0
        if c in (C_R, C_V, C_L):
            return {C_R: S_R, C_V: S_V, C_L: S_LL}[c], 0
        return (SO, 0) if c in (O, AP) else new
    if c == (C_L if s == S_LL else C_E):
        return S0, 0
    return (SL, 2) if letter else (new[0], 3)


def _byte_of() -> dict[str, int]:
    """The printable characters that byte-level vocabularies spell bytes with."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}


class Merges:
    """The token transducer of one piece's bytes; see the module's text."""

    def __init__(self, vocab: dict[str, int], merges: list):
        byte = _byte_of()
        ids = {bytes(byte[c] for c in t): k for t, k in vocab.items() if all(c in byte for c in t)}
        self.rank, self.parts, self.tokens, made = {}, {}, {}, {}
        self.tokens.update((bytes([b]), ids[bytes([b])]) for b in range(256))
        for r, pair in enumerate(merges):
            left, right = (bytes(byte[c] for c in t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = left + right
            if whole in made or any(len(t) > 1 and t not in made for t in (left, right)):
                raise ValueError("merges must build each token once, from tokens of earlier merges")
            made[whole] = r
            a, b = ids[left], ids[right]
            self.rank[a, b] = r
            self.parts[ids[whole]] = (a, b, r)
            if left in self.tokens and right in self.tokens:
                self.tokens[whole] = ids[whole]
        for whole, k in list(self.tokens.items()):
            if k in self.parts and not self.fits(*self.parts[k]):
                del self.tokens[whole]
        self.begins = {t[:n] for t in self.tokens for n in range(1, len(t))}
        self.clear()

    def fits(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """Whether no merge crosses the border of two tokens before ``limit``.

        A part that ends or begins at the border can merge over it until its own side consumes it; of equal
        merges the left one comes first.
        """
        until = limit
        while True:
            other, end = right, limit
            while True:
                r = self.rank.get((left, other))
                if r is not None and r < until and r <= end:
                    return False
                if other not in self.parts:
                    break
                other, _, end = self.parts[other]
            if left not in self.parts:
                return True
            _, left, until = self.parts[left]

    def clear(self):
        root = (b"", (-1,), (0,))
        self.states, self.index, self.moves = [root], {root: 0}, {}

    def _name(self, state: tuple) -> int:
        if state not in self.index:
            self.index[state] = len(self.states)
            self.states.append(state)
        return self.index[state]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the count) of a transition met for the first time."""
        if len(self.states) >= STATES:
            now = self.states[state]
            self.clear()
            state = self._name(now)
        suffix, last, counts = self.states[state]
        grown = suffix + bytes([byte])
        for k, before in enumerate(last):
            token = self.tokens.get(grown[k:])
            if token is not None and (before < 0 or self.fits(before, token)):
                break
        change = counts[k] + 1
        keep = next((j for j in range(len(grown)) if grown[j:] in self.begins), len(grown))
        after = (grown[keep:], (*last, token)[keep:], (*(c - change for c in counts), 0)[keep:])
        step = self.moves[state << 8 | byte] = (self._name(after), change)
        return step

    def count(self, piece: bytes) -> int:
        state = total = 0
        for byte in piece:
            state, change = self.moves.get(state << 8 | byte) or self.compile(state, byte)
            total += change
        return total


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        usual = split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True) and not spec["normalizer"]
        extras = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        added = spec["added_tokens"]
        if model.get("type") != "BPE" or not usual or any(model.get(x) for x in extras) or any(x[y] for x in added for y in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: only byte-level BPE with the standard split can be compiled")
        self.merges = Merges(model["vocab"], model["merges"])
        special = [re.escape(x["content"].encode()) for x in added]
        self.special = re.compile(b"|".join(special)) if special else None
        self.classes = _classes()
        steps = [[_step(s, c) for c in range(12)] for s in range(12)]
        self.next = np.array([[x[0] * 12 for x in row] for row in steps], np.int64).ravel()
        self.starts = np.array([[x[1] for x in row] for row in steps], np.uint8).ravel()
        self._reset()

    def _reset(self):
        self.keys, self.counts = np.zeros(0, _U), np.zeros(0, np.int64)

    def piece_starts(self, chars: np.ndarray) -> np.ndarray:
        """Flags of characters that start a piece; END characters are flagged too."""
        n = len(chars)
        blocks = max(1, -(-n // BLOCK))
        kind = np.full(blocks * BLOCK, END, np.int64)
        kind[:n] = self.classes[chars]
        kind = np.ascontiguousarray(kind.reshape(blocks, BLOCK).T)
        maps = np.repeat(np.arange(12)[:, None] * 12, blocks, 1)
        for row in kind:
            maps = self.next.take(maps + row)
        maps = np.ascontiguousarray(maps.T) // 12
        d = 1
        while d < blocks:
            maps = np.concatenate([maps[:d], np.take_along_axis(maps[d:], maps[:-d], 1)])
            d *= 2
        state = np.concatenate([[S0], maps[:-1, S0]]) * 12
        out = np.empty((BLOCK, blocks), np.uint8)
        for k, row in enumerate(kind):
            at = state + row
            out[k] = self.starts.take(at)
            state = self.next.take(at)
        out = out.T.ravel()
        flags = (out[:n] & 1) > 0
        flags[:-1] |= out[1:n] > 1
        return flags | (chars == _END_CHAR)

    def _emit(self, keys: np.ndarray, spell) -> np.ndarray:
        """Counts of pieces; spell(k) gives the text of the k-th."""
        names, first, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, names)
        have = at < len(self.keys)
        have[have] = self.keys[at[have]] == names[have]
        counts = np.zeros(len(names), np.int64)
        counts[have] = self.counts[at[have]]
        new = np.flatnonzero(~have)
        if len(new):
            counts[new] = [self.merges.count(spell(first[k]).encode()) for k in new]
            if len(self.keys) + len(new) > TRANSITIONS:
                self._reset()
                at = np.zeros(len(names), np.int64)
            self.keys = np.insert(self.keys, at[new], names[new])
            self.counts = np.insert(self.counts, at[new], counts[new])
        return counts[back]

    def count(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Token counts of the rows of a chunk of UTF-8 bytes."""
        rows = len(at) - 1
        body = raw.tobytes()
        total = np.zeros(rows, np.int64)
        chars = np.frombuffer(body.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        ends = lead[at[1:]]
        marks = np.zeros(0, np.int64)
        if self.special is not None and (hits := [m.span() for m in self.special.finditer(body)]):
            hits = [(a, b) for a, b in hits if np.searchsorted(at, a, "right") == np.searchsorted(at, b - 1, "right")]
            owner = np.searchsorted(at, [a for a, _ in hits], "right") - 1
            np.add.at(total, owner, 1)
            spans = [(lead[a], lead[b]) for a, b in hits]
            keep = np.ones(len(chars), bool)
            for a, b in spans:
                keep[a + 1 : b] = False
            chars = chars.copy()
            marks = np.array([a for a, _ in spans], np.int64)
            chars[marks] = _END_CHAR
            moved = np.concatenate([[0], np.cumsum(keep)])
            chars, ends = chars[keep], moved[ends]
        chars = np.insert(chars, ends, _END_CHAR)
        ends = ends + np.arange(rows)
        flags = self.piece_starts(chars)
        start = np.flatnonzero(flags)
        row = np.searchsorted(ends, start)
        size = np.diff(np.append(start, len(chars)))
        place = np.arange(len(chars)) - np.repeat(start, size)
        with np.errstate(over="ignore"):
            key = splitmix(np.add.reduceat(splitmix(chars.astype(_U) + (place.astype(_U) << _U(21))), start) + size.astype(_U))
        real = chars[start] != _END_CHAR
        start, row, size, key = start[real], row[real], size[real], key[real]
        if not len(start):
            return total
        codes = chars.astype(np.uint32)
        counts = self._emit(key, lambda k: codes[start[k] : start[k] + size[k]].tobytes().decode("utf-32-le"))
        return total + np.bincount(row, counts, rows).astype(np.int64)


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def _count(path: str, limit: int):
    def run(batches):
        t = transducer(path)
        for batch in batches:
            for a, b, raw, at in chunks(batch):
                n = t.count(raw, at)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(at), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of docs (columns doc_id, text; others are ignored).

    ``path``: a byte-level BPE file of the tokenizers library, readable on every worker. Counts are the
    library's own without begin, end or other added tokens; its special strings inside a text count as one
    token each. Null or empty text: 0 bytes, 0 tokens. Any doc_id, null or repeated, gets its row. Texts of
    any length are read whole. Empty table: empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_count(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
