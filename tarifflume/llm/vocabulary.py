"""Texts to token ids of a word-end BPE vocabulary, exactly as its library gives them.

Array code lower-cases a slice of texts and cuts it into pre-tokens; each distinct pre-token is
coded once and remembered in a hash table of the Python worker. Words with anything but plain
characters (from U+0100 on, controls, apostrophes, special strings) go to the library as they
are: no pre-token, composition or special string crosses white space.

Whole-token proof: `prove` merges each vocabulary string by itself, once on the driver. A string
that ends as one token is *whole*: a pre-token equal to it is counted at once, and only the rest
is merged. When all strings are whole, merging by the joined bytes of two neighbours takes the
same steps as merging by the pair: before rank r is due, what lies between two standing borders
has been merged as if alone, so for a string of rank r only its own pair can stand there. The
rest is then merged by tiktoken's byte-pair routine in one call a slice, otherwise by the
library's model.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from tarifflume.llm.common import slices, span_hashes

_ENDING = "</w>"
#: Stands behind a pre-token while it is merged; plain pre-tokens hold no control characters.
_STOP = b"\x01"

_SPACE, _LETTER, _DIGIT, _OTHER, _HARD = range(5)


def _classes() -> np.ndarray:
    """Class of each byte, of two-byte characters by their second byte after C3 (row 1) or C2 (row 2)."""
    of = np.full((3, 256), _HARD, np.uint8)
    of[0, 0x21:0x7F] = _OTHER
    of[0, [0x20, *range(0x09, 0x0E)]] = _SPACE
    of[0, ord("a") : ord("z") + 1] = _LETTER
    of[0, ord("0") : ord("9") + 1] = _DIGIT
    of[0, ord("'")] = _HARD
    of[1, 0x9F:0xC0] = _LETTER
    of[1, [0x97, 0xB7]] = _OTHER
    of[2, 0xA1:0xC0] = _OTHER
    of[2, [0xAA, 0xB5, 0xBA]] = _LETTER
    of[2, [0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _HARD
    return of


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _pairs(model: dict) -> list[tuple[str, str]]:
    return [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]


def _merged_alone(symbols: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    while len(symbols) > 1:
        best = min(zip(symbols, symbols[1:], strict=False), key=lambda p: rank.get(p, 1 << 60))
        if best not in rank:
            break
        out, i = [], 0
        while i < len(symbols):
            joins = i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best
            out.append(symbols[i] + symbols[i + 1] if joins else symbols[i])
            i += 2 if joins else 1
        symbols = out
    return symbols


@lru_cache(maxsize=4)
def prove(content: str) -> frozenset[str]:
    """The vocabulary strings that merging alone turns into one token."""
    model = json.loads(content)["model"]
    rank = {pair: k for k, pair in enumerate(_pairs(model))}
    whole = set()
    for token in model["vocab"]:
        body = token.removesuffix(_ENDING) if token != _ENDING else token
        symbols = list(body)
        if body != token:
            symbols[-1] += _ENDING
        if _merged_alone(symbols, rank) == [token]:
            whole.add(token)
    return frozenset(whole)


class Coder:
    """Token ids of texts. `remembered`: pre-tokens kept; beyond it the table starts anew, at a cost in time only."""

    def __init__(self, content: str, whole: frozenset[str], remembered: int = 1_000_000):
        from tokenizers import Tokenizer

        parsed = json.loads(content)
        model, letters = parsed["model"], _byte_letters()
        self.library = Tokenizer.from_str(content)
        self.shown = {b: c for c, b in letters.items()}
        self.remembered = remembered
        self.whole: dict[bytes, int] = {}
        ranks: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            ends = token.endswith(_ENDING)
            raw = bytes(letters[c] for c in (token.removesuffix(_ENDING) if ends else token))
            ranks[raw + _STOP * ends] = i
            if ends and token in whole:
                self.whole[raw] = i
        self.core = None
        # its ids must be ranks: bytes, bytes that end a word, then the merges in their order
        in_order = all(model["vocab"].get(a + b) == 512 + k for k, (a, b) in enumerate(_pairs(model)))
        if in_order and len(whole) == len(model["vocab"]) == len(ranks):
            import tiktoken

            self.core = tiktoken.Encoding("words", pat_str=r"[^\n]+", mergeable_ranks=ranks, special_tokens={})
            self.ends = np.zeros(len(ranks), bool)
            self.ends[[i for raw, i in ranks.items() if raw.endswith(_STOP) and len(raw) > 1]] = True
        self.slots = 1 << (2 * remembered - 1).bit_length()
        self.fresh()

    def fresh(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.entry = np.zeros(self.slots, np.int32)
        self.n = 0
        self.at = np.zeros(self.remembered + 1, np.int64)  # where an entry's ids begin
        self.pool = np.zeros(4 * self.remembered, np.uint32)
        raw = sorted(self.whole)
        lengths = np.array([len(r) for r in raw], np.int64)
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        data = np.frombuffer(b"".join(raw), np.uint8)
        low, begin, finish, hard = self.cut(data, bounds)
        keys = span_hashes(low, begin, finish) | np.uint64(1)
        # those that are one plain pre-token and in lower case already
        of = np.searchsorted(bounds, begin, "right") - 1
        changed = np.zeros(len(raw), bool)
        changed[np.searchsorted(bounds, np.flatnonzero(low != data), "right") - 1] = True
        one = ~hard & (begin == bounds[of]) & (finish == bounds[of + 1]) & ~changed[of]
        ids = np.array([self.whole[r] for r in raw], np.uint32)[of[one]]
        keys, first = np.unique(keys[one], return_index=True)
        self.insert(keys, np.ones(len(keys), np.int64), ids[first])

    @staticmethod
    def cut(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes in lower case; begin and end of each pre-token; which are whole words for the library."""
        n = len(data)
        low = _LOWER[data]
        kind = _CLASS[0][low]
        lead = np.flatnonzero((low == 0xC3) | (low == 0xC2))
        lead = lead[lead + 1 < n]
        if len(lead):
            third, trail = low[lead] == 0xC3, low[lead + 1]
            trail = np.where(third & (trail < 0x9F) & (trail != 0x97), trail + 0x20, trail).astype(np.uint8)
            low[lead + 1] = trail
            of = np.where(third, _CLASS[1][trail], _CLASS[2][trail])
            kind[lead] = of
            kind[lead + 1] = of
        marked = np.flatnonzero((low[:-1] == ord("<")) & (low[1:] == ord("|"))) if n > 1 else np.zeros(0, int)
        kind[marked] = _HARD
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        odd = np.flatnonzero(kind == _HARD)
        if len(odd):
            space = kind == _SPACE
            word = np.concatenate(([True], space[:-1])) & ~space | edge[:-1]
            begin = np.flatnonzero(word)
            stop = np.flatnonzero(space | edge[:-1])
            begin = np.unique(begin[np.searchsorted(begin, odd, "right") - 1])
            after = np.searchsorted(stop, begin, "right")
            finish = np.append(stop, n)[after]
            lengths = finish - begin
            inside = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            kind[inside] = _HARD
            low[inside] = data[inside]
        change = edge[:-1].copy()
        change[1:] |= kind[1:] != kind[:-1]
        change |= kind == _DIGIT
        begin = np.flatnonzero(change)
        finish = np.append(begin[1:], n)
        kept = kind[begin] != _SPACE if len(begin) else np.zeros(0, bool)
        begin, finish = begin[kept], finish[kept]
        return low, begin, finish, kind[begin] == _HARD

    def insert(self, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """New distinct keys and their ids, one after the other."""
        k = len(keys)
        old = int(self.at[self.n])
        while old + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[old : old + len(ids)] = ids
        self.at[self.n + 1 : self.n + k + 1] = old + np.cumsum(lengths)
        entry = np.arange(self.n, self.n + k, dtype=np.int32)
        self.n += k
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        left = np.arange(k)
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = keys[free]
            won = free[self.keys[slot[free]] == keys[free]]
            self.entry[slot[won]] = entry[won]
            placed = np.zeros(k, bool)
            placed[won] = True
            left = left[~placed[left]]
            slot[left] = (slot[left] + 1) & (self.slots - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1."""
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.entry[slot], -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (self.slots - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.entry[slot[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def coded(self, pieces: list[bytes], hard: np.ndarray) -> list[np.ndarray]:
        """Ids of pre-tokens that the table lacks."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(pieces)
        easy, odd = np.flatnonzero(~hard), np.flatnonzero(hard)
        if len(easy) and self.core is not None:
            text = (_STOP + b"\n").join([*(pieces[i] for i in easy), b""]).decode()
            ids = np.array(self.core.encode_ordinary(text), np.uint32)
            for i, part in zip(easy, np.split(ids, np.flatnonzero(self.ends[ids]) + 1), strict=False):
                out[i] = part
        elif len(easy):
            for i in easy:
                shown = "".join(self.shown[b] for b in pieces[i])
                out[i] = np.array([t.id for t in self.library.model.tokenize(shown)], np.uint32)
        if len(odd):
            words = [pieces[i].decode(errors="replace") for i in odd]
            for i, code in zip(odd, self.library.encode_batch(words, add_special_tokens=False), strict=True):
                out[i] = np.array(code.ids, np.uint32)
        return out

    def entries(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table entry of each pre-token, and the first pre-token of each text."""
        low, begin, finish, hard = self.cut(data, bounds)
        keys = span_hashes(low, begin, finish) | np.uint64(1)
        found = self.find(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, one = np.unique(keys[missing], return_index=True)
            if self.n + len(new) > self.remembered:
                if len(new) > self.remembered // 2:
                    self.remembered = 2 * len(new) + len(self.whole)
                    self.slots = 1 << (2 * self.remembered - 1).bit_length()
                self.fresh()
                return self.entries(data, bounds)
            one = missing[one]
            raw = low.tobytes()
            pieces = [raw[a:b] for a, b in zip(begin[one].tolist(), finish[one].tolist(), strict=True)]
            codes = self.coded(pieces, hard[one])
            self.insert(new, np.array([len(c) for c in codes], np.int64), np.concatenate(codes))
            found[missing] = self.find(keys[missing])
        return found, np.searchsorted(begin, bounds)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for a, b, data, bounds in slices(texts):
            found, first = self.entries(data, bounds)
            total = np.concatenate(([0], np.cumsum(self.at[found + 1] - self.at[found])))
            out[a:b] = np.diff(total[first])
        return out

    def ids(self, texts: pa.Array):
        """Slice by slice: (first row, last row + 1, ids one after the other, where each text's begin and the last end)."""
        for a, b, data, bounds in slices(texts):
            found, first = self.entries(data, bounds)
            start, lengths = self.at[found], self.at[found + 1] - self.at[found]
            total = np.concatenate(([0], np.cumsum(lengths)))
            place = np.repeat(start - total[:-1], lengths) + np.arange(int(total[-1]))
            yield a, b, self.pool[place], total[first]


_CODERS: dict[str, Coder] = {}


class SharedVocabulary:
    """The vocabulary file's text and proof, sent to the executors (of fixed size: one file)."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        with open(path or default_path(), encoding="utf-8") as f:
            content = f.read()
        parsed = json.loads(content)
        self.size = 1 + max([*parsed["model"]["vocab"].values(), *(t["id"] for t in parsed.get("added_tokens", []))])
        self.key = hashlib.sha256(content.encode()).hexdigest()
        self.sent = spark.sparkContext.broadcast((content, prove(content)))

    def coder(self) -> Coder:
        """The worker's coder; kept from task to task."""
        if self.key not in _CODERS:
            _CODERS[self.key] = Coder(*self.sent.value)
        return _CODERS[self.key]
