"""BPE encoding and decoding of whole texts with a word-end vocabulary (operator 5).

A text is cut at special tokens, composed (NFC), lower-cased and split into letters, single digits and
runs of anything else. Each piece becomes bytes; `merge` then holds the part boundaries and the rank of
every adjacent pair in contiguous arrays, takes the least rank again and again, deletes that boundary and
refreshes the two ranks beside it. Pieces repeat, so each Python worker keeps a bounded table of them.

Defined results: null and empty texts have no ids and decode to ''; special-token strings become their
single ids; pieces of any length are encoded whole (those of more than `SCANNED` bytes by a heap, with the same merges in the same
order: of equal ranks the leftmost first); equal texts have equal ids, whatever their rows; an empty table gives an empty
result; columns of the outputs' names are replaced, all others are kept whatever their names; ids of rows aren't read.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.llm.common import CACHES, by_place, byte_sizes, slices, tidied

NEVER = 1 << 62
#: Pieces longer than this are merged with a heap: a scan for each merge would take quadratic time.
SCANNED = 64
#: Pieces that a worker keeps: when half are young, these become the old ones and the old ones go.
KEPT = 250_000
#: U+001C to U+001F part words for str.split but are no white space in a pattern.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def points(ranges: str) -> list[int]:
    return [c for r in ranges.split() for c in range(int(r.partition("-")[0], 16), int(r.rpartition("-")[2], 16) + 1)]


#: Where the tokenizers library's Unicode tables are not those of Unicode 15.1, which Python 3.13 has. Letters and numbers that came later;
#: capitals of letters that came later, by ranges with the distance to their small letters; and combining marks that its composing tables,
#: which are older, don't know (U+11930 among them, as one half of a composition).
LATER_LETTERS = points("1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0")
LATER_NUMBERS = points("10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA")
LATER_LOWER = {c: c + by for r, by in (("1C89 A7CC A7CE A7D2 A7D4 A7DA", 1), ("10D50-10D65", 0x20), ("16EA0-16EB8", 0x1B)) for c in points(r)} | {0xA7CB: 0x264, 0xA7DC: 0x19B}
UNKNOWN_MARKS = points("7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF")


def one_of(code_points) -> regex.Pattern:
    return regex.compile("([" + "".join(f"\\U{c:08x}" for c in code_points) + "])")


MARK, LATER_CAPITAL = one_of(UNKNOWN_MARKS), one_of(LATER_LOWER)


def composed(text: str) -> str:
    """NFC as the library composes: a mark that it doesn't know is a letter of its own to it, which neither moves nor joins others."""
    if not MARK.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join(part if i % 2 else unicodedata.normalize("NFC", part) for i, part in enumerate(MARK.split(text)))


def lowered(text: str) -> str:
    """Each letter alone in lower case: there is no final sigma."""
    text = text.replace("Σ", "σ").lower()
    return text.translate(LATER_LOWER) if LATER_CAPITAL.search(text) else text


def piece_pattern() -> regex.Pattern:
    """Letters, single digits, or anything else but white space. The pattern module's tables are newer than the library's: of what Python
    does not know as assigned, letters and numbers are those that the library takes for such."""
    known = {"L": set(LATER_LETTERS), "N": set(LATER_NUMBERS)}

    def named(kind: str) -> str:
        here = regex.compile(f"\\p{{{kind}}}")
        more = "".join(f"\\U{c:08x}" for c in range(0x110000) if c not in known[kind] and unicodedata.category(chr(c)) == "Cn" and here.match(chr(c)))
        less = "".join(f"\\U{c:08x}" for c in known[kind] if not here.match(chr(c)))
        return f"[\\p{{{kind}}}{less}--[{more}]]" if more else f"[\\p{{{kind}}}{less}]"

    letter, number = named("L"), named("N")
    return regex.compile(f"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|[^\\s{letter}{number}]+")


#: For chunks of assigned code points alone, and for any chunk.
PIECE, ANY_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), piece_pattern()


def split(chunk: str) -> list[str]:
    if chunk.isalpha():
        return [chunk]
    return (PIECE if chunk.isprintable() else ANY_PIECE).findall(chunk)


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where printable, else the next one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Bpe:
    """A vocabulary file of the tokenizers library: model BPE with a word-end suffix and byte letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_letters()
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = np.array([(self.vocab[a] << 20) | self.vocab[b] for a, b in self.ranks], np.int64)
        made = np.array([self.vocab[a + b] for a, b in self.ranks], np.int64)
        self.order = np.argsort(pairs)
        self.pairs, self.made = pairs[self.order], made
        self.first = np.array([self.vocab[c] for c in self.letters], np.int64)
        self.last = np.array([self.vocab[c + self.end] for c in self.letters], np.int64)
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each adjacent pair of token ids, NEVER for none."""
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.order[at], NEVER)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of pieces of equal length, each a row of contiguous parts and of contiguous adjacent ranks.

        Every round finds each row's least rank (the leftmost of equals), puts the merged token at its
        left part, deletes the boundary after it and refreshes the ranks on both sides.
        """
        n, size = len(pieces), len(pieces[0])
        raw = np.frombuffer(b"".join(pieces), np.uint8).reshape(n, size)
        parts = self.first[raw]
        parts[:, -1] = self.last[raw[:, -1]]
        out: list[np.ndarray | None] = [None] * n
        rows = np.arange(n)
        near = np.full((n, size), NEVER)
        if size > 1:
            near[:, :-1] = self._rank(parts[:, :-1], parts[:, 1:])
        while True:
            at = near.argmin(axis=1)
            least = near[np.arange(len(rows)), at]
            over = least == NEVER
            if over.any():
                for r, p in zip(rows[over], parts[over]):
                    out[r] = p
                rows, parts, near, at, least = rows[~over], parts[~over], near[~over], at[~over], least[~over]
                if not len(rows):
                    return out
            every, size = np.arange(len(rows)), parts.shape[1] - 1
            parts[every, at] = self.made[least]
            column = np.arange(size)
            parts = np.where(column <= at[:, None], parts[:, :-1], parts[:, 1:])
            near = np.where(column <= at[:, None], near[:, :-1], near[:, 1:])
            near[every, at] = NEVER
            if size > 1:
                k = np.flatnonzero(at < size - 1)
                near[k, at[k]] = self._rank(parts[k, at[k]], parts[k, at[k] + 1])
                k = np.flatnonzero(at > 0)
                near[k, at[k] - 1] = self._rank(parts[k, at[k] - 1], parts[k, at[k]])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        symbols = [self.letters[b] for b in piece]
        symbols[-1] += self.end
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        held: list[str | None] = list(symbols)
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if held[i] != a or j >= n or held[j] != b:
                continue
            held[i], held[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (r := ranks.get((held[x], held[after[x]]))) is not None:
                    heapq.heappush(heap, (r, x, held[x], held[after[x]]))
        return np.array([self.vocab[x] for x in held if x is not None], np.int64)

    def _learn(self, pieces: set[str]) -> None:
        sized: dict[int, list[str]] = {}
        for p in pieces:
            if (got := self.old.get(p)) is None:
                sized.setdefault(len(p.encode("utf-8", "surrogatepass")), []).append(p)
            else:
                self.young[p] = got
        for size, ps in sized.items():
            raw = [p.encode("utf-8", "surrogatepass") for p in ps]
            for p, ids in zip(ps, self.merge(raw) if size <= SCANNED else map(self._merge_long, raw)):
                self.young[p] = ids.astype(np.int32).tobytes(), " ".join([self.names[i] for i in ids.tolist()])

    def split(self, text: str | None) -> list[str]:
        """The pieces of a text; a special token is a piece of its own."""
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text) if text and "<|" in text else (text or "",)):
            if k % 2:
                out.append(part)
                continue
            part = part.lower() if part.isascii() else lowered(composed(part))
            for c in part.split() if not ODD_SPACE.search(part) else SPACE.split(part):
                if c.isalpha():
                    out.append(c)
                elif c[:-1].isalpha() and c.isprintable():
                    out += (c[:-1], c[-1])
                else:
                    out += split(c)
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Of each text the ids, as int32 bytes, and the decoded text: tokens joined by one space."""
        if len(self.young) > KEPT // 2:
            self.old, self.young = self.young, {}
        for t, i in self.special.items():
            self.young[t] = np.int32(i).tobytes(), t
        pieces = [self.split(t) for t in texts]
        get = self.young.get
        self._learn({p for ps in pieces for p in ps if p not in self.young})
        got = [[get(p) for p in ps] for ps in pieces]
        return [(b"".join([g[0] for g in gs]), " ".join([g[1] for g in gs])) for gs in got]

    def decode(self, ids: list[int]) -> str:
        """As the library does where the file names no decoder; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


CACHES["bpe"] = load.cache_clear


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "bpe_ids", decoded: str = "bpe_decoded") -> DataFrame:
    """docs with the ids (array<int>) and the decoded text of each row; columns of these names are replaced, others may have any name."""
    return by_place(docs, (ids, decoded), lambda rows, names: _encode_decode(rows, path, names[docs.columns.index(text)], ids, decoded))


def _encode_decode(docs: DataFrame, path: str, text: str, ids: str, decoded: str) -> DataFrame:
    """Work is one pass without a shuffle. Output batches are cut to a few MB, so that memory doesn't
    follow the number of tokens.
    """
    kept = [f for f in docs.schema.fields if f.name not in (ids, decoded)]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())])
    names = [f.name for f in schema.fields]
    at = docs.columns.index(text)
    keep = [docs.columns.index(f.name) for f in kept]

    def run(batches):
        bpe = load(path)
        for b in batches:
            for i, j in slices(byte_sizes(b.column(at)), 1 << 20, 512):
                part = b.slice(i, j - i)
                got = bpe.encode(part.column(at).to_pylist())
                ends = np.cumsum([0] + [len(g[0]) // 4 for g in got], dtype=np.int32)
                flat = pa.array(np.frombuffer(b"".join(g[0] for g in got), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends), flat)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), lists, pa.array([g[1] for g in got], pa.string())], names)

    return docs.select([F.col(f"`{c}`") for c in docs.columns]).mapInArrow(tidied(run, "bpe"), schema)
