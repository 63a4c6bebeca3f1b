"""Byte-level BPE by a trie of distinct words.

In BPE every prefix of a word has one last token: the token t for which the
last token before t and t stay apart when their bytes are merged together. The
distinct words of a block of texts go into a trie of bytes; a depth-first walk
finds the last token of each node from its ancestors' last tokens, so prefixes
that words share are worked out once. A word's ids follow by walking its last
tokens back.

Texts are cut before each space that a non-space follows. No pre-token crosses
such a place, so the pieces' encodings stand on their own and are kept in a
bounded cache of each worker.

Defined results: a null text counts as an empty one and has no ids; the string
of a special token inside a text becomes that token's id, as the tokenizers
library does by default; texts and single words of any length are encoded whole;
each row gives one row, repeated ones and null ids too; an empty table gives no
rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import tokenizer_path

#: Fixed value: the published pre-token pattern of this byte-level BPE family.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A space at which cutting isn't known to be safe.
AWKWARD = re.compile(r" (?:\s|\Z)")
#: Runs of white space that the compiled library isn't given.
LONG_RUN = 100_000
RUN = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}")
BLOCK_CHARS = 1 << 22
CACHE_PIECES = 1_000_000
LONG_WORD, SHORT = 256, 6
BYTES = [bytes((i,)) for i in range(256)]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def special_pattern(specials: Iterable[str]) -> re.Pattern:
    """Splits a text at special strings and keeps them."""
    return re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")")


class BpeModel:
    """Vocabulary, merge ranks and the pair test."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.id_of = {as_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: b for b, i in self.id_of.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.specials.items()}
        self.rank = {i: -1 for b, i in self.id_of.items() if len(b) == 1}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merge_rank: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            left, right, whole = self.id_of[a], self.id_of[b], self.id_of[a + b]
            if whole in self.rank or left not in self.rank or right not in self.rank:
                raise ValueError("merges that make a token twice, or from later tokens, are not supported")
            self.rank[whole], self.halves[whole], self.merge_rank[left, right] = r, (left, right), r
        self.apart: dict[int, bool] = {}
        never = len(self.merge_rank)
        reachable = [i for i in self.rank if i not in self.halves or not self._crossed(*self.halves[i], self.rank[i])]
        self.token = {self.bytes_of[i]: i for i in reachable}
        self.never = never
        ends: dict[bytes, set[int]] = {}
        for b in self.token:
            ends.setdefault(b[-2:], set()).add(len(b))
        #: Tokens over SHORT bytes, by their last SHORT bytes: lengths, longest first.
        long: dict[bytes, set[int]] = {}
        for b in self.token:
            if len(b) > SHORT:
                long.setdefault(b[-SHORT:], set()).add(len(b))
        self.long = {e: tuple(sorted(n, reverse=True)) for e, n in long.items()}
        self.short: dict[bytes, tuple] = {}
        #: Lengths of the tokens that end in these two bytes, longest first; a single byte always ends a text.
        self.lengths = {e: tuple(sorted(n | {1}, reverse=True)) for e, n in ends.items()}

    def _crossed(self, a: int, b: int, until: int) -> bool:
        """Whether a merge of rank below ``until`` joins tokens a and b, side by side, across their border.

        Goes back in time: what touches the border from either side are the
        tokens themselves, then their halves at the border, and so on. Two such
        parts are there together until either is eaten by a merge of its own side;
        of equal ranks the merge further left comes first.
        """
        rank, halves, merge_rank = self.rank, self.halves, self.merge_rank
        eaten_a = eaten_b = until
        while True:
            m = merge_rank.get((a, b))
            if m is not None and m < eaten_a and m <= eaten_b:
                return True
            if rank[a] > rank[b]:
                eaten_a, a = rank[a], halves[a][1]
            elif b in halves:
                eaten_b, b = rank[b], halves[b][0]
            else:
                return False

    def _fits(self, before: int, t: int) -> bool:
        """Whether t can follow ``before``; answers are kept."""
        key = before << 32 | t
        ok = self.apart.get(key)
        if ok is None:
            ok = self.apart[key] = not self._crossed(before, t, self.never)
        return ok

    def last_token(self, path: bytes | bytearray, end: int, last: list[int]) -> int:
        """The last token of path[:end], from the last tokens of its shorter prefixes."""
        token = self.token
        for n in self.lengths.get(bytes(path[max(0, end - 2) : end]), (1,)):
            if n > end:
                continue
            t = token.get(bytes(path[end - n : end]))
            if t is None:
                continue
            if n == end:
                return t
            if self._fits(last[end - n], t):
                return t
        raise AssertionError("every prefix has a last token")

    def _ids(self, end: int, last: list[int]) -> list[int]:
        out = []
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words. Those over LONG_WORD bytes share no trie; the same walk runs along each."""
        root: dict = {}
        out: dict[bytes, list[int]] = {}
        for w in words:
            if len(w) > LONG_WORD:
                last = [0]
                for end in range(1, len(w) + 1):
                    last.append(self.last_token(w, end, last))
                out[w] = self._ids(len(w), last)
                continue
            node = root
            for c in w:
                node = node.setdefault(c, {})
            node[-1] = w
        if -1 in root:
            out[b""] = []
        token, apart, long, short, fits = self.token.get, self.apart, self.long, self.short, self._fits
        last = [0] * (LONG_WORD + 1)
        todo = [(bytes((c,)), child) for c, child in root.items() if c >= 0]
        while todo:
            path, node = todo.pop()
            end = len(path)
            ending = path[-SHORT:]
            t = None
            if ending in long:
                for n in long[ending]:
                    if n <= end and (x := token(path[-n:])) is not None and (n == end or fits(last[end - n], x)):
                        t = x
                        break
            if t is None:
                found = short.get(ending)
                if found is None:
                    found = short[ending] = tuple((n, x) for n in range(len(ending), 0, -1) if (x := token(ending[-n:])) is not None)
                for n, t in found:
                    if n == end:
                        break
                    ok = apart.get(last[end - n] << 32 | t)
                    if ok or (ok is None and fits(last[end - n], t)):
                        break
            last[end] = t
            for c, child in node.items():
                if c < 0:
                    out[child] = self._ids(end, last)
                else:
                    todo.append((path + BYTES[c], child))
        if len(apart) > 600_000:
            apart.clear()
        if len(short) > 300_000:
            short.clear()
        return out


class Library:
    """The same vocabulary's encoding by a compiled library, for operators whose method isn't the trie."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special_pattern(self.specials)
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        # Merging goes by rank: single bytes first, then as the merges are listed.
        self.own = tiktoken.Encoding("own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens={})

    def numbers(self, text: str) -> np.ndarray:
        """Ids (u4) of a text in which special strings count as ordinary ones.

        The library's pattern matcher fails on runs of white space of about a million characters;
        texts with long runs are cut into pre-tokens here.
        """
        if len(text) >= LONG_RUN and RUN.search(text):
            ids = array("I")
            for word in PRE_TOKEN.findall(text):
                ids.extend(self.own._encode_single_piece(word))
            return np.frombuffer(ids, np.uint32)
        return self.own.encode_to_numpy(text, disallowed_special=())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of whole texts."""
        out = []
        for t in texts:
            t = t or ""
            if any(s in t for s in self.specials):
                parts = self.special.split(t)
                out.append(b"".join(pack_ids([self.specials[p]]) if p in self.specials else self.numbers(p).tobytes() for p in parts))
            else:
                out.append(self.numbers(t).tobytes())
        return out


class PieceEncoder:
    """Encodes texts through a bounded cache of pieces; ``value`` turns a piece's ids into what is kept.

    ``model`` finds the ids of missing pieces by the trie.
    """

    def __init__(self, model: BpeModel, value, join, most: int = CACHE_PIECES):
        self.model, self.value, self.join, self.most = model, value, join, most
        self.spaced: dict = {}
        self.bare: dict = {}
        #: Values of pre-tokens, of which pieces are made.
        self.tokens: dict = {}

    def _fill(self, missing: set[str], cache: dict, lead: str) -> None:
        known = self.tokens
        pieces = {p: [lead + p] if p.isalpha() else PRE_TOKEN.findall(lead + p) for p in missing}
        fresh = {t.encode(): t for ts in pieces.values() for t in ts if t not in known}
        known.update((fresh[w], self.value(ids)) for w, ids in self.model.encode_words(fresh).items())
        for p, ts in pieces.items():
            cache[p] = known[ts[0]] if len(ts) == 1 else self.join([known[t] for t in ts])
        if len(known) > self.most // 2:
            known.clear()

    def _whole(self, text: str) -> list:
        """Values of a text that holds awkward spaces."""
        pieces = PRE_TOKEN.findall(text)
        for at in range(0, len(pieces), 200_000):
            missing = set(pieces[at : at + 200_000]).difference(self.bare)
            if missing:
                self._fill(missing, self.bare, "")
        return [self.bare[p] for p in pieces]

    def _plain(self, text: str) -> list:
        """Values of a text without special strings."""
        if AWKWARD.search(text):
            return self._whole(text)
        head, *pieces = text.split(" ")
        for part, cache, lead in (({head}, self.bare, ""), (set(pieces), self.spaced, " ")):
            missing = part.difference(cache)
            if missing:
                self._fill(missing, cache, lead)
        return [self.bare[head], *map(self.spaced.__getitem__, pieces)]

    def _trim(self) -> None:
        """Beyond the bound the longer pieces go, as the rarer ones; all go if short ones fill it."""
        if len(self.spaced) > self.most:
            short = {p: v for p, v in self.spaced.items() if len(p) <= 8}
            self.spaced = short if len(short) < self.most // 2 else {}
        if len(self.bare) > self.most // 4:
            self.bare = {}

    def encode(self, texts: list[str | None]) -> list:
        """What ``join`` makes of each text's values; the misses of a block of texts share one trie.

        Nothing here makes reference cycles, but a great many containers: the cycle collector waits meanwhile.
        """
        was = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if was:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list:
        self._trim()
        texts = [t or "" for t in texts]
        special = [next((s for s in self.model.specials if s in t), None) for t in texts]
        missing: set[str] = set()
        split: list[tuple | None] = []
        heads = set()
        get = self.spaced.get
        for t, s in zip(texts, special):
            if s is not None or AWKWARD.search(t):
                split.append(None)
                continue
            head, *parts = t.split(" ")
            heads.add(head)
            # One look-up for each piece; no piece after a space has an empty value, so what is false is missing.
            values = list(map(get, parts))
            missing.update(compress(parts, map(not_, values)))
            split.append((head, parts, values))
        for part, cache, lead in ((heads.difference(self.bare), self.bare, ""), (missing, self.spaced, " ")):
            if part:
                self._fill(part, cache, lead)
        out = []
        for t, s, parts in zip(texts, special, split):
            if parts is not None:
                head, pieces, values = parts
                for i in list(compress(range(len(values)), map(not_, values))):
                    values[i] = self.spaced[pieces[i]]
                out.append(self.join([self.bare[head], *values]))
            elif s is None:
                out.append(self.join(self._whole(t)))
            else:
                values = []
                for part in special_pattern(self.model.specials).split(t):
                    values += [self.value([self.model.specials[part]])] if part in self.model.specials else self._plain(part)
                out.append(self.join(values))
        return out


_models: dict[str, BpeModel] = {}
_encoders: dict = {}


def model(path: str) -> BpeModel:
    """This worker's model; kept for later tasks."""
    if path not in _models:
        _models[path] = BpeModel(path)
    return _models[path]


assert sys.byteorder == "little" and array("I").itemsize == 4


def pack_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes()


def id_encoder(path: str, trie: bool = True) -> PieceEncoder | Library:
    """This worker's encoder of ids: by the trie, or whole texts by the library."""
    key = path, trie
    if key not in _encoders:
        _encoders[key] = PieceEncoder(model(path), pack_ids, b"".join) if trie else Library(path)
    return _encoders[key]


def decode(path: str, ids: bytes) -> str:
    """The text of packed ids, as the byte-level decoder gives it."""
    table, numbers = model(path).bytes_of, np.frombuffer(ids, "<u4")
    parts = [b"".join(map(table.__getitem__, numbers[at : at + 1_000_000].tolist())) for at in range(0, len(numbers), 1_000_000)]
    return b"".join(parts).decode("utf-8", "replace")


def blocks(texts: pa.Array | pa.ChunkedArray, most: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of runs of rows of about ``most`` bytes; a longer text is alone in its run."""
    run: list[str | None] = []
    start = held = 0
    for i, t in enumerate(texts):
        t = t.as_py()
        run.append(t)
        held += len(t or "")
        if held >= most:
            yield start, run
            start, run, held = i + 1, [], 0
    if run:
        yield start, run


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text: (id, ids binary little-endian u32). No shuffle; a task holds one block of texts at a time."""
    path = path or tokenizer_path()

    def run(batches):
        enc = id_encoder(path)
        for b in batches:
            for at, texts in blocks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(enc.encode(texts), pa.binary())], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def encode_decode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode each text, decode its ids, and give the digests of both: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    path = path or tokenizer_path()

    def run(batches):
        enc = id_encoder(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            for at, texts in blocks(b.column(1)):
                ids = enc.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, len(texts)),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(map(sha, ids), pa.string()),
                        pa.array((sha(decode(path, x).encode()) for x in ids), pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_table(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Texts of an ``encode`` table: (id, text); null ids give a null text."""
    path = path or tokenizer_path()

    def run(batches):
        for b in batches:
            texts = [None if x is None else decode(path, x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


