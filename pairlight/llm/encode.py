"""Byte-pair encoding by dynamic programming over prefixes.

For every prefix of a piece of bytes there is exactly one token that ends the
encoding of that prefix. The table of these last tokens is filled from left to
right: of the tokens that end at a position, the valid one is the token that may
stand after the (already known) last token of the prefix before it. Reading the
table backwards gives the encoding of any prefix, so text can be appended
without encoding anything again, and after an edit only the pieces around it
are looked at.

Pieces are what the vocabulary's splitting pattern gives; byte-pair merges never
cross a piece.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql.functions import pandas_udf

from pairlight.cluster import spread

#: Folder of the public tokenizer files, unless a caller names another.
TOKENIZER_DIR = os.environ.get("PAIRLIGHT_TOKENIZERS", "/opt/tokenizers")

#: Splitting pattern of byte-level BPE vocabularies of this kind (fixed value).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces whose ids are kept between texts; the store is emptied when full.
MAX_KEPT_PIECES = 200_000
#: Longer pieces are not kept.
MAX_KEPT_CHARS = 64


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, by rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens of a byte-level BPE file, with how each is formed by a merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        to_bytes = lambda t: bytes(letters[c] for c in t)
        single = [t for t in ids if len(t) == 1 and t in letters]
        self.id_of: dict[bytes, int] = {to_bytes(t): ids[t] for t in single}
        #: merge rank of a token (single bytes: -1) and the pair that forms it
        self.rank: dict[int, int] = {ids[t]: -1 for t in single}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            token = ids[a + b]
            if token not in self.rank:
                self.id_of[to_bytes(a + b)] = token
                self.rank[token] = r
                self.parts[token] = (ids[a], ids[b])
            self.merge.setdefault((ids[a], ids[b]), r)
        self.longest = max(map(len, self.id_of))
        self._next: dict[tuple[int, int], bool] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is just these two tokens.

        Both tokens are taken apart in the reverse order of their merges. At each
        step the two tokens that touch at the seam were both present at once for
        a while; they stay apart only if a merge of the two would have come
        later than the merge that used one of them up.
        """
        if (known := self._next.get((left, right))) is not None:
            return known
        rank, parts = self.rank, self.parts
        a, b, until, ok = left, right, len(self.merge) + 1, True
        while True:
            joined = self.merge.get((a, b))
            if joined is not None and joined < until:
                ok = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            # the merge that came last is undone first; of equals, the right one came later
            if ra > rb:
                until, a = ra, parts[a][1]
            else:
                until, b = rb + 1, parts[b][0]
        if len(self._next) > 2_000_000:
            self._next.clear()
        self._next[left, right] = ok
        return ok


class PrefixTable:
    """Last token of every prefix of one piece; grows by :meth:`extend`."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.data, self.last = vocabulary, b"", []

    def extend(self, more: bytes) -> PrefixTable:
        v, start = self.vocabulary, len(self.data)
        self.data += more
        data, last, id_of, may = self.data, self.last, v.id_of, v.may_follow
        for end in range(start + 1, len(data) + 1):
            for begin in range(max(0, end - v.longest), end):
                token = id_of.get(data[begin:end])
                if token is not None and (begin == 0 or may(last[begin - 1][0], token)):
                    last.append((token, begin))
                    break
        return self

    def ids(self, end: int | None = None) -> list[int]:
        """Encoding of the first ``end`` bytes, all by default."""
        at, out = len(self.data) if end is None else end, []
        while at:
            token, at = self.last[at - 1]
            out.append(token)
        return out[::-1]


class Encoder:
    """Encodes whole texts; keeps the ids of short pieces between texts."""

    def __init__(self, path: str | None = None):
        self.vocabulary = Vocabulary(path or f"{TOKENIZER_DIR}/byte_bpe_50k.json")
        self.split = regex.compile(PIECES)
        self.kept: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        ids = self.kept.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.vocabulary.id_of.get(data) if len(piece) == 1 else None
            ids = [whole] if whole is not None else PrefixTable(self.vocabulary).extend(data).ids()
            if len(piece) <= MAX_KEPT_CHARS:
                if len(self.kept) >= MAX_KEPT_PIECES:
                    self.kept.clear()
                self.kept[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text without special tokens; null and empty: none."""
        if not text:
            return []
        out: list[int] = []
        kept, piece = self.kept, self.piece
        for p in self.split.findall(text):
            out += kept.get(p) or piece(p)
        return out

    def count(self, text: str | None) -> int:
        kept, piece = self.kept, self.piece
        return sum(len(kept.get(p) or piece(p)) for p in self.split.findall(text)) if text else 0


class EditableText:
    """A text with its encoding, kept exact under appends and replacements."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.pieces: list[str] = []
        self.append(text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` for text[start:end]; looks only at pieces near the edit.

        Splitting starts again two pieces before the edit (a piece can depend on
        the character after it) and stops where it meets an old boundary at
        least one piece behind the edit.
        """
        bounds, at = [], 0
        for p in self.pieces:
            bounds.append(at)
            at += len(p)
        before = sum(1 for b in bounds if b < start)
        first = max(0, before - 2)
        begin = bounds[first] if first < len(bounds) else 0
        self.text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        old = {b + shift: i for i, b in enumerate(bounds) if b > end}
        fresh: list[str] = []
        resume = len(self.pieces)
        for m in self.encoder.split.finditer(self.text, begin):
            if m.start() in old and m.start() > start + len(new):
                resume = old[m.start()]
                break
            fresh.append(m.group())
        self.pieces[first:resume] = fresh

    def ids(self) -> list[int]:
        return [i for p in self.pieces for i in self.encoder.piece(p)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder a Python worker and file."""
    key = path or ""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path)
    return _ENCODERS[key]


def encode_column(path: str | None = None):
    """Arrow function of a text column to its list of token ids."""
    @pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for texts in batches:
            yield pd.Series([e.encode(t) for t in texts], dtype=object)

    return ids


def count_column(path: str | None = None):
    """Arrow function of a text column to its number of tokens (null: 0)."""
    @pandas_udf("bigint")
    def n(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for texts in batches:
            yield pd.Series([e.count(t) for t in texts], dtype="int64")

    return n


def encode_documents(documents, path: str | None = None):
    """``doc_id`` and ``ids`` of every document; null and empty text: empty list.

    White space is encoded as it stands. Other columns are neither read nor
    kept. One row comes out for each row that went in, repeated ids included.
    """
    return spread(documents.select("doc_id", "text")).select("doc_id", encode_column(path)("text").alias("ids"))
