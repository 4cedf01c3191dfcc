"""Byte-level BPE by dynamic programming over prefixes.

The BPE encoding of a prefix ends in exactly one token, and that token is the only one that both
ends the prefix and may follow the last token of the prefix before it. So an encoder stores one
token per byte prefix: the encoding is read off backwards, appending bytes only adds entries, and
after an edit only entries near it change.

Two tokens may follow each other if the merges turn their joined bytes back into just these two.

A null text is encoded as the empty text, which has no ids. Texts are encoded whole, each match
of the pattern by itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from creditloom.llm.pieces import PieceCache, spans, sums

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS = "doc_id long, ids array<int>"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixCoder:
    """Encodes byte pieces with a table of merge ranks."""

    def __init__(self, ranks: dict[bytes, int], memory: int = 300_000):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        # Sizes of the tokens with the same last four bytes, largest first.
        sizes: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 3:
                sizes.setdefault(token[-4:], set()).add(len(token))
        self._sizes = {tail: (*sorted(found, reverse=True), 3, 2, 1) for tail, found in sizes.items()}
        self._memory = memory
        self._follows: dict[tuple[int, int], bool] = {}
        self._last: dict[bytes, int] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The encoding by merging the pair of lowest rank, the leftmost first, step by step."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[part] for part in parts]

    def follows(self, left: int, right: int) -> bool:
        """May ``right`` stand behind ``left`` in an encoding?"""
        pair = left << 32 | right
        known = self._follows.get(pair)
        if known is None:
            joined = self.bytes_of[left] + self.bytes_of[right]
            known = joined not in self.ranks and self.merged(joined) == [left, right]
            if len(self._follows) >= self._memory:
                self._follows.clear()
            self._follows[pair] = known
        return known

    def _ending(self, text: bytes, end: int, last) -> int:
        """The last token of ``text[:end]``; ``last(i)`` gives that of the shorter prefixes."""
        rank = self.ranks.get
        for size in self._sizes.get(text[max(0, end - 4) : end], (3, 2, 1)):
            if size <= end:
                token = rank(text[end - size : end])
                if token is not None and (size == end or self.follows(last(end - size), token)):
                    return token
        raise ValueError("the ranks lack a byte")

    def _last_of(self, prefix: bytes) -> int:
        """The kept last token of a prefix, found on first use with those it depends on."""
        token = self._last.get(prefix)
        if token is None:
            token = self._ending(prefix, len(prefix), lambda end: self._last_of(prefix[:end]))
            self._last[prefix] = token
        return token

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece. Prefixes of short pieces are kept, as other pieces share them."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 48:
            return PrefixTable(self, piece).ids()
        if len(self._last) >= self._memory:
            self._last.clear()
        ids = []
        while piece:
            ids.append(self._last_of(piece))
            piece = piece[: -len(self.bytes_of[ids[-1]])]
        return ids[::-1]


class PrefixTable:
    """The last token of every prefix of one piece, kept up to date through edits.

    ``ids()`` of the table always equals the encoding of its bytes from scratch.
    """

    def __init__(self, coder: PrefixCoder, piece: bytes = b""):
        self._coder = coder
        self.piece = b""
        self._last: list[int] = []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Exact append: no stored entry changes."""
        self.piece += more
        self._fill(len(self.piece))

    def _fill(self, to: int) -> None:
        for end in range(len(self._last) + 1, to + 1):
            self._last.append(self._coder._ending(self.piece, end, lambda i: self._last[i - 1]))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Replace ``piece[start:stop]``; returns how many entries were computed anew.

        An entry depends on the bytes and entries at most one longest token back. Once that many
        entries in a row agree with the old ones behind the edit, the rest is unchanged.
        """
        old, shift = self._last, len(new) - (stop - start)
        self.piece = self.piece[:start] + new + self.piece[stop:]
        self._last = old[:start]
        settled = start + len(new)
        self._fill(settled)
        agreed = 0
        while len(self._last) < len(self.piece) and agreed < self._coder.longest:
            self._fill(len(self._last) + 1)
            place = len(self._last)
            agreed = agreed + 1 if old[place - shift - 1] == self._last[-1] else 0
        computed = len(self._last) - start
        self._last += old[len(self._last) - shift :]
        return computed

    def ids(self) -> list[int]:
        """Any prefix's encoding can be read off the same way."""
        ids, end = [], len(self._last)
        while end:
            ids.append(self._last[end - 1])
            end -= len(self._coder.bytes_of[ids[-1]])
        return ids[::-1]


# --- Whole texts ----------------------------------------------------------------------------

# A space that is not followed by a letter, sign or digit stays with what is around it.
_LOOSE_SPACE = re.compile(r" (?=\s|$)")
_CUT = re.compile(r" (?=\S)")

# Characters (or bytes) worked on at a time, which bounds a worker's memory and changes no result.
BLOCK = 1 << 18


class TextCoder:
    """Encodes whole texts and decodes their ids.

    A match of the pattern never runs over a space that a visible character follows, so a text is
    cut there first, and each distinct part is matched against the pattern only once.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.coder = PrefixCoder(ranks)
        self._matches = regex.compile(pattern).findall
        self._known: dict[str, tuple[int, ...]] = {}
        self._cache = PieceCache(self._parts, 300_000)
        tokens = [self.coder.bytes_of.get(i, b"") for i in range(max(self.coder.bytes_of) + 1)]
        self._sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _parts(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        """A part at the start of a text comes as a tuple, any other one lost a space before it."""
        if len(self._known) > 150_000:
            self._known.clear()
        ids: list[int] = []
        ends = []
        for part in parts:
            for match in self._matches(part[0] if isinstance(part, tuple) else " " + part):
                known = self._known.get(match)
                if known is None:
                    known = tuple(self.coder.encode(match.encode()))
                    if len(match) < 40:
                        self._known[match] = known
                ids += known
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(np.array(ends, np.int64), prepend=0)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and how many each has."""
        counts = np.zeros(len(texts), np.int64)
        found, parts, owners, sizes, held = [], [], [], [], 0

        def flush() -> None:
            ids, each = self._cache.ids(parts)
            np.add.at(counts, np.array(owners, np.int64), sums(each, np.array(sizes, np.int64)))
            found.append(ids)
            for filled in (parts, owners, sizes):
                filled.clear()

        for place, text in enumerate(texts):
            for start, segment in _segments(text or ""):
                own: list = _CUT.split(segment) if _LOOSE_SPACE.search(segment) else segment.split(" ")
                if start == 0:
                    own[0] = (own[0],)
                parts += own
                owners.append(place)
                sizes.append(len(own))
                held += len(segment)
                if held >= BLOCK:
                    flush()
                    held = 0
        flush()
        return np.concatenate(found), counts

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids end to end and how many each id has."""
        sizes = self._sizes[ids]
        starts = self._starts[ids]
        blocks = [slice(i, i + BLOCK // 4) for i in range(0, max(1, len(ids)), BLOCK // 4)]
        return np.concatenate([self._bytes[spans(starts[b], sizes[b])] for b in blocks]), sizes


def _segments(text: str) -> Iterator[tuple[int, str]]:
    """The text in segments of about ``BLOCK`` characters with their places, cut where parts are."""
    start = 0
    while start < len(text):
        cut = _CUT.search(text, start + BLOCK) if len(text) - start > BLOCK else None
        yield start, text[start : cut.start()] if cut else text[start:]
        start = cut.end() if cut else len(text)


_CODERS: dict[tuple[str, str], TextCoder] = {}


def text_coder(ranks_path: str, pattern: str) -> TextCoder:
    """One per worker process."""
    if (ranks_path, pattern) not in _CODERS:
        _CODERS[ranks_path, pattern] = TextCoder(load_ranks(ranks_path), pattern)
    return _CODERS[ranks_path, pattern]


def _pieces_of(batch: pa.RecordBatch):
    """Slices of about ``BLOCK`` bytes of text, never less than one document."""
    names, texts = batch.column("doc_id"), batch.column("text")
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    block = (np.cumsum(lengths, dtype=np.int64) + np.arange(batch.num_rows)) // BLOCK
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for first, end in zip(edges, edges[1:]):
        yield names.slice(first, end - first), texts.slice(first, end - first).to_pylist()


def token_ids(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id`` and the ids of each text. Other columns are ignored."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_coder(ranks_path, pattern)
        for batch in batches:
            for names, texts in _pieces_of(batch):
                ids, counts = coder.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([names, lists], ["doc_id", "ids"])

    return _narrow(docs).mapInArrow(rows, IDS)


def round_trips(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document the digests of its ids and of the bytes those ids decode to."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_coder(ranks_path, pattern)
        for batch in batches:
            for names, texts in _pieces_of(batch):
                ids, counts = coder.encode(texts)
                decoded, sizes = coder.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        names,
                        pa.array(counts, pa.int64()),
                        pa.array(_digests(ids.astype("<u4").view(np.uint8), counts * 4)),
                        pa.array(_digests(decoded, sums(sizes, counts))),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _narrow(docs).mapInArrow(rows, ENCODED)


def _digests(data: np.ndarray, sizes: np.ndarray) -> list[str]:
    view, ends = memoryview(np.ascontiguousarray(data)), np.cumsum(sizes)
    return [
        hashlib.sha256(view[a:b]).hexdigest() for a, b in zip((ends - sizes).tolist(), ends.tolist())
    ]


def _narrow(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
