"""Token counts by a whole-token shortcut: most pieces of a text are one token, and known to be.

A byte-level BPE library cuts a text into pieces and merges each piece on its own. Before the job,
every string of the vocabulary is given to the library's merge procedure alone; those that end as
the one token they name are proven whole tokens. In a text, pieces among them count as one token
without any merging, and only the others are merged, by the library.

Nothing is approximated: pieces are cut by the tokenizer's own pattern, or by the library itself in
texts with characters that pattern libraries of different age class differently. Strings of special
tokens inside a text are one token each, as the library reads them by default.

A null text counts like an empty one: no bytes, no tokens. Rows are judged one by one, so repeated
rows and ids stay, a null id stays null, an empty table gives no rows, other columns are ignored.
Long texts are worked on in blocks, cut where no piece runs over the cut.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

# Fixed value: how byte-level BPE cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BLOCK = 1 << 18  # characters cut into pieces at a time
MAX_KEPT = 300_000  # merged pieces, and parts of texts, a worker keeps in mind
LONGEST_KEPT = 64  # characters of the longest of them

_CUT = re.compile(r"(?= \S)")
_SPACE = re.compile(r" (?=\S)")
_LOOSE_SPACE = re.compile(r" (?!\S)")


# Fixed rule of byte-level vocabularies: bytes that are printable signs of Latin-1 stand for
# themselves, the others for the characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = {byte: 256 + i for i, byte in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def spelt(piece: str) -> str:
    """A piece as byte-level vocabularies spell it."""
    return piece.encode().decode("latin-1").translate(_SIGNS)


class ByteLevel:
    """The parts of a byte-level BPE ``.json`` tokenizer that counting needs."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        cutter = said["pre_tokenizer"] or {}
        if (
            said["model"]["type"] != "BPE"
            or said["normalizer"]
            or cutter.get("type") != "ByteLevel"
            or cutter["add_prefix_space"]
            or not cutter["use_regex"]
        ):
            raise ValueError(f"{path}: not a byte-level BPE tokenizer that leaves texts as they are")
        special = said["added_tokens"]
        if any(token[flag] for token in special for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: special tokens take in what is around them")
        longest_first = sorted((token["content"] for token in special), key=len, reverse=True)
        self._tokenize = self.tokenizer.model.tokenize
        self.special = re.compile("|".join(map(re.escape, longest_first)) or r"(?!)")

    def merged(self, piece: str) -> int:
        """How many tokens one piece becomes."""
        return len(self._tokenize(spelt(piece)))

    def whole_tokens(self) -> list[str]:
        """The vocabulary strings that are proven to be one token when they are encoded alone."""
        model, decode = self.tokenizer.model, self.tokenizer.decoder.decode
        proven = []
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            text = decode([token])
            if text and spelt(text) == token:  # else it is no whole UTF-8 text
                found = model.tokenize(token)
                if len(found) == 1 and found[0].id == number:
                    proven.append(text)
        return proven


def settled_characters() -> frozenset[str]:
    """Characters beyond ASCII that Unicode 3.2 assigned: pattern libraries of any age class them alike."""
    kind = unicodedata.ucd_3_2_0.category
    return frozenset(c for c in map(chr, range(0x80, 0x30000)) if kind(c) not in ("Cn", "Co", "Cs"))


class _Pieces(dict):
    """Tokens of a piece: one for whole tokens, else what merging gives, remembered if short."""

    def __init__(self, whole: list[str], library: ByteLevel):
        super().__init__(dict.fromkeys(whole, 1))
        self._whole, self._merged = whole, library.merged

    def __missing__(self, piece: str) -> int:
        count = self._merged(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= len(self._whole) + MAX_KEPT:
                self.clear()
                self.update(dict.fromkeys(self._whole, 1))
            self[piece] = count
        return count


class _Parts(dict):
    """Tokens of a part of a text that begins at a space, given without that space."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self._count = count

    def __missing__(self, part: str) -> int:
        count = self._count(" " + part)
        if len(part) <= LONGEST_KEPT:
            if len(self) >= MAX_KEPT:
                self.clear()
            self[part] = count
        return count


class TokenCounter:
    """Counts the tokens of whole texts.

    A space before a visible character always starts a piece, so texts fall into parts there, and
    a part that comes again is not cut into pieces again.
    """

    def __init__(self, path: str, whole: list[str]):
        import regex

        self._library = ByteLevel(path)
        self._pieces = _Pieces(whole, self._library)
        self._parts = _Parts(self._part)
        self._cut = regex.compile(PIECES).findall
        self._settled = settled_characters() | frozenset(map(chr, range(0x80)))

    def count(self, text: str) -> int:
        total, start = 0, 0
        for special in self._library.special.finditer(text):
            total += self._plain(text[start : special.start()]) + 1
            start = special.end()
        return total + self._plain(text[start:])

    def _plain(self, text: str) -> int:
        total = 0
        for block in _blocks(text):
            first, *others = _SPACE.split(block) if _LOOSE_SPACE.search(block) else block.split(" ")
            total += self._part(first) + sum(map(self._parts.__getitem__, others))
        return total

    def _part(self, part: str) -> int:
        if not part.isascii() and not self._settled.issuperset(part):
            cut = self._library.tokenizer.pre_tokenizer.pre_tokenize_str(part)
            pieces = [part[first:end] for _, (first, end) in cut]
        else:
            pieces = self._cut(part)
        return sum(map(self._pieces.__getitem__, pieces))


def _blocks(text: str) -> Iterator[str]:
    start = 0
    while start < len(text):
        cut = _CUT.search(text, start + BLOCK) if len(text) - start > BLOCK else None
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


_COUNTERS: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """``n_bytes`` and ``n_tokens`` of every text, and whether the tokens exceed ``limit``.

    ``path`` names a byte-level BPE ``.json`` file that all machines have. The proof runs once,
    when the plan is made; its result is no larger than the vocabulary.
    """
    whole = ByteLevel(path).whole_tokens()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:  # one per worker process
            _COUNTERS[path] = TokenCounter(path, whole)
        counter = _COUNTERS[path]
        for batch in batches:
            texts = batch.column("text")
            counts = [counter.count(text.as_py() or "") for text in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([count > limit for count in counts], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, COUNTS)
