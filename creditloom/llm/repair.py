"""Token ids in binary shards, compressed by Re-Pair grammars.

Documents are ordered by ``doc_id`` (null first; equal ids by a hash of the text) with a range
exchange, and each partition packs runs of whole documents into shards of about ``shard_ids``
ids. In a shard, frequent pairs of neighbouring symbols are replaced by nonterminals, round after
round, until no pair is frequent. Symbols from ``base`` on are rules; ``lengths`` holds how many
ids each rule expands to, so one document is decoded without the rest of its shard.

A pair never starts with a symbol that ends in the end id, so no rule crosses a document's end.

File format: a Parquet folder with one row per shard.

=========  =============  ==================================================================
part, seq  int, int       partition of the writing job and the shard's number in it
start      long           ids in earlier shards of the same part
doc_ids    array<long>    documents in order
sizes      array<int>     ids of each document, the end id included
base       int            symbols below are ids, ``base + i`` is rule i
rules      binary         two little-endian unsigned 32-bit symbols a rule
lengths    binary         one little-endian unsigned 32-bit expansion length a rule
width      int            bytes of a symbol in ``symbols``: 2 or 4
symbols    binary         the compressed sequence, little-endian
=========  =============  ==================================================================

A null or empty text has the end id alone. Repeated rows are repeated documents. An empty table
gives no shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.pieces import PieceCache, spans, sums
from creditloom.llm.tables import text_hash

SHARD_IDS = 1 << 20
MIN_COUNT = 24  # a pair found fewer times in a shard is not worth a rule
TEXTS = 1024  # encoded at once
MAX_RULES = 16_000  # with a base of 49,408 all symbols then fit 16 bits

SHARD = (
    "part int, seq int, start long, doc_ids array<bigint>, sizes array<int>, base int,"
    " rules binary, lengths binary, width int, symbols binary"
)
DIGEST = "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"

_HASH_BITS = 18
_SPREAD = {16: (np.uint32, 0x9E3779B1), 32: (np.uint64, 0x9E3779B97F4A7C15)}


# --- One shard ------------------------------------------------------------------------------


def _hashed(keys: np.ndarray, half: int) -> np.ndarray:
    kind, factor = _SPREAD[half]
    return (keys * kind(factor)) >> kind(2 * half - _HASH_BITS)


def _frequent(keys: np.ndarray, least: int):
    """Pairs found at least ``least`` times, the most frequent first (equal: the smaller pair)."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else keys
    found = np.diff(starts, append=len(keys))
    kept = found >= least
    pairs, found = keys[starts[kept]], found[kept]
    order = np.lexsort((pairs, -found))
    return pairs[order], found[order]


def compress(
    ids: np.ndarray, base: int, end_id: int, min_count: int = MIN_COUNT, max_rules: int = MAX_RULES,
    depth: int = 64,
):
    """Symbols, rules (pairs of symbols) and their expansion lengths.

    Each round takes the most frequent pairs, down to 1/``depth`` of the first one's count, that
    cannot overlap: no symbol is the right half of one and the left half of another.
    """
    half = 16 if base + max_rules <= 1 << 16 else 32  # a pair is then one 32- or 64-bit number
    kind = _SPREAD[half][0]
    symbols = ids.astype(kind)
    rules: list[tuple[int, int]] = []
    lengths = np.ones(base + max_rules, np.int64)
    ends = np.zeros(base + max_rules, bool)
    ends[end_id] = True
    while len(symbols) > 1 and len(rules) < max_rules:
        keys = (symbols[:-1] << kind(half)) | symbols[1:]
        pairs, found = _frequent(keys, min_count)
        open_ = ~ends[pairs >> kind(half)]
        pairs, found = pairs[open_], found[open_]
        if not len(pairs):
            break
        lefts, rights, chosen = set(), set(), []
        for pair, count in zip(pairs.tolist(), found.tolist()):
            if count * depth < found[0] or len(rules) + len(chosen) == max_rules:
                break
            left, right = pair >> half, pair & ((1 << half) - 1)
            if left not in rights and right not in lefts:
                lefts.add(left)
                rights.add(right)
                chosen.append(pair)
        table = np.full(1 << _HASH_BITS, -1, np.int16)
        picked = np.array(chosen, kind)
        table[_hashed(picked, half)] = np.arange(len(picked))  # of colliding pairs one waits a round
        is_left, is_right = np.zeros((2, base + max_rules), bool)
        is_left[list(lefts)], is_right[list(rights)] = True, True
        places = np.flatnonzero(is_left[symbols[:-1]])
        places = places[is_right[symbols[places + 1]]]
        which = table[_hashed(keys[places], half)]
        hit = (which >= 0) & (picked[which] == keys[places])
        places, which = places[hit], which[hit]
        # In a run such as a a a a every second place counts.
        first = np.flatnonzero(np.diff(places, prepend=-2) > 1)
        run = np.repeat(first, np.diff(first, append=len(places)))
        counted = (np.arange(len(places)) - run) % 2 == 0
        places = places[counted]
        present = np.zeros(len(picked), bool)
        present[which[counted]] = True
        used, number = np.flatnonzero(present), (np.cumsum(present) - 1)[which[counted]]
        new = base + len(rules)
        for pair in picked[used].tolist():
            left, right = pair >> half, pair & ((1 << half) - 1)
            lengths[base + len(rules)] = lengths[left] + lengths[right]
            ends[base + len(rules)] = ends[right]
            rules.append((left, right))
        symbols[places] = (new + number).astype(kind)
        stays = np.ones(len(symbols), bool)
        stays[places + 1] = False
        symbols = symbols[stays]
    pairs = np.array(rules, "<u4").reshape(-1, 2)
    return symbols, pairs, lengths[base : base + len(rules)].astype("<u4")


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids that ``symbols`` stand for. Rules refer to ids and earlier rules only."""
    starts = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
    flat = np.zeros(int(starts[-1]), np.uint32)
    for i, pair in enumerate(rules.tolist()):
        at = int(starts[i])
        for symbol in pair:
            if symbol < base:
                flat[at] = symbol
                at += 1
            else:
                size = int(lengths[symbol - base])
                source = int(starts[symbol - base])
                flat[at : at + size] = flat[source : source + size]
                at += size
    # Ids are their own expansion: spans look into the rules' ids followed by the symbols.
    symbols = symbols.astype(np.int64)
    table = np.concatenate([flat, symbols.astype(np.uint32)])
    is_rule = symbols >= base
    rule = np.where(is_rule, symbols - base, 0)
    where = np.where(is_rule, starts[rule], len(flat) + np.arange(len(symbols)))
    sizes = np.where(is_rule, np.diff(starts, append=starts[-1])[rule], 1)
    return table[spans(where, sizes)]


class Shard:
    """One stored shard, opened for whole or random access."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.sizes = np.array(row["sizes"], np.int64)
        self.base = row["base"]
        self._rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        self._lengths = np.frombuffer(row["lengths"], "<u4")
        self._symbols = np.frombuffer(row["symbols"], f"<u{row['width']}")

    def ids(self) -> np.ndarray:
        return expand(self._symbols, self._rules, self._lengths, self.base)

    def document(self, place: int) -> np.ndarray:
        """The ids of the document at ``place``, from its own symbols alone."""
        rule = np.maximum(self._symbols.astype(np.int64) - self.base, 0)
        known = np.append(self._lengths, 1).astype(np.int64)
        sizes = np.where(self._symbols >= self.base, known[np.minimum(rule, len(known) - 1)], 1)
        after = np.cumsum(sizes)
        start = int(self.sizes[:place].sum())
        first, last = np.searchsorted(after, [start, start + int(self.sizes[place])], "right")
        return expand(self._symbols[first:last], self._rules, self._lengths, self.base)


# --- Writing --------------------------------------------------------------------------------

_CACHES: dict[str, tuple[PieceCache, int]] = {}
_MAX_WORDS = 500_000
_PLAIN = chr(0x250)  # Latin letters below have no combining marks and one lower-case form each


class _WordCoder:
    """Ids of pieces between ASCII spaces and newlines, which this tokenizer encodes alone.

    Its normaliser maps white space to one space, composes and lower-cases characters, and its
    splitter never joins over white space, so a text's ids are those of its pieces. Pieces of
    plain Latin letters and signs are split here and go to the library's model word by word, each
    distinct word once; all others go through the library's whole chain.
    """

    def __init__(self, tokenizer):
        import regex

        self._tokenizer = tokenizer
        self._model = tokenizer.model
        # Fixed value: how this tokenizer's file splits a text.
        self._split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self._byte_signs = _byte_signs()
        self._words: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        signs = word
        if not word.isalpha() or not word.isascii():
            signs = word.encode().decode("latin-1").translate(self._byte_signs)
        known = self._words[word] = tuple([token.id for token in self._model.tokenize(signs)])
        return known

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self._words) > _MAX_WORDS:
            self._words.clear()
        known, ids, ends = self._words.get, [], []
        for piece in pieces:
            if piece and (piece.isascii() or max(piece) < _PLAIN) and "<|" not in piece:
                lower = piece.lower()
                if lower.isalpha():
                    ids += known(lower) or self._word(lower)
                elif lower[:-1].isalpha() and lower[-1] in ".,":
                    ids += known(lower[:-1]) or self._word(lower[:-1])
                    ids += known(lower[-1]) or self._word(lower[-1])
                else:
                    for word in self._split(lower):
                        ids += known(word) or self._word(word)
            elif piece:
                ids += self._tokenizer.encode(piece, add_special_tokens=False).ids
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(np.array(ends, np.int64), prepend=0)


def _byte_signs() -> dict[int, str]:
    """The visible sign of each byte: itself if printable, else the next free one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in visible]
    return {byte: chr(byte) for byte in visible} | {
        byte: chr(256 + place) for place, byte in enumerate(hidden)
    }


def _word_cache(path: str) -> tuple[PieceCache, int]:
    """One per worker process."""
    if path not in _CACHES:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _CACHES[path] = PieceCache(_WordCoder(tokenizer).encode), tokenizer.get_vocab_size()
    return _CACHES[path]


def _encoded(texts: pa.Array | list[str | None], cache: PieceCache, end_id: int):
    """Ids of all texts, each with the end id behind it, and how many ids each has.

    Arrow cuts the texts and finds the distinct pieces; only those become Python strings.
    """
    texts = pc.replace_substring(pa.array(texts, pa.string()), "\n", " ")
    pieces = pc.split_pattern(texts, " ")
    counts = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(pieces.flatten())
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    ids, sizes = cache.ids(distinct, coded.indices.to_numpy())
    sizes = sums(sizes, counts)
    ends = np.cumsum(sizes)
    return np.insert(ids, ends, end_id), sizes + 1


def _shard_rows(batches: Iterator[pa.RecordBatch], path: str, end_id: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    cache, base = _word_cache(path)
    part, seq, start = TaskContext.get().partitionId(), 0, 0
    docs: list = []
    sizes: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    held = 0

    def packed() -> pa.RecordBatch:
        nonlocal seq, start, held
        symbols, rules, lengths = compress(np.concatenate(ids), base, end_id)
        width = 2 if base + len(rules) <= 1 << 16 else 4
        row = {
            "part": part, "seq": seq, "start": start, "doc_ids": list(docs),
            "sizes": np.concatenate(sizes).tolist(), "base": base, "rules": rules.tobytes(),
            "lengths": lengths.tobytes(), "width": width,
            "symbols": symbols.astype(f"<u{width}").tobytes(),
        }
        seq, start, held = seq + 1, start + held, 0
        for gathered in (docs, sizes, ids):
            gathered.clear()
        return pa.RecordBatch.from_pylist([row], _SHARD_SCHEMA)

    for batch in batches:
        names, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for first in range(0, len(names), TEXTS):
            coded, counts = _encoded(texts.slice(first, TEXTS), cache, end_id)
            ends = np.cumsum(counts)
            at = 0
            while at < len(counts):  # a shard closes behind the document that fills it
                room = shard_ids - held + (int(ends[at - 1]) if at else 0)
                to = min(int(np.searchsorted(ends, room)) + 1, len(counts))
                begin, end = (int(ends[at - 1]) if at else 0), int(ends[to - 1])
                docs += names[first + at : first + to]
                sizes.append(counts[at:to])
                ids.append(coded[begin:end])
                held += end - begin
                at = to
                if held >= shard_ids:
                    yield packed()
    if docs:
        yield packed()


_SHARD_SCHEMA = pa.schema(
    [
        ("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("base", pa.int32()),
        ("rules", pa.binary()), ("lengths", pa.binary()), ("width", pa.int32()),
        ("symbols", pa.binary()),
    ]
)


def shards(docs: DataFrame, tokenizer_path: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The shards of ``doc_id, text`` in ascending order; other columns are ignored."""
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id", text_hash("text"))
        .sortWithinPartitions("doc_id", text_hash("text"))
    )
    return ordered.mapInArrow(
        lambda batches: _shard_rows(batches, tokenizer_path, end_id, shard_ids), SHARD
    )


# --- Reading --------------------------------------------------------------------------------


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row)
            data = memoryview(shard.ids().astype("<u4").tobytes())
            ends = np.cumsum(shard.sizes)
            starts = ends - shard.sizes
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(shard.doc_ids, pa.int64()),
                    "part": pa.array([row["part"]] * len(ends), pa.int32()),
                    "start_in_part": pa.array(row["start"] + starts, pa.int64()),
                    "n_tokens": pa.array(shard.sizes, pa.int64()),
                    "ids_crc32": pa.array(
                        [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())],
                        pa.int64(),
                    ),
                }
            )


def digests(stored: DataFrame) -> DataFrame:
    """Per stored document its place among all ids, its length and the checksum of its ids."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the writing job.
    before = stored.groupBy("part").agg(
        F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda total, n: total + n)).alias("held")
    ).select("part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    rows = stored.mapInArrow(_digest_rows, DIGEST)
    return rows.join(before, "part").select(
        "doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_document(stored: DataFrame, doc_id: int) -> list[int]:
    """The ids of one document: its shard alone is read, and in it its own symbols alone."""
    row = stored.where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).first()
    if row is None:
        raise KeyError(doc_id)
    return Shard(row.asDict()).document(row["doc_ids"].index(doc_id)).tolist()
