"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint is the bitwise majority of the hashes of its word shingles. Fingerprints
link when they differ in at most ``RADIUS`` = 3 bits. Every distinct fingerprint emits variants
of itself, and two linked ones always emit a common variant: differing in one or two bits, they
meet at one flipped bit each; in three, at one flipped bit of one and two of the other. An odd
difference means that one fingerprint has an even and the other an odd number of ones, so only
even ones emit variants of two flips, and of three bits two always lie in the same half, so only
pairs of bits within a half are flipped.

Who meets at a variant is linked if their distances to it add up to at most three: that is
everyone, as soon as one of them is at most one flip away, so a star around that one links them
all without listing pairs. Each edge of a star is checked once more by its differing bits.

Variants are not shuffled one by one. They are dealt by some of their bits, and a fingerprint goes
once to each such bucket that any of its variants falls into; there its variants of that bucket
are made and met. Buckets are sized by the number of distinct fingerprints, so they stay small.

Null and empty texts have fingerprint zero and link like any others. Repeated rows and texts meet
in their fingerprint. Null ids take part, but no component is named after one.

Three bits of one fingerprint reach only near-identical texts: at a Jaccard similarity of 0.8 about
a seventh of all bits differ. So ``deduplicated`` can go by the shingle sets instead, with ``BANDS``
short fingerprints of each set. Every one of them is ball-hashed at a radius of two bits (all
variants of one flip, met at equal variants); who meets in any of them, with lengths and wider
fingerprints that allow the similarity, is counted on the whole sets. A pair at 0.8 exactly is
within two bits in one band or more with a probability of 0.98, at 0.825 of 0.994, and above 0.85
practically always; no count of partners or candidates is limited.

Crowds of similar texts are joined first, by one partner each: a text is counted against the
smallest one that shares the most whole bands with it. Then each text is counted against the
nearest one of another class that it meets, round after round while that joins many. Each round has
a row a text and bucket and not a row a pair. Only then all pairs still apart are listed, and of
these only the ones that may be similar by an exact bound: two texts of different classes cannot
have more in common than each of them shares with texts of other classes. Texts of a crowd that
own more than a ninth of their shingles alone, as those with a common template, thus make no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.components import components
from creditloom.session import materialize

SHINGLE = 3
SEED = 42
RADIUS = 3
BITS = 64
BANDS = 20  # short fingerprints of a shingle set
BAND_BITS = 28
PARTS = ((0, 10), (10, 19), (19, 28))  # of two differing bits, one of three parts has none
WORDS = BANDS // 2  # a word holds two bands
CHECK_WORDS = 5  # carried where all texts meet; those that have a partner carry all words afterwards
CHECK_BITS = {5: 64, 10: 116}  # that may differ, by words; at 0.8 they are 42 of 280 (deviation 6), 85 of 560 (8.5)
ROUND_GAIN = 10  # another round of nearest partners if one text in so many found a similar one
PAIRS_AT_ONCE = 50_000  # whose bits are compared in one go, about 30 MB of them
BUCKET_TEXTS = 4_000  # wanted in a bucket of one part of a band
BUCKET_FINGERPRINTS = 4_000  # wanted of distinct fingerprints to a bucket's own bits

_FLIPS = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
_HALF = BITS // 2


# --- Fingerprints ---------------------------------------------------------------------------


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """The hashes of a text's word shingles in order; a text without words has none."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split() if text else []  # bytes: only A-Z and ASCII white space
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes) - 1
    width = min(shingle, len(found))
    starts = (ends - sizes + 1)[: len(found) - width + 1].tolist()
    view = memoryview(joined)
    return np.fromiter(
        (xxh64_intdigest(view[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())),
        np.uint64,
        len(starts),
    )


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one whole text, as an unsigned number."""
    hashes = shingle_hashes(text, shingle, seed)
    counts = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), 4096):
        octets = hashes[first : first + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_FLIPS[2 * counts > len(hashes)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, key: list[str]) -> DataFrame:
    """The ``key`` columns and ``fp``, the fingerprint as a signed long, of each ``text``."""
    schema = docs.select(*key).schema.add("fp", "long")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.fromiter(
                (fingerprint(text.as_py()) for text in batch.column("text")), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(key))] + [pa.array(codes.view(np.int64))],
                [*key, "fp"],
            )

    return docs.select(*key, "text").mapInArrow(rows, schema)


# --- Links ----------------------------------------------------------------------------------


def _bucket_flips(bits: int) -> dict[bool, np.ndarray]:
    """What to flip in a bucket number for the buckets a fingerprint's variants fall into.

    The bucket number is the first ``bits`` bits. By evenness: an even fingerprint emits two flips.
    """
    one = [1 << (BITS - 1 - i) for i in range(bits)]
    two = [a | b for half in (one[:_HALF], one[_HALF:]) for a, b in combinations(half, 2)]
    return {False: np.array([0, *one], np.uint64), True: np.array([0, *one, *two], np.uint64)}


def _dealt(distinct: DataFrame, bits: int) -> DataFrame:
    """``bucket, fp`` once for each bucket that a variant of the fingerprint falls into."""
    flips = _bucket_flips(bits)
    shift = BITS - bits
    even = F.bit_count("fp") % 2 == 0
    lists = {
        side: F.array(*[F.lit(int(flip >> np.uint64(shift))) for flip in values]) for side, values in flips.items()
    }
    own = F.shiftrightunsigned("fp", shift)
    dealt = distinct.select(
        "fp", own.alias("own"), F.explode(F.when(even, lists[True]).otherwise(lists[False])).alias("flip")
    )
    return dealt.select(F.col("own").bitwiseXOR(F.col("flip")).alias("bucket"), "fp")


def _inside(codes: np.ndarray, flips: np.ndarray, bucket: np.uint64, shift: int):
    """Variants of ``codes`` in the bucket, with the place of the code each comes from.

    Codes are grouped by how their bucket bits differ from the bucket, since that difference alone
    says which flips lead into it.
    """
    top = codes >> np.uint64(shift)
    flip_top = flips >> np.uint64(shift)
    for gap in np.unique(top ^ bucket):
        fitting = flips[flip_top == gap]
        if len(fitting):
            members = np.flatnonzero((top ^ bucket) == gap)
            for first in range(0, len(members), 2048):
                part = members[first : first + 2048]
                yield (codes[part, None] ^ fitting[None, :]).ravel(), np.repeat(part, len(fitting))


_ONE = np.concatenate([np.zeros(1, np.uint64), _FLIPS])
_TWO = np.array(
    [int(_FLIPS[i] | _FLIPS[j]) for half in (range(_HALF), range(_HALF, BITS)) for i, j in combinations(half, 2)],
    np.uint64,
)


def _bucket_edges(codes: np.ndarray, bucket: int, bits: int) -> np.ndarray:
    """Links found in one bucket as pairs of places in ``codes``, thinned to a spanning forest."""
    shift = BITS - bits
    number = np.uint64(bucket)
    near, owners = [], []
    for variants, places in _inside(codes, _ONE, number, shift):
        near.append(variants)
        owners.append(places)
    variants, places = np.concatenate(near), np.concatenate(owners)
    order = np.argsort(variants, kind="stable")
    variants, places = variants[order], places[order]
    first = np.flatnonzero(np.concatenate([[True], variants[1:] != variants[:-1]]))
    centre = places[first]
    star = np.repeat(centre, np.diff(first, append=len(places)))
    parent = np.arange(len(codes))
    _join(parent, codes, places, star)
    # Two flips of even fingerprints are looked up among the variants above; a small table of
    # hash bits tells most absent ones without a search.
    keys = variants[first]
    bloom = np.zeros(1 << 22, bool)
    bloom[_spread(keys)] = True
    even = np.bitwise_count(codes) % 2 == 0
    evens = np.flatnonzero(even)
    for found, owner in _inside(codes[evens], _TWO, number, shift):
        maybe = np.flatnonzero(bloom[_spread(found)])
        found, owner = found[maybe], evens[owner[maybe]]
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        hit = keys[at] == found
        _join(parent, codes, owner[hit], centre[at[hit]])
    roots = _roots(parent)
    linked = np.flatnonzero(roots != np.arange(len(codes)))
    return np.stack([linked, roots[linked]], axis=1)


def _spread(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if np.array_equal(above, parent):
            return parent
        parent = above


def _join(parent: np.ndarray, codes: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Merge the sets of ``left`` and ``right`` places, pair by pair, after checking each pair."""
    close = (left != right) & (np.bitwise_count(codes[left] ^ codes[right]) <= RADIUS)
    left, right = left[close], right[close]
    while len(left):
        parent[:] = _roots(parent)
        a, b = parent[left], parent[right]
        open_ = a != b
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def links(distinct: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect exactly the distinct fingerprints ``fp`` that link.

    Within a bucket a spanning forest of its links stands for all of them.
    """
    n = distinct.count()
    bits = max(2, min(BITS // 2, int(np.ceil(np.log2(max(n, 1) / BUCKET_FINGERPRINTS + 1)))))

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = np.unique(pdf["fp"].to_numpy(np.int64).view(np.uint64))
        pairs = codes[_bucket_edges(codes, int(pdf["bucket"].iloc[0]), bits)].view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return _dealt(distinct, bits).groupBy("bucket").applyInPandas(edges, "a long, b long")


def near_duplicates(docs: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Fingerprints ``key…, fp`` of all rows, and ``fp, root`` for those linked to another one."""
    marked = materialize(fingerprints(docs, key))
    return marked, materialize(components(links(marked.select("fp").distinct())).toDF("fp", "root"))


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` in hex and ``component_id``, the smallest id reachable.

    Of texts without an id that reach no other, ``component_id`` is null.
    """
    marked, roots = near_duplicates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    by_code = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = by_code.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- Similar shingle sets -------------------------------------------------------------------

_BAND = (1 << BAND_BITS) - 1
_SPREADS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_SIGNS = [f"w{i}" for i in range(WORDS)]
_CHECKS = _SIGNS[:CHECK_WORDS]


def _fixed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed; its shuffles, which hold whole texts or a row a text and bucket, do not pile up."""
    return materialize(df, drop_shuffles=True)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes in rising order; all texts without words have the same one."""
    found = np.unique(shingle_hashes(text, shingle, SEED).view(np.int64))
    return found if len(found) else np.zeros(1, np.int64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` words of two bands each: bitwise majorities of as many mixed forms of the hashes."""
    counts = np.zeros(WORDS * 64, np.int64)
    plain = hashes.view(np.uint64)
    for first in range(0, len(plain), 255):  # as many as a byte can count
        mixed = plain[first : first + 255, None] + _SPREADS[None, :]
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        octets = (mixed ^ (mixed >> np.uint64(31))).astype("<u8").view(np.uint8).reshape(len(mixed), -1)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    ones = (2 * counts > len(plain)).reshape(WORDS, 64)
    ones[:, 2 * BAND_BITS :] = False
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel().view(np.int64)


def _signed(keyed: DataFrame, shingle: int) -> DataFrame:
    """``tie, n`` and the signature's words, once for each distinct text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ties, first = np.unique(batch.column("tie").to_numpy(), return_index=True)
            sets = [shingle_set(batch.column("text")[int(i)].as_py(), shingle) for i in first]
            words = np.array([signature(x) for x in sets], np.int64).reshape(-1, WORDS)
            sizes = np.array([len(x) for x in sets], np.int64)
            columns = [ties, sizes, *np.ascontiguousarray(words.T)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["tie", "n", *_SIGNS])

    found = keyed.select("tie", "text").mapInArrow(rows, ", ".join(f"{name} long" for name in ["tie", "n", *_SIGNS]))
    return found.groupBy("tie").agg(*[F.first(name).alias(name) for name in ["n", *_SIGNS]])


def _banded(signed: DataFrame, *columns: str) -> DataFrame:
    """``columns``, ``band`` and ``code``, the band's bits, for each band of each text."""
    each = signed.select(*columns, F.array(*_SIGNS).alias("words"), F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    word = F.expr("words[band div 2]")
    code = F.when(F.col("band") % 2 == 0, word).otherwise(F.shiftrightunsigned(word, BAND_BITS)).bitwiseAND(F.lit(_BAND))
    return each.select(*columns, "band", code.alias("code"))


def _partners(signed: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of a text and that with which it shares most bands, the smallest there, and two at least."""
    posted = _banded(signed, "tie").select("tie", (F.col("band").cast("long") * (_BAND + 1) + F.col("code")).alias("key"))
    least = posted.groupBy("key").agg(F.min("tie").alias("centre"), F.count(F.lit(1)).alias("met")).where("met > 1")
    shared = posted.join(least.drop("met"), "key").where("tie <> centre").groupBy("tie", "centre").count()
    best = F.max_by("centre", F.struct("count", F.bitwise_not("centre").alias("least")))
    chosen = shared.where("count > 1").groupBy("tie").agg(best.alias("centre"))
    return chosen.select(F.col("centre").alias("a"), F.col("tie").alias("b"))


def _gaps(words: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits by band between the texts at ``x`` and at ``y``: a row a pair."""
    differ = words[x] ^ words[y]
    halves = np.stack([differ & np.uint64(_BAND), differ >> np.uint64(BAND_BITS)], axis=2)
    return np.bitwise_count(halves).reshape(len(x), 2 * words.shape[1])


def _bucket_pairs(rows: pd.DataFrame, similarity: float, signs: list[str]) -> Iterator[np.ndarray]:
    """Chunks of places ``x, y`` and ``gap`` of texts with different roots that meet here and may be similar.

    ``rows`` are sorted by root and are of one bucket of one part of a band. A pair comes in the first
    part only in which its codes agree, and not at all if it meets in an earlier one of the bands carried.
    """
    codes, sizes, shared, roots = (rows[name].to_numpy(np.int64) for name in ("code", "n", "shared", "root"))
    words = rows[signs].to_numpy(np.int64).view(np.uint64)
    part, band = int(rows["part"].iloc[0]), int(rows["band"].iloc[0])
    low, high = PARTS[part]
    allowed = CHECK_BITS[len(signs)]
    flips = np.array([0, *[1 << i for i in range(BAND_BITS) if not low <= i < high]], np.int64)
    variants = (codes[:, None] ^ flips[None, :]).ravel()
    places = np.repeat(np.arange(len(codes)), len(flips))
    order = np.argsort(variants, kind="stable")
    variants, places = variants[order], places[order]
    # Within a variant texts stand by root: each meets all that stand behind its own root's block.
    new_run = np.concatenate([[True], variants[1:] != variants[:-1]])
    new_block = new_run | np.concatenate([[True], roots[places[1:]] != roots[places[:-1]]])
    runs, blocks = np.flatnonzero(new_run), np.flatnonzero(new_block)
    run_end = np.append(runs[1:], len(places))[np.cumsum(new_run) - 1]
    block_end = np.append(blocks[1:], len(places))[np.cumsum(new_block) - 1]
    partners = run_end - block_end
    busy = np.flatnonzero(partners)
    ends = np.cumsum(partners[busy])
    first = 0
    while first < len(busy):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PAIRS_AT_ONCE, "right")))
        part_of = busy[first:last]
        counts = partners[part_of]
        left = np.repeat(part_of, counts)
        steps = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        x, y = places[left], places[block_end[left] + steps]
        fits = (1 + similarity) * np.minimum(shared[x], shared[y]) >= similarity * (sizes[x] + sizes[y]) - 1e-6
        for lower, upper in PARTS[:part]:
            fits &= ((codes[x] ^ codes[y]) >> lower) & ((1 << (upper - lower)) - 1) != 0
        x, y = x[fits], y[fits]
        gaps = _gaps(words, x, y)
        total = gaps.sum(axis=1, dtype=np.int64)
        near = (total <= allowed) & (gaps[:, :band] > 2).all(axis=1)
        yield np.unique(np.stack([x[near], y[near], total[near]], axis=1), axis=0)
        first = last


def _closest(pairs: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Of ``x, y, gap`` in both directions one row for each ``x``: that with the least gap, then the smallest tie."""
    order = np.lexsort((ties[pairs[:, 1]], pairs[:, 2], pairs[:, 0]))
    pairs = pairs[order]
    return pairs[np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]])] if len(pairs) else pairs


def _dealt_texts(signed: DataFrame, n: int, signs: list[str]) -> DataFrame:
    """Each of the ``n`` texts once for each part of each band, with the bucket of the part's own bits."""
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) / BUCKET_TEXTS)), 0, min(high - low for low, high in PARTS)))
    slots = [
        F.struct(F.lit(i).alias("part"), F.shiftright("code", low).bitwiseAND(F.lit((1 << bits) - 1)).alias("bucket"))
        for i, (low, _) in enumerate(PARTS)
    ]
    carried = ["tie", "n", "shared", "root", *signs]
    return (
        _banded(signed, *carried)
        .select(*carried, "band", "code", F.explode(F.array(*slots)).alias("slot"))
        .select(*carried, "band", "code", "slot.part", "slot.bucket")
    )


def _meetings(signed: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` with different ``root`` that meet in a band and may be similar, each once."""

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["root", "tie"], kind="stable")
        ties = pdf["tie"].to_numpy(np.int64)
        found = np.concatenate([np.zeros((0, 3), np.int64), *_bucket_pairs(pdf, similarity, _SIGNS)])
        both = np.unique(np.sort(ties[found[:, :2]], axis=1), axis=0)
        return pd.DataFrame(both, columns=["a", "b"])

    dealt = _dealt_texts(signed, signed.count(), _SIGNS)
    return _fixed(dealt.groupBy("band", "part", "bucket").applyInPandas(pairs, "a long, b long"))


def _nearest(signed: DataFrame, roots: DataFrame, similarity: float, signs: list[str]) -> DataFrame:
    """``tie, other``: for each text that meets one of another root, the one with the least differing bits.

    A bucket tells one partner a text, so the rows do not grow with the number of pairs.
    """

    def closest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["root", "tie"], kind="stable")
        ties = pdf["tie"].to_numpy(np.int64)
        best = np.zeros((0, 3), np.int64)
        for found in _bucket_pairs(pdf, similarity, signs):
            best = _closest(np.concatenate([best, found, found[:, [1, 0, 2]]]), ties)
        return pd.DataFrame({"tie": ties[best[:, 0]], "other": ties[best[:, 1]], "gap": best[:, 2]})

    dealt = _dealt_texts(_rooted(signed, roots).withColumn("shared", F.col("n")), signed.count(), signs)
    told = dealt.groupBy("band", "part", "bucket").applyInPandas(closest, "tie long, other long, gap long")
    return _fixed(told.groupBy("tie").agg(F.min_by("other", F.struct("gap", "other")).alias("other")))


def _sets_of(ties: DataFrame, keyed: DataFrame, shingle: int) -> DataFrame:
    """``tie, hashes``: the shingle sets of the texts named in ``ties``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), shingle) for text in batch.column("text")]
            ends = np.cumsum([0, *map(len, sets)])
            hashes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sets, ends[:0]])))
            yield pa.RecordBatch.from_arrays([batch.column("tie"), hashes], ["tie", "hashes"])

    texts = keyed.select("tie", "text").join(ties.select("tie").distinct(), "tie", "left_semi")
    once = texts.groupBy("tie").agg(F.first("text").alias("text"))
    return _fixed(once.mapInArrow(rows, "tie long, hashes array<bigint>"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("tie"))


def _counted(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose whole shingle sets have the similarity."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                one, other = (side.values.to_numpy(zero_copy_only=False) for side in (left, right))
                common = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(common >= similarity * (len(one) + len(other) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = (
        pairs.select("a", "b")
        .join(sets.toDF("b", "right"), "b")
        .join(sets.toDF("a", "left"), "a")
        .select("a", "b", "left", "right")
    )
    return _fixed(both.mapInArrow(rows, "a long, b long"))


def similar(keyed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """All pairs ``a, b`` of the ``tie`` of texts whose shingle sets have the Jaccard similarity.

    A class of g similar texts has g * g / 2 pairs; ``classes`` names classes without listing them.
    """
    signed = _fixed(_signed(keyed, shingle))
    met = _meetings(signed.select("*", F.col("tie").alias("root"), F.col("n").alias("shared")), similarity)
    return _counted(met, _sets_of(_ends(met), keyed, shingle), similarity)


def _rooted(signed: DataFrame, roots: DataFrame) -> DataFrame:
    """The texts with their ``root``; who is not in ``roots`` is its own."""
    named = signed.join(roots.toDF("tie", "root"), "tie", "left")
    return named.withColumn("root", F.coalesce("root", "tie"))


def _with_shared(rooted: DataFrame, sets: DataFrame) -> DataFrame:
    """The texts with ``shared``: how many shingles of each stand in a text of another root, too.

    No text has more in common with one of another root, whatever the two are.
    """
    each = sets.join(rooted.select("tie", "root"), "tie").select("tie", "root", F.explode("hashes").alias("hash"))
    spread = each.groupBy("hash").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    counts = each.join(spread.select("hash"), "hash", "left_semi").groupBy("tie").agg(F.count(F.lit(1)).alias("shared"))
    return rooted.join(counts, "tie")


def classes(keyed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``tie, root`` of all texts that reach another one over pairs with the similarity."""
    signed = _fixed(_signed(keyed, shingle))
    first = _fixed(_partners(signed))
    links = _counted(first, _sets_of(_ends(first), keyed, shingle), similarity)
    roots = _fixed(components(links))
    nearest = _nearest(signed, roots, similarity, _CHECKS)
    # Who meets nobody of another class now will not later, as classes only grow.
    signed = _fixed(signed.join(nearest.select("tie"), "tie", "left_semi"))
    sets = _sets_of(nearest, keyed, shingle)
    while True:
        pairs = nearest.select(F.least("tie", "other").alias("a"), F.greatest("tie", "other").alias("b")).distinct()
        found = _counted(pairs, sets, similarity)
        roots = _fixed(components(roots.union(found)))  # the classes so far are stars already
        if found.count() * ROUND_GAIN <= nearest.count():
            break
        nearest = _nearest(signed, roots, similarity, _SIGNS)
    # All other pairs, less those that by the shingles they share with anyone cannot be similar.
    rest = _with_shared(_rooted(signed.join(nearest.select("tie"), "tie", "left_semi"), roots), sets)
    met = _meetings(_fixed(rest.where(F.col("shared") >= similarity * F.col("n") - 1e-6)), similarity)
    return _fixed(components(roots.union(_counted(met, sets, similarity))).toDF("tie", "root"))


def deduplicated(docs: DataFrame, shingle: int | None = None, similarity: float | None = None) -> DataFrame:
    """All columns of one document of each group: that with the smallest id (null last).

    Texts link by their fingerprints, or, if ``shingle`` and ``similarity`` are given, by the
    Jaccard similarity of their sets of shingles of so many words. Rows are told apart by id and a
    hash of the text; of equal rows one stays.
    """
    keyed = docs.select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"), "text", F.struct("*").alias("row")
    )
    if similarity is None:
        marked, roots = near_duplicates(keyed.select("id", "tie", "text"), ["id", "tie"])
    else:
        marked = keyed.select("id", "tie", F.col("tie").alias("fp"))
        roots = classes(keyed, shingle, similarity).toDF("fp", "root")
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "tie")
    best = marked.groupBy("fp").agg(F.min(place).alias("best"))
    kept = (
        best.join(roots, "fp", "left")
        .groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min("best").alias("best"))
        .select(F.col("best.id").alias("kept_id"), F.col("best.tie").alias("kept_tie"))
        .distinct()
    )
    chosen = keyed.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("tie") == F.col("kept_tie")), "left_semi")
    return chosen.groupBy("id", "tie").agg(F.first("row").alias("row")).select("row.*")
