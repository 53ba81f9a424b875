"""SimHash fingerprints and their linking by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  The binary Golay
code [23, 12] is perfect: every word lies within 3 of exactly one codeword, and the
codewords within 4 of it are that one or, where the distance is 3, six.  Two words
that differ in at most one bit therefore share a codeword: the nearest of the one
is among those within 4 of the other.

If fingerprints differ in at most 3 bits, then by the pigeonhole principle either
some segment is equal and another differs in at most one bit, or every segment
differs in exactly one.  The keys of the first case hold a whole segment and a
codeword of another, those of the second a codeword of each, so every key has 30
bits or more and no link within 3 bits is missed.  Candidates are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .shared import connected_components, cut, release, stored

MAX_BITS = 3
SHINGLE = 3
SEED = 42
#: Low bit and width of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the [23, 12] Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def shingle_hashes(text: str | None) -> tuple[np.ndarray, int]:
    """Hashes of a text's runs of three words in order, and its number of words.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` cuts at exactly the blanks
    0x20 and 0x09-0x0D.  Words joined by one space are laid out so that a shingle is
    one slice.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8"), 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[min(SHINGLE, len(words)) - 1 :]
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())], "<u8"), len(words)


def majority(hashes: np.ndarray) -> int:
    """The unsigned 64-bit fingerprint of shingle hashes; none give 0."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_of(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text; null and blank texts give 0."""
    return majority(shingle_hashes(text)[0])


def fingerprints(docs: DataFrame, with_bands: bool = False) -> DataFrame:
    """``(doc_id, text_hash, fp)`` for each row of ``docs``, ``fp`` the fingerprint as a signed long.

    ``with_bands`` adds ``n``, the number of different five-word shingles, ``bands`` and ``parity``.
    """
    schema = "doc_id long, text_hash long, fp long" + ", n long, bands array<long>, parity array<long>" * with_bands
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    arrow = pa.schema(list(zip(("doc_id", "text_hash", "fp", "n", "bands", "parity"), kinds))[: 3 + 3 * with_bands])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            prints, sizes, bands, odd = [], [], [], []
            for text in batch.column(2):
                hashes, words = shingle_hashes(text.as_py())
                prints.append(majority(hashes))
                if with_bands:
                    wide = shingles.wide_hashes(hashes, words)
                    sizes.append(len(wide))
                    bands.append(shingles.band_keys(wide))
                    odd.append(shingles.parities(wide))
            made = [pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())]
            if with_bands:
                made += [pa.array(sizes, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (bands, odd))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], schema=arrow)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, schema)


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of single bits, and per syndrome the error patterns up to weight 4.

    Returns the syndrome of each of the 23 bits, the pattern of weight 3 at most for
    each of the 2048 syndromes, and six patterns each that lead to every codeword
    within 4 (the first one repeated where there is only one).
    """
    bits = []
    for k in range(23):
        value = 1 << k
        for high in range(22, 10, -1):
            if value >> high & 1:
                value ^= GENERATOR << (high - 11)
        bits.append(value)
    nearest, near = np.zeros(2048, np.int64), [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            syndrome = 0
            for p in places:
                syndrome ^= bits[p]
            near[syndrome].append(sum(1 << p for p in places))
    for s, patterns in enumerate(near):
        nearest[s] = patterns[0]
    six = np.array([(p + p[:1] * 6)[:6] for p in near], np.int64)
    return np.array(bits, np.int64), nearest, six


def codewords(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest codeword of each 23-bit word, and of the six within 4."""
    bits, nearest, six = tables
    syndrome = np.zeros(len(words), np.int64)
    for k in range(23):
        syndrome ^= np.where(words >> k & 1, bits[k], 0)
    return (words ^ nearest[syndrome]) >> 11, (words[:, None] ^ six[syndrome]) >> 11


def fuzzy_keys(prints: np.ndarray, tables: tuple) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Keys of both sides of the join: ``((row, key), (row, key))``.

    A codeword is the nearest one on the one side and any within 4 on the other.
    """
    unsigned = prints.view(np.uint64)
    parts = [(unsigned >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    decoded = [codewords(p, tables) for p in parts]
    rows = np.arange(len(prints))
    left, right = [], []
    for family, (i, j) in enumerate(permutations(range(3), 2)):
        base = (np.int64(family) << 48) | (parts[i] << 12)
        left.append((rows, base | decoded[j][0]))
        right += [(rows, base | decoded[j][1][:, k]) for k in range(6)]
    (one, ones), (two, twos), (three, threes) = decoded
    base = np.int64(6) << 48
    left += [(rows, base | one << 24 | two << 12 | threes[:, k]) for k in range(6)]
    right += [(rows, base | ones[:, a] << 24 | twos[:, b] << 12 | three) for a in range(6) for b in range(6)]
    return tuple((np.concatenate([r for r, _ in side]), np.concatenate([k for _, k in side])) for side in (left, right))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct ``fp`` values that differ in 1 to 3 bits."""
    arrow = pa.schema([("side", pa.int8()), ("key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        tables = golay_tables()
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for side, (rows, keys) in enumerate(fuzzy_keys(own, tables)):
                pairs = np.unique(np.stack([keys, own[rows]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(pairs.shape[1], side, np.int8)), pa.array(pairs[0]), pa.array(pairs[1])], schema=arrow)

    spread = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a row becomes 84, which no later step can tell beforehand
    keys = prints.select("fp").distinct().repartition(spread).mapInArrow(run, "side byte, key long, fp long")
    # Spark sizes the keys by the fingerprints that they are made of, 84 times too low, and would broadcast them.
    left = keys.where("side = 0").select("key", F.col("fp").alias("a")).hint("merge")
    right = keys.where("side = 1").select("key", F.col("fp").alias("b"))
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    close = left.join(right, "key").where((F.col("a") != F.col("b")) & (differ <= MAX_BITS))
    return close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_groups(docs: DataFrame, jaccard: float | None = shingles.JACCARD) -> DataFrame:
    """Near-duplicate groups: ``(doc_id, fp, component_id)`` for each row of ``docs``.

    Fingerprints that are equal or differ in at most 3 bits are linked, and those of
    texts whose sets of five-word shingles have a similarity of ``jaccard`` or more;
    None links by fingerprints alone.  A group is what links reach and
    ``component_id`` its smallest doc_id.  Copies share one fingerprint, so only
    distinct fingerprints are compared.  Null and blank texts have fingerprint 0 and
    are linked as any other.  Rows without a doc_id keep a row; their group is named
    by its other members, or null.  Extra columns are ignored and an empty table
    gives an empty result.
    """
    return _members(docs, jaccard).select("doc_id", "fp", "component_id")


def _members(docs: DataFrame, jaccard: float | None) -> DataFrame:
    """``(doc_id, text_hash, fp, root, component_id)`` for each row, ``root`` a number of its group."""
    prints = cut(fingerprints(docs, jaccard is not None))
    first = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(fingerprint_links(first))
    rooted = first.join(roots, first["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("root")
    )
    rooted = cut(rooted)
    if jaccard is not None:
        texts = prints.where("n > 0").select("text_hash", "fp", "n", "bands", "parity").dropDuplicates(["text_hash"])
        texts = stored(texts.join(rooted, "fp").select("text_hash", "n", "bands", "parity", "root"))
        merged = shingles.merged_roots(docs, texts, jaccard)
        rooted = rooted.join(merged, rooted["root"] == merged["node"], "left").select(
            "fp", "first_id", F.coalesce("component", "root").alias("root")
        )
        rooted = cut(rooted)
    named = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    groups = cut(rooted.join(named, "root").select("fp", "root", "component_id"))
    return prints.join(groups, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group of ``docs``, with all its columns.

    The row with the smallest doc_id stays, one without a doc_id only where no member has
    any; of rows that share it, the one with the smallest hash of its text, and of rows
    equal in both the one with the smallest hash of all columns.  Only members of a group
    replace each other: different texts that share a doc_id and are no near copies stay.
    """
    members = _members(docs, shingles.JACCARD).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash", "n")).alias("first")
    kept = cut(members.groupBy("root").agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"), F.col("first.n").alias("_n")))
    hashed = docs.withColumn("_text", F.xxhash64(F.col("text").cast("string")))
    found = hashed.join(kept, (hashed["_text"] == kept["_hash"]) & hashed["doc_id"].cast("long").eqNullSafe(kept["_id"]))
    if kept.where("_n > 1").isEmpty():
        return found.select(*docs.columns)
    row = F.struct(*docs.columns)
    again = found.where("_n > 1").groupBy("_id", "_hash").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_row"))
    return found.where("_n = 1").select(*docs.columns).unionByName(again.select("_row.*"))
