"""Suffix-array deduplication of byte strings by longest previous factors.

A passage counts as repeated where a string of ``length`` bytes starts at more than
one place of the corpus.  Places that can be equal are brought together first: the
least hash among the 64-byte strings inside a window of ``length`` bytes is the same
wherever the window's bytes are the same.  Runs of windows with one such anchor form
a segment, and only segments whose anchor hash occurs again are looked at.

If all segments of an anchor hash are equal, all their windows repeat.  Else their
texts are sorted as suffixes, to a depth of ``length`` bytes with ties by place.  The
previous and next smaller positions of a window in that order are the earlier places
most like it, so the longer of the common prefixes with them is its longest previous
factor, and one of ``length`` says that the window is a later copy.  Greater positions
give the longest later factor in the same way.

A bucket with more different segments than a task should sort is split on further
bytes, as a radix sort of suffixes would do: first on those that all windows at about
one distance from the anchor share, at last on all bytes of a window.  The strings of
such a part are all equal, so their order is that of their places, the least place
has no earlier match and every other one a previous factor of ``length``.  Parts are
told by 64-bit hashes; two of one anchor would have to agree in the hash of other bytes
as well to be taken for equal, so what counts is the number of different strings of
one anchor, not that of the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, new_path

LENGTH = 200
GRAM = 64
#: Different segments of one anchor hash up to which a task sorts their suffixes.
BUCKET = 256
#: Distances from the anchor that a stretch of windows spans.
STRETCH = 9
#: Bytes of text that a task sorts at once, but for one anchor hash.
SORT_BYTES = 1 << 20
#: Window starts of a text that are hashed at once.
BLOCK = 1 << 18
#: The multiplier of the polynomial hash, its inverse modulo 2^64, and those that mix.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)

SEGMENTS = "anchor long, content long, k long, doc_id long, start long, n int"


class Hasher:
    """Polynomial hashes of substrings of one block by prefix sums."""

    def __init__(self, size: int):
        ones = np.full(size, BASE, np.uint64)
        ones[0] = 1
        self.powers = np.cumprod(ones)
        ones = np.full(size, INVERSE, np.uint64)
        ones[0] = 1
        self.inverses = np.cumprod(ones)
        self.bytes = np.random.default_rng(17).integers(1, 1 << 63, 256, np.uint64)

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.bytes[raw] * self.powers[: len(raw)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (prefix[end] - prefix[start]) * self.inverses[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIX)
        return h ^ (h >> np.uint64(29))

    def rolling(self, prefix: np.ndarray, size: int) -> np.ndarray:
        h = (prefix[size:] - prefix[:-size]) * self.inverses[: len(prefix) - size]
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIX)
        return h ^ (h >> np.uint64(29))


def segments_of(raw: np.ndarray, hasher: Hasher, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of one text, by block: anchor hash, content hash, start, number of windows."""
    span = length - GRAM + 1
    low = np.uint64((1 << 20) - 1)
    for at in range(0, max(0, len(raw) - length + 1), BLOCK):
        part = raw[at : at + BLOCK + length - 1]
        prefix = hasher.prefix(part)
        grams = hasher.rolling(prefix, GRAM)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        cuts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        n = np.diff(np.append(cuts, len(least)))
        anchors = grams[(least[cuts] & low).astype(np.int64)]
        content = hasher.of(prefix, cuts, cuts + n + length - 1)
        yield anchors.view(np.int64), content.view(np.int64), cuts + at, n


def find_segments(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """Segments of each text of ``keyed``, which has ``k``, ``doc_id`` and ``text``."""
    names = [c.split()[0] for c in SEGMENTS.split(", ")]
    arrow = pa.schema([(n, pa.int32() if n == "n" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(BLOCK + length + 1)
        for batch in batches:
            held, size = [], 0

            def made() -> pa.RecordBatch:
                columns = [np.concatenate(c) for c in zip(*(h[:5] for h in held))]
                ids = pa.array([h[6] for h in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), [len(h[0]) for h in held])))
                anchor, content, k, start, n = columns
                return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content), pa.array(k), ids, pa.array(start), pa.array(n.astype(np.int32))], schema=arrow)

            for k, doc_id, text in zip(*(batch.column(c) for c in range(3))):
                raw = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                for anchor, content, start, n in segments_of(raw, hasher, length):
                    held.append((anchor, content, np.full(len(n), k.as_py(), np.int64), start, n, None, doc_id.as_py()))
                    size += len(n)
                if size > 200_000:
                    yield made()
                    held, size = [], 0
            if held:
                yield made()

    return keyed.select("k", "doc_id", "text").mapInArrow(run, SEGMENTS)


def suffix_ranks(raw: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all positions by their first 8, 16, ... and ``length`` bytes, by prefix doubling."""
    padded = np.concatenate([raw, np.zeros(length, np.uint8)]).astype(np.uint64)
    key = np.zeros(len(raw), np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + len(raw)]
    rank, reach = _dense(key), 8
    levels = [(reach, rank)]
    while reach < length:
        step = min(reach, length - reach)
        other = np.zeros(len(raw), np.int64)
        other[: len(raw) - step] = rank[step:] + 1
        rank, reach = _dense(rank * (len(raw) + 2) + other), reach + step
        levels.append((reach, rank))
    return levels


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
    return rank


def common_prefixes(raw: np.ndarray, levels: list[tuple[int, np.ndarray]], one: np.ndarray, two: np.ndarray, length: int, least: int = 0) -> np.ndarray:
    """Lengths of the common prefixes of pairs of positions, ``length`` at most; shorter ones than ``least`` are 0."""
    whole = levels[-1][1][one] == levels[-1][1][two]
    out = np.where(whole, length, 0)
    if least >= length:
        return out
    rest, last = np.flatnonzero(~whole), len(raw) - 1
    for reach, rank in [*reversed(levels[:-1]), *[(1, raw)] * 7]:
        a, b, n = one[rest], two[rest], out[rest]
        # a step of one byte counts only while all before it were equal
        same = (rank[np.minimum(a + n, last)] == rank[np.minimum(b + n, last)]) & (np.maximum(a, b) + n <= last)
        out[rest[same]] += reach
        if reach == 1:
            rest = rest[same]
    return np.where(out < least, 0, np.minimum(out, length))


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each index the nearest one before it with a smaller value, or -1, by jumping along such links."""
    before = np.arange(-1, len(values) - 1)
    todo = np.arange(1, len(values))
    while len(todo):
        todo = todo[before[todo] >= 0]
        todo = todo[values[before[todo]] > values[todo]]
        before[todo] = before[before[todo]]
    return before


def longest_factors(raw: np.ndarray, levels: list[tuple[int, np.ndarray]], starts: np.ndarray, length: int, least: int = 0) -> np.ndarray:
    """The longest previous factor of each of ``starts``, which are in the order of places: 0 to ``length``.

    Factors shorter than ``least`` count as 0.
    """
    order = np.lexsort((np.arange(len(starts)), levels[-1][1][starts]))
    best = np.zeros(len(starts), np.int64)
    for way in (1, -1):
        line = order[::way]
        near = smaller_before(line)
        has = np.flatnonzero(near >= 0)
        here = line[has]
        best[here] = np.maximum(best[here], common_prefixes(raw, levels, starts[here], starts[line[near[has]]], length, least))
    return best


def factor_masks(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each window has a previous factor of ``length``, and whether it has a later one."""
    levels = suffix_ranks(raw, length)
    earlier = longest_factors(raw, levels, starts, length, length) > 0
    later = longest_factors(raw, levels, starts[::-1], length, length)[::-1] > 0
    return earlier, later


def runs(mask: np.ndarray) -> list[list[int]]:
    """First and end of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges.reshape(-1, 2).tolist()


MASKS = "anchor long, content long, later array<array<int>>, either array<array<int>>"


def sort_buckets(bodies: DataFrame, length: int = LENGTH) -> DataFrame:
    """Which windows of each segment have an earlier or any equal window in its bucket.

    Each task sorts the suffixes of the segments of many anchor hashes at once.
    """
    names = [c.split()[0] for c in MASKS.split(", ")]

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["body"].str.len().to_numpy()
        raw = np.frombuffer(b"".join(rows["body"]), np.uint8)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        n = rows["n"].to_numpy()
        starts = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        earlier, later = factor_masks(raw, starts, length)
        ends = np.cumsum(n)
        out = [(a, c, runs(earlier[e - k : e]), runs((earlier | later)[e - k : e])) for a, c, k, e in zip(rows["anchor"], rows["content"], n, ends)]
        return pd.DataFrame([x for x in out if x[3]], columns=names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for f in frames:
            held.append(f)
            size += f["body"].str.len().sum()
            if size > SORT_BYTES:
                rows = pd.concat(held, ignore_index=True)
                last = rows["anchor"] == rows["anchor"].iloc[-1]  # its bucket may go on
                whole = rows[~last].reset_index(drop=True)
                starts = whole["anchor"].ne(whole["anchor"].shift()).to_numpy().nonzero()[0]
                filled = np.concatenate(([0], whole["body"].str.len().cumsum().to_numpy()))[starts] // SORT_BYTES if len(whole) else []
                for part in np.unique(filled):
                    chosen = starts[filled == part]
                    after = starts[starts > chosen[-1]]
                    yield solve(whole.iloc[chosen[0] : after[0] if len(after) else len(whole)].reset_index(drop=True))
                held, size = [rows[last]], rows[last]["body"].str.len().sum()
        if held and len(rows := pd.concat(held, ignore_index=True)):
            yield solve(rows)

    ordered = bodies.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "k", "start")
    return ordered.select("anchor", "content", "n", "body").mapInPandas(run, MASKS)


STRETCHES = "anchor long, content long, doc_id long, k long, start long, stretch int, lo int, hi int, core long, hull long"


def window_stretches(bodies: DataFrame, length: int = LENGTH) -> DataFrame:
    """Each segment's windows ``lo`` to ``hi`` by their distance from the anchor, ``STRETCH`` distances to a row.

    ``core`` hashes the bytes that all windows of such distances hold, so windows can
    only be equal where cores are; ``hull`` hashes the bytes that the row's windows
    cover, so where hulls are equal all windows are.
    """
    names = [c.split()[0] for c in STRETCHES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(4 * length)
        for f in frames:
            parts = []
            for row, body, n, anchor in zip(f[names[:5]].to_numpy(dtype=object), f["body"], f["n"], f["anchor"]):
                prefix = hasher.prefix(np.frombuffer(body, np.uint8))
                at = int(np.flatnonzero(hasher.rolling(prefix, GRAM).view(np.int64) == anchor)[0])
                c = np.arange((at - n + 1) // STRETCH, at // STRETCH + 1)
                lo, hi = at - np.minimum(c * STRETCH + STRETCH - 1, at), at - np.maximum(c * STRETCH, at - n + 1) + 1
                core = hasher.of(prefix, at - c * STRETCH, at - c * STRETCH - STRETCH + 1 + length)
                hull = hasher.of(prefix, lo, hi - 1 + length)
                parts += [(*row, *x) for x in zip(c.tolist(), lo.tolist(), hi.tolist(), core.view(np.int64).tolist(), hull.view(np.int64).tolist())]
            yield pd.DataFrame(parts, columns=names).astype({"doc_id": "Int64"})

    return bodies.select(*names[:5], "n", "body").mapInPandas(run, STRETCHES)


def count_windows(bodies: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same as :func:`sort_buckets` for anchor hashes with any number of segments.

    No segments are brought together: hashes are counted, with the first place of
    each, and joined back.  Stretches of windows with unequal cores drop out, those
    with equal hulls repeat as a whole and only the first of them goes on, and of the
    rest every window is a row.
    """
    place = F.struct("doc_id", "k", "start", "lo")
    rows = stored(window_stretches(bodies, length).withColumn("place", place))
    met = cut(rows.groupBy("anchor", "stretch", "core").agg(F.count("*").alias("met")).where("met > 1"))
    aligned = rows.withColumn("span", F.col("hi") - F.col("lo"))
    hulls = cut(aligned.groupBy("anchor", "stretch", "span", "hull").agg(F.count("*").alias("same"), F.min("place").alias("first")).where("same > 1"))
    known = aligned.join(met, ["anchor", "stretch", "core"]).join(hulls, ["anchor", "stretch", "span", "hull"], "left")
    known = stored(known.select("anchor", "content", "lo", "hi", "same", (F.col("place") != F.col("first")).alias("after")))

    whole = known.where("same is not null").select("anchor", "content", F.array("lo", "hi").alias("range"), F.col("after").alias("late"))
    open_ = known.where("same is null or not after").groupBy("anchor", "content").agg(F.collect_list(F.struct("lo", "hi")).alias("open"))
    schema = "anchor long, content long, doc_id long, k long, start long, at int, window long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(4 * length)
        for f in frames:
            index, places, hashes = [], [], []
            for i, (body, listed) in enumerate(zip(f["body"], f["open"])):
                hashed = hasher.rolling(hasher.prefix(np.frombuffer(body, np.uint8)), length).view(np.int64)
                at = np.concatenate([np.arange(r["lo"], r["hi"]) for r in listed])
                index.append(np.full(len(at), i))
                places.append(at)
                hashes.append(hashed[at])
            if index:
                out = f[["anchor", "content", "doc_id", "k", "start"]].iloc[np.concatenate(index)]
                yield out.assign(at=np.concatenate(places).astype(np.int32), window=np.concatenate(hashes))

    chosen = bodies.select("anchor", "content", "doc_id", "k", "start", "body").join(open_, ["anchor", "content"])
    windows = chosen.select("anchor", "content", "doc_id", "k", "start", "body", "open").mapInPandas(run, schema)
    windows = stored(windows.withColumn("place", F.struct("doc_id", "k", "start", "at")).drop("doc_id", "k", "start"))
    counted = cut(windows.groupBy("anchor", "window").agg(F.count("*").alias("rows"), F.min("place").alias("first")).where("rows > 1"))
    hit = windows.join(counted, ["anchor", "window"])
    single = hit.select("anchor", "content", F.array("at", F.col("at") + 1).alias("range"), (F.col("place") != F.col("first")).alias("late"))
    lists = whole.unionByName(single).groupBy("anchor", "content").agg(
        F.array_sort(F.collect_list(F.when(F.col("late"), F.col("range")))).alias("later"), F.array_sort(F.collect_list("range")).alias("either")
    )
    return lists.select("anchor", "content", merged("later").alias("later"), merged("either").alias("either"))


def merged(ranges: str) -> Column:
    """Sorted ranges with those that meet or overlap made one."""

    def step(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], r[1]))))
        return F.when((F.size(done) > 0) & (r[0] <= last[1]), joined).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(ranges, F.array().cast("array<array<int>>"), step)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again."""
    path = new_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``(k, doc_id, text)``: rows with one doc_id and text share ``k``; null texts are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text")).select(F.xxhash64("doc_id", "text").alias("k"), "doc_id", "text")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, bucket: int = BUCKET) -> DataFrame:
    """``(k, doc_id, ranges)``: byte ranges to remove, for texts that have any.

    Without ``keep_first`` every byte is removed that a string of ``length`` bytes
    covers which starts anywhere else.  With it the first place of each such string,
    by doc_id and position, keeps its bytes unless another string takes them.  Ranges
    may overlap.  Rows that repeat a doc_id and text share their ranges.
    """
    keyed = keyed_texts(docs)
    segments = stored(find_segments(keyed, length))
    per_anchor = segments.groupBy("anchor").agg(F.count("*").alias("rows"), F.min("content").alias("a"), F.max("content").alias("b"))
    per_anchor = cut(per_anchor.where("rows > 1").select("anchor", "rows", (F.col("a") != F.col("b")).alias("mixed")))
    shared = stored(segments.join(per_anchor, "anchor"))

    place = F.struct("doc_id", "k", "start")
    classes = shared.groupBy("anchor", "content", "n", "mixed").agg(F.count("*").alias("copies"), F.min(place).alias("first"))
    if keep_first:
        classes = cut(classes)
    else:  # the first place matters only for texts that are sorted
        classes = cut(classes.where("mixed"))
    mixed = classes.where("mixed").select("anchor", "content", "n", "first.*")
    hot = cut(mixed.groupBy("anchor").agg(F.count("*").alias("rows")).where(F.col("rows") > bucket))
    wanted = mixed.join(hot, "anchor", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    by_text = wanted.groupBy("k", "doc_id").agg(F.collect_list(F.struct("anchor", "content", "n", "rows", "start")).alias("wanted"))
    joined = keyed.join(by_text.withColumnRenamed("doc_id", "id"), "k").where(F.col("doc_id").eqNullSafe(F.col("id")))
    body_schema = "anchor long, content long, rows long, doc_id long, k long, start long, n int, body binary"

    def cut_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in body_schema.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.int32(), pa.binary()]
        for batch in batches:
            out: list[tuple] = []
            for k, doc_id, text, listed in zip(*(batch.column(c) for c in range(4))):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                k, doc_id = k.as_py(), doc_id.as_py()
                for w in listed.as_py():
                    out.append((w["anchor"], w["content"], w["rows"], doc_id, k, w["start"], w["n"], raw[w["start"] : w["start"] + w["n"] + length - 1]))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    made = joined.select("k", "doc_id", "text", "wanted").mapInArrow(cut_bodies, body_schema)
    bodies = stored(made.dropDuplicates(["anchor", "content"]))  # rows may repeat a text
    masks = sort_buckets(bodies.where("rows = 0"), length).unionByName(count_windows(bodies.where("rows > 0"), length))
    masks = cut(masks)

    end = F.col("start") + F.col("n") + F.lit(length - 1)
    column = "later" if keep_first else "either"
    many = classes.where("copies > 1").select("anchor", "content", *(["first"] if keep_first else []))
    if keep_first:
        whole = shared.join(many, ["anchor", "content"]).where(place != F.col("first"))
    else:
        whole = shared.where("not mixed").unionByName(shared.where("mixed").join(many, ["anchor", "content"], "left_semi"))
    whole = whole.select("k", "doc_id", F.array(F.struct(F.col("start").alias("a"), end.alias("b"))).alias("own"))
    moved = F.transform(column, lambda r: F.struct((F.col("start") + r[0]).alias("a"), (F.col("start") + r[1] + F.lit(length - 1)).alias("b")))
    part = shared.where("mixed").join(masks, ["anchor", "content"]).select("k", "doc_id", moved.alias("own"))
    return whole.unionByName(part).groupBy("k", "doc_id").agg(F.flatten(F.collect_set("own")).alias("ranges"))  # rows that repeat a text bring the same ranges


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, keep_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for each row of ``docs``.

    Texts are UTF-8 bytes, null texts none; matches never cross documents.  Spans are
    maximal removed runs.  ``keep_text`` adds the remaining bytes as ``kept``.  See
    :func:`repeated_ranges` for what is removed.
    """
    ranges = repeated_ranges(docs, length, keep_first).withColumnRenamed("doc_id", "id")
    keyed = keyed_texts(docs)
    same = (keyed["k"] == ranges["k"]) & keyed["doc_id"].eqNullSafe(ranges["id"])
    schema = REMOVED + (", kept binary" if keep_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        for batch in batches:
            out = []
            for doc_id, text, listed in zip(*(batch.column(c) for c in range(3))):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for a, b in sorted((r["a"], r["b"]) for r in listed.as_py() or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                ends = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))
                row = (doc_id.as_py(), len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept)
                out.append(row[: len(names)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return keyed.join(ranges, same, "left").select(keyed["doc_id"], "text", "ranges").mapInArrow(run, schema)
