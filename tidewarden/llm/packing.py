"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt to
partitions of a bounded size; each packs its pieces best-fit decreasing and certifies
its bin count by a lower bound from dual feasible functions.  A partition without a
gap between the two can not be packed better by itself, so it keeps its bins, but for
the emptiest one; partitions with a gap give up every bin that is not full.  What was
given up is dealt anew, so that partitions exchange documents, and packed again.
Rounds go on until the bound of all pieces is met or a round saves no bin.
"""

from __future__ import annotations

import gc
import itertools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, kept

CAPACITY = 2048
#: Pieces that one packing task holds.
TASK_PIECES = 65_536
#: Words whose ids a worker keeps; beyond it a memo starts anew.
WORDS = 250_000
#: Texts that are split and looked up together.
GROUP = 1000
#: A chunk that is one word of Latin letters with marks after it, as Arrow takes it.
WORD = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[.,;:!?|*%&$#]*)$"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", bin long, offset long, waste long, task long, task_bins long, task_bound long"


class Memo:
    """Token ids of words, and of whole texts put together from them.

    No token spans a blank, so texts are cut there; each different chunk of a batch is
    looked up once.  A chunk that is a word of Latin letters with marks after it is
    two pieces for the tokenizer, which drops the word's case, so one word serves many
    chunks.  Words not met before are encoded in one call, in which each is one piece
    and the pieces' numbers tell them apart.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {"": 0}
        self.start, self.size, self.pool = array("q", [0]), array("q", [0]), array("I")

    def keep(self, text: str, ids: np.ndarray) -> None:
        self.slots[text] = len(self.start)
        self.start.append(len(self.pool))
        self.size.append(len(ids))
        self.pool.frombytes(ids.tobytes())

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            made = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            numbers, ids = np.array(made.word_ids), np.array(made.ids, np.uint32)
            if numbers[-1] + 1 != len(part):
                raise ValueError("the tokenizer does not take a word of letters as one piece")
            ends = np.searchsorted(numbers, np.arange(len(part) + 1))
            self.slots.update(zip(part, range(len(self.start), len(self.start) + len(part))))
            self.start.frombytes((ends[:-1] + len(self.pool)).astype(np.int64).tobytes())
            self.size.frombytes(np.diff(ends).astype(np.int64).tobytes())
            self.pool.frombytes(ids.tobytes())

    def places(self, texts: pa.Array, as_words: bool) -> np.ndarray:
        """The slots of each of ``texts``; null has that of the empty text."""
        coded = texts.dictionary_encode()
        different = coded.dictionary.to_pylist()
        new = [t for t in different if t not in self.slots]
        if as_words and new:
            self.learn(new)
        else:
            for t in new:
                self.keep(t, self.encode(t))
        slots = np.array([*map(self.slots.__getitem__, different), 0], np.int64)
        return slots[coded.indices.fill_null(len(different)).to_numpy(zero_copy_only=False)]

    def ids(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of an array; null texts have none."""
        for at in range(0, len(column), GROUP):
            lists = pc.ascii_split_whitespace(column.slice(at, GROUP).fill_null(""))
            coded = pc.list_flatten(lists).dictionary_encode()
            parts = pc.extract_regex(coded.dictionary, WORD)
            if len(self.slots) > WORDS:
                self.forget()
            other = pc.if_else(parts.is_null(), coded.dictionary, pa.scalar(None, pa.string()))
            word = self.places(pc.utf8_lower(pc.struct_field(parts, "word")), True) + self.places(other, False)
            mark = self.places(pc.struct_field(parts, "mark"), False)
            codes = coded.indices.to_numpy(zero_copy_only=False)
            slots = np.stack([word[codes], mark[codes]], axis=1).ravel()
            size = np.frombuffer(self.size, np.int64)[slots]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            where = np.repeat(np.frombuffer(self.start, np.int64)[slots] - ends + size, size) + np.arange(total)
            tokens = np.frombuffer(self.pool, np.uint32)[where] if total else np.empty(0, np.uint32)
            upto = np.concatenate([[0], ends])[2 * np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])]
            for a, b in itertools.pairwise(upto.tolist()):
                yield tokens[a:b]


def memo_of(tokenizer_path: str) -> Memo:
    """The memo of a Python worker, which goes on from task to task until another operator's tasks run there."""
    from tokenizers import Tokenizer

    return kept(("tokenizer", tokenizer_path), lambda: Memo(Tokenizer.from_file(tokenizer_path)))


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece of each document's token ids.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  A document's
    ids are those of the tokenizer without special tokens, followed by id 0; a null
    text counts as empty and gives the one id 0.  Only longer documents are cut, at
    each ``capacity`` ids.  ``keep_ids`` adds the ids themselves as ``ids``.
    """
    schema = PIECES + (", ids array<long>" if keep_ids else "")
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    arrow = pa.schema(list(zip(names, types))[: 5 + keep_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the memo makes no cycles, and passes over it cost a third of the time
        try:
            yield from made(batches)
        finally:
            gc.enable()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = memo_of(tokenizer_path)
        size = 4 * capacity
        for batch in batches:
            rows = [[] for _ in arrow.names]
            for doc_id, own in zip(batch.column(0).to_pylist(), memo.ids(batch.column(1))):
                ids = own.astype("<u4", copy=False).tobytes() + bytes(4)
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    values = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))
                    for column, value in zip(rows, values):
                        column.append(value)
                    if keep_ids:
                        rows[5].append(np.frombuffer(part, "<u4").astype(np.int64))
                if len(rows[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], schema=arrow)
                    rows = [[] for _ in arrow.names]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins.

    Bins are kept by the room left in them; the bits of ``rooms`` tell which rooms
    occur, so the tightest bin that fits is the lowest bit from the length on.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen, n = capacity, n, n + 1
        bins[i], offsets[i] = chosen, capacity - room
        left = room - size
        if left:
            by_room[left].append(chosen)
            rooms |= 1 << left
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound that a family of dual feasible functions gives for these lengths."""
    return bound_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of(count: np.ndarray, capacity: int) -> int:
    """The same for ``count`` pieces of each length from 0 to ``capacity``.

    For a threshold k, lengths above capacity - k count as a whole bin, lengths
    below k as nothing and the others as they are; k = 0 is the bound by volume.
    A second family rounds each length down to parts of capacity / k.
    """
    count = count.astype(np.int64)
    n_to, sum_to = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    k = np.arange(0, capacity // 2 + 1)
    whole = n_to[capacity] - n_to[capacity - k]
    under = np.where(k > 0, sum_to[np.maximum(k - 1, 0)], 0)
    first = whole + -(-(sum_to[capacity - k] - under) // capacity)
    best = int(first.max())
    x = np.arange(capacity + 1)
    for parts in range(1, 32):
        scaled = (parts + 1) * x
        rounded = np.where(scaled % capacity == 0, x * parts, scaled // capacity * capacity)
        best = max(best, int(-(-(count * rounded).sum() // (parts * capacity))))
    return best


def _pack_tasks(pool: DataFrame, capacity: int, tasks: int, salt: int) -> DataFrame:
    """Pack each partition of ``pool`` alone; bins are numbered apart by partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held = [f for f in frames if len(f)]
        if not held:
            return
        own = pd.concat(held, ignore_index=True).sort_values(["doc_id", "piece"], ignore_index=True)
        lengths = own["length"].to_numpy(np.int64)
        bins, own["offset"], n = best_fit_decreasing(lengths, capacity)
        filled = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        own["waste"] = capacity - filled[bins]
        own["bin"] = (np.int64(salt) << 56) + (np.int64(task) << 32) + bins
        own["task"], own["task_bins"], own["task_bound"] = task, n, lower_bound(lengths, capacity)
        yield own[[c.split()[0] for c in PLACED.split(", ")]]

    key = F.xxhash64("doc_id", "piece", F.lit(salt))
    return pool.repartition(tasks, key).mapInPandas(run, PLACED)


def whole_bound(pieces: DataFrame, capacity: int = CAPACITY) -> int:
    """The lower bound of all pieces together; the driver gets one count per length."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # as many rows as there are lengths, 2048 here
        count[length] = n
    return bound_of(count, capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Place pieces into as few sequences of ``capacity`` as it can.

    Returns the columns of ``pieces`` with ``sequence_id``, ``offset`` (gapless from
    0), and the certificate of the task that placed the piece: ``task_bins`` bins
    used and ``task_bound``, below which no packing of that task's pieces can go.
    Pieces as long as a sequence fill one each.  Which bins a round packs again, in
    tasks of ``task_pieces``, is told at the top; a round counts only if it saves bins,
    and saves at least one, so there are no more rounds than bins above the bound.
    Empty input gives an empty result.
    """
    columns = [c.split()[0] for c in PIECES.split(", ")]
    full = (
        pieces.where(F.col("length") >= capacity)
        .select(*columns)
        .withColumns({"bin": F.monotonically_increasing_id() + F.lit(1 << 61), "offset": F.lit(0).cast("long")})
        .withColumns({"waste": F.lit(0).cast("long"), "task": F.lit(-1).cast("long")})
        .withColumns({"task_bins": F.lit(1).cast("long"), "task_bound": F.lit(1).cast("long")})
    )
    pool = pieces.where(F.col("length") < capacity).select(*columns)
    least, kept, used, salt = whole_bound(pool, capacity), 0, None, 0
    out, packed = full, None
    while True:
        tasks = max(1, -(-pool.count() // task_pieces))
        again = cut(_pack_tasks(pool, capacity, tasks, salt))
        bins = again.where("offset = 0").count()
        if used is not None and kept + bins >= used:
            return _told(out.unionByName(packed), columns)
        used = kept + bins
        if used <= least or tasks == 1:
            return _told(out.unionByName(again), columns)
        loose = F.max(F.when(F.col("offset") == 0, F.struct("waste", "bin"))).alias("loose")
        by_task = cut(again.groupBy("task").agg(loose, (F.max("task_bins") > F.max("task_bound")).alias("gap")).select("task", F.col("loose.bin").alias("loose"), "gap"))
        marked = again.join(by_task, "task")
        given = (F.col("waste") > 0) & (F.col("gap") | (F.col("bin") == F.col("loose")))
        stays = marked.where(~given).select(*again.columns)
        kept += stays.where("offset = 0").count()
        out, packed, pool, salt = out.unionByName(stays), marked.where(given).select(*again.columns), marked.where(given).select(*columns), salt + 1


def _told(placed: DataFrame, columns: list[str]) -> DataFrame:
    return placed.select(*columns, F.col("bin").alias("sequence_id"), "offset", "task_bins", "task_bound")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize and pack ``docs``; see :func:`tokenize` and :func:`pack`."""
    return pack(cut(tokenize(docs, tokenizer_path, capacity)), capacity)
