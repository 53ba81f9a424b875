"""Alignment of two tokenizers' tokens, with corpus-wide counts from inverted pair bitmaps.

Both tokenizers cut a text's bytes, so places where tokens of both end cut it into
groups, and a pair of tokens is linked where their bytes overlap.  A task indexes its
documents in blocks: for each pair of ids a compressed bitmap of the block's documents
that hold it, and bit planes of how many further links each of them has.  Blocks hold
different documents, so the bitmaps of a pair are merged by putting them side by side
and counted by adding their bits.  The counts go back to the bitmaps, and each block
hands them on to its documents, so no list of pairs by document is ever shuffled.

Documents and bitmaps are written once, by one write, before they are read: the numbers
of documents within a block are those of that write whatever task is tried again later.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept, new_path

#: Characters of text and documents that a block holds, about; a longer text is a block of its own.
BLOCK_CHARS, BLOCK_DOCS = 8 << 20, 1 << 15
#: White space that ends before a blank: such texts are not cut into chunks.
UNEVEN = re.compile(r"\s ")
#: Longer runs of white space are left to the slower of two equal encoders.
LONG_BLANKS = re.compile(r"\s{1000}")
SHIFT = 20  # of the first id in a pair's key; ids are smaller than 2**20


class Encoder:
    """Token ids of a text, and the bytes of each id."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.pool = np.frombuffer(b"".join(pieces), np.uint8)

    def ids(self, text: str) -> np.ndarray:
        """The ids of ``text`` after one blank."""
        raise NotImplementedError

    def spells(self, ids: np.ndarray, raw: bytes) -> bool:
        """Whether the bytes of ``ids`` are those of ``raw``."""
        size = self.sizes[ids]
        ends = np.cumsum(size)
        if not len(ids) or ends[-1] != len(raw):
            return False
        where = np.repeat(self.starts[ids] - ends + size, size) + np.arange(len(raw))
        return bool((self.pool[where] == np.frombuffer(raw, np.uint8)).all())


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel(Encoder):
    """A byte-level BPE file; ids in the order of merges let a faster library read them as ranks."""

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        described = json.loads(Path(path).read_text(encoding="utf-8"))
        letters, vocab = byte_letters(), described["model"]["vocab"]
        spelled = {i: bytes(letters[c] for c in piece) for piece, i in vocab.items()}
        pieces = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        super().__init__(pieces)
        self.ranked = None
        plain = described["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        merges = [m if isinstance(m, list) else m.split(" ") for m in described["model"]["merges"]]
        if plain and described["normalizer"] is None and [vocab.get(a + b) for a, b in merges] == [*range(256, 256 + len(merges))]:
            import tiktoken

            self.ranked = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.ranked is not None and not LONG_BLANKS.search(text):
            return np.array(self.ranked.encode_ordinary(" " + text), np.int64)
        return np.array(self.tokenizer.encode(" " + text, add_special_tokens=False).ids, np.int64)


class Pieces(Encoder):
    """A sentencepiece model, which puts the blank before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        self.blank = self.model.piece_to_id("▁")
        #: Whether no piece goes over from a text to a blank, so that texts can be cut there.
        self.stops_at_blanks = not any(re.search("[^▁]▁", p) for p in names)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1) if text else [self.blank], np.int64)


def encoders(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    """The two encoders of a Python worker."""
    return kept(("aligners", path_a, path_b), lambda: (ByteLevel(path_a), Pieces(path_b)))


class Chunks:
    """Distinct texts with the ids of both tokenizers, cut into groups and links.

    The first ``joinable`` texts are joined for encoding, and the ids cut apart again
    where the bytes of a text end; where that gives other bytes than the texts have, and
    behind ``joinable``, each is encoded alone.
    """

    def __init__(self, texts: list[str], joinable: int, a: Encoder, b: Encoder):
        raw = [b" " + t.encode() for t in texts]
        self.sound = np.ones(len(texts), bool)
        joined = " ".join(texts[:joinable])
        parts = [(a.ids(joined), b.ids(joined))] if joinable else []
        whole = b"".join(raw[:joinable])
        if joinable and not (a.spells(parts[0][0], whole) and b.spells(parts[0][1], whole)):
            parts, joinable = [], 0
        for k in range(joinable, len(texts)):
            own_a, own_b = a.ids(texts[k]), b.ids(texts[k])
            if a.spells(own_a, raw[k]) and b.spells(own_b, raw[k]):
                parts.append((own_a, own_b))
            else:
                self.sound[k], raw[k] = False, b""
        ids_a, ids_b = (np.concatenate([np.empty(0, np.int64), *side]) for side in (zip(*parts) if parts else ((), ())))
        stops = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        ends_a, ends_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        cuts = np.union1d(ends_a, ends_b)
        if not np.isin(stops[1:], np.concatenate([[0], both])).all():
            raise ValueError("a token goes over from one text to the next")
        link_a, link_b = ids_a[np.searchsorted(ends_a, cuts)], ids_b[np.searchsorted(ends_b, cuts)]
        self.pairs = link_a << SHIFT | link_b
        self.at_link = np.searchsorted(cuts, stops, side="right")
        self.n_a, self.n_b = (np.diff(np.searchsorted(e, stops, side="right")) for e in (ends_a, ends_b))
        self.n_groups = np.diff(np.searchsorted(both, stops, side="right"))
        self.n_links = np.diff(self.at_link)
        self.told = self._told(ids_a, ids_b, ends_a, ends_b, both, stops)

    @staticmethod
    def _told(ids_a, ids_b, ends_a, ends_b, both, stops) -> list[str]:
        """Each text's groups, a ';' behind each."""
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)  # behind the ids of earlier groups
        place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")
        out = np.empty(len(ids_a) + len(ids_b), object)
        last_a, last_b = np.isin(ends_a, both, assume_unique=True), np.isin(ends_b, both, assume_unique=True)
        out[place_a] = [f"{i}|" if last else f"{i}," for i, last in zip(ids_a.tolist(), last_a.tolist())]
        out[place_b] = [f"{i};" if last else f"{i}," for i, last in zip(ids_b.tolist(), last_b.tolist())]
        parts = out.tolist()
        at = (np.searchsorted(ends_a, stops, side="right") + np.searchsorted(ends_b, stops, side="right")).tolist()
        return ["".join(parts[x:y]) for x, y in zip(at, at[1:])]


def chunked(texts: list[str], b: Pieces) -> tuple[list[str], int, np.ndarray, np.ndarray]:
    """Distinct chunks, how many of them can be joined, the chunks of all texts in order, and where each text's end.

    A text is cut at blanks behind other characters than white space, where tokens of
    both vocabularies end; one that has white space before a blank is one chunk.  Chunks
    that end in white space, or have it before a blank, come last and are not joined.
    """
    if b.stops_at_blanks:
        lists = [t.split(" ") if t and not UNEVEN.search(" " + t) else [t] if t else [] for t in texts]
    else:
        lists = [[t] if t else [] for t in texts]
    ends = np.cumsum([len(x) for x in lists]).astype(np.int64)
    coded = pa.array([c for x in lists for c in x], pa.string()).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    alone = np.array([not (b.stops_at_blanks and t) or t[-1].isspace() or bool(UNEVEN.search(" " + t)) for t in distinct], bool)
    order = np.argsort(alone, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return [distinct[k] for k in order], int((~alone).sum()), place[coded.indices.to_numpy(zero_copy_only=False)], ends


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of several runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


INDEX = """doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,
  block long, doc int, a int, b int, plane int, n int, dense boolean, bitmap binary"""
_INDEX = pa.schema([
    *[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("block", pa.int64()), ("doc", pa.int32()),
    *[(c, pa.int32()) for c in ("a", "b", "plane", "n")], ("dense", pa.bool_()), ("bitmap", pa.binary()),
])
#: The plane of the bitmap of documents; others hold bits of their further links.
PRESENT = -1


def bitmaps(keys: np.ndarray, docs: np.ndarray, size: int, block: int, plane: int) -> Iterator[pa.RecordBatch]:
    """One row for each key with its ``docs``, both sorted by key, then document.

    Few documents are a list of 16-bit numbers; where that is longer than one bit for
    each of the block's ``size`` documents, those bits.
    """
    if not len(keys):
        return
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = np.diff(np.append(first, len(keys)))
    width = -(-size // 8)
    dense = 2 * n > width
    for some in (~dense, dense):
        if not some.any():
            continue
        if some is dense:
            rows = np.repeat(np.arange(int(some.sum())), n[some])
            grid = np.zeros((int(some.sum()), 8 * width), bool)
            grid[rows, docs[gather(first[some], n[some])]] = True
            data, lengths = np.packbits(grid, axis=1, bitorder="little"), np.full(len(grid), width)
        else:
            data, lengths = docs[gather(first[some], n[some])].astype("<u2"), 2 * n[some]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        held = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
        key = keys[first[some]]
        own = {"a": key >> SHIFT, "b": key & (1 << SHIFT) - 1, "n": n[some], "block": np.full(len(key), block), "plane": np.full(len(key), plane), "dense": np.full(len(key), some is dense)}
        yield batch_of(len(key), own | {"bitmap": held})


def batch_of(rows: int, columns: dict) -> pa.RecordBatch:
    held = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _INDEX]
    return pa.RecordBatch.from_arrays(held, schema=_INDEX)


def opened(bitmap: pa.Array, dense: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, document) of every bit of some bitmaps."""
    rows, docs = [], []
    few = np.flatnonzero(~dense)
    if len(few):
        docs.append(np.frombuffer(b"".join(bitmap.take(pa.array(few)).to_pylist()), "<u2").astype(np.int64))
        rows.append(np.repeat(few, n[few]))
    many = np.flatnonzero(dense)
    for at in range(0, len(many), 512):
        some = many[at : at + 512]
        grid = np.stack([np.frombuffer(x, np.uint8) for x in bitmap.take(pa.array(some)).to_pylist()])
        row, doc = np.nonzero(np.unpackbits(grid, axis=1, bitorder="little"))
        rows.append(some[row])
        docs.append(doc.astype(np.int64))
    return (np.concatenate(rows), np.concatenate(docs)) if rows else (np.empty(0, np.int64),) * 2


def index_block(doc_ids: list, texts: list[str], block: int, a: ByteLevel, b: Pieces) -> Iterator[pa.RecordBatch]:
    """The rows of a block: its documents, then the bitmaps of its pairs."""
    distinct, joinable, chunks, ends = chunked(texts, b)
    made = Chunks(distinct, joinable, a, b)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    size = ends - starts
    doc = np.repeat(np.arange(len(texts)), size)
    sound = size > 0
    np.logical_and.at(sound, doc, made.sound[chunks])
    chunks, doc = chunks[sound[doc]], doc[sound[doc]]
    totals = {c: np.bincount(doc, weights=getattr(made, c)[chunks], minlength=len(texts)).astype(np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    at, digests = np.concatenate([[0], np.cumsum(np.where(sound, size, 0))]).tolist(), []
    codes = chunks.tolist()
    for k, good in enumerate(sound.tolist()):
        told = "".join(map(made.told.__getitem__, codes[at[k] : at[k + 1]]))[:-1]
        digests.append(hashlib.sha256(told.encode()).hexdigest() if good else "")
    yield batch_of(len(texts), totals | {"doc_id": doc_ids, "groups_sha256": digests, "block": np.full(len(texts), block), "doc": np.arange(len(texts))})
    # Links by document: how often it has a chunk, times the chunk's links.
    pairs, local = np.unique(made.pairs, return_inverse=True)
    times, often = np.unique(doc * len(distinct) + chunks, return_counts=True) if len(doc) else (np.empty(0, np.int64),) * 2
    held, chunk = times // max(1, len(distinct)), times % max(1, len(distinct))
    links = made.n_links[chunk]
    key = local[gather(made.at_link[chunk], links)].astype(np.int64) * len(texts) + np.repeat(held, links)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], np.repeat(often, links)[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    further = np.add.reduceat(weight, first) - 1 if len(first) else weight
    key, who = pairs[key[first] // len(texts)], key[first] % len(texts)
    yield from bitmaps(key, who, len(texts), block, PRESENT)
    plane = 0
    while (further >> plane).any():
        some = (further >> plane & 1).astype(bool)
        yield from bitmaps(key[some], who[some], len(texts), block, plane)
        plane += 1


def index(docs: DataFrame, path_a: str, path_b: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents and pair bitmaps of ``docs``, in blocks that one task holds one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = encoders(path_a, path_b)
        block = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if texts and (size + len(text) > block_chars or len(texts) == BLOCK_DOCS):
                    yield from index_block(ids, texts, block, a, b)
                    ids, texts, size, block = [], [], 0, block + 1
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if texts:
            yield from index_block(ids, texts, block, a, b)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, INDEX)


def pair_counts(postings: DataFrame) -> DataFrame:
    """``(a, b, docs, best)``: how many documents hold a pair, and whether no pair of ``a`` has more.

    The highest counts are at most one row for each id of the first vocabulary, which bounds the broadcast.
    """
    counts = postings.where(F.col("plane") == PRESENT).groupBy("a", "b").agg(F.sum("n").alias("docs"))
    highest = counts.groupBy("a").agg(F.max("docs").alias("highest"))
    return counts.join(F.broadcast(highest), "a").select("a", "b", "docs", (F.col("docs") == F.col("highest")).alias("best"))


def link_counts(postings: DataFrame) -> DataFrame:
    """``(a, b, links)``: how many links a pair has, from its planes."""
    weight = F.when(F.col("plane") == PRESENT, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2), "plane").cast("long"))
    return postings.groupBy("a", "b").agg(F.sum(F.col("n") * weight).alias("links"))


SCORED = "block long, doc int, n_best long, count_sum long"


def scored_documents(postings: DataFrame) -> DataFrame:
    """``(block, doc, n_best, count_sum)`` of every document with links: each block opens its bitmaps."""

    def back(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        column = {c: rows.column(c).to_numpy() for c in ("n", "plane", "docs", "best", "dense")}
        row, doc = opened(rows.column("bitmap").combine_chunks(), column["dense"], column["n"])
        weight = np.int64(1) << np.maximum(column["plane"], 0).astype(np.int64)[row]
        size = int(doc.max()) + 1
        total, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        np.add.at(total, doc, weight * column["docs"][row])
        np.add.at(best, doc, weight * column["best"][row])
        held = np.flatnonzero(total)
        block = np.full(len(held), rows.column("block")[0].as_py())
        return pa.table({"block": block, "doc": held.astype(np.int32), "n_best": best[held], "count_sum": total[held]})

    counted = postings.select("block", "a", "b", "plane", "n", "dense", "bitmap").join(pair_counts(postings), ["a", "b"])
    return counted.select("block", "plane", "n", "dense", "bitmap", "docs", "best").groupBy("block").applyInArrow(back, SCORED)


def align(docs: DataFrame, path_a: str, path_b: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """How the tokens of two tokenizers align in each document of ``docs``.

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, a
    row for each row.  A text that is null or empty, or that one tokenizer does not spell
    byte by byte, has no tokens: zeros and ''.  Rows with one id are documents of their
    own; other columns are ignored.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "alignment")
    index(docs, path_a, path_b, block_chars).write.parquet(path)
    rows = spark.read.schema(INDEX).parquet(path)
    scored = scored_documents(rows.where("a is not null").select("block", "a", "b", "plane", "n", "dense", "bitmap"))
    own = rows.where("a is null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "doc")
    whole = own.join(scored, ["block", "doc"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
