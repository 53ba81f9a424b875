"""Spelling variants: words one edit apart, found by search schemes in bidirectional FM-indexes.

Two words at most one edit apart agree in the first half of the shorter one or in all
that follows it.  So words are dealt out by halves: for each length L, words of L and of
L + 1 code points meet under their first L // 2 and under their last L - L // 2 code
points.  Many such groups share a task, which indexes the task's words, each between
delimiters, in both directions.  A word of L code points is searched there by two
schemes: match the first half exactly, then go on to the right with one substitution or
insertion; or match the second half exactly, then go on to the left.  The steps move
intervals of suffix ranks; the rows of the delimiter are in the order of the words, so
the last interval names the word.  A deletion is the insertion that the other word needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

LETTERS = "[A-Za-zÀ-ÿ]"
#: A run's crc32 that this divides marks a run to be changed.
CHANGED = 31
LEAST_LENGTH, LEAST_N, RATIO = 7, 2, 10
#: Words that one task indexes, about; a group of more is split into parts of as many.
SHARD = 40_000
#: Words that are searched together.
TOGETHER = 8_192


class Ranks:
    """Occurrences of symbols in the prefixes of a Burrows-Wheeler transform, in blocks of 64."""

    def __init__(self, bwt: np.ndarray, symbols: int):
        blocks = len(bwt) // 64 + 1
        padded = np.full(blocks * 64, symbols, bwt.dtype)
        padded[: len(bwt)] = bwt
        self.bits, self.before = self.tables(padded, [padded == c for c in range(symbols)])
        below = np.cumsum(np.bincount(bwt, minlength=symbols)[:symbols])
        self.first = np.concatenate([[0], below[:-1]]).astype(np.int64)
        self.less_bits, self.less_before = self.tables(padded, [padded < c for c in range(symbols)])

    @staticmethod
    def tables(padded: np.ndarray, masks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        bits = np.stack([np.packbits(m, bitorder="little").view(np.uint64) for m in masks])
        counts = np.bitwise_count(bits).astype(np.int64)
        return bits, np.cumsum(counts, axis=1) - counts

    @staticmethod
    def _at(bits: np.ndarray, before: np.ndarray, c, i: np.ndarray) -> np.ndarray:
        block, low = i >> 6, (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[c, block] + np.bitwise_count(bits[c, block] & low).astype(np.int64)

    def step(self, c, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of what follows ``c`` in the index's direction."""
        return self.first[c] + self._at(self.bits, self.before, c, lo), self.first[c] + self._at(self.bits, self.before, c, hi)

    def less(self, c, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many symbols below ``c`` an interval has."""
        return self._at(self.less_bits, self.less_before, c, hi) - self._at(self.less_bits, self.less_before, c, lo)


def delimited(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of symbols (0 beyond a word's length) as one text, 0 before and after each word."""
    grid = np.zeros((len(words), words.shape[1] + 1), words.dtype)
    grid[:, 1:] = words
    inside = np.arange(words.shape[1] + 1)[None, :] <= lengths[:, None]
    return np.concatenate([grid[inside], [0]]).astype(words.dtype)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in their order, by doubling; delimiters rank by their place."""
    n, stops = len(text), int((text == 0).sum())
    rank = text.astype(np.int64) + stops
    rank[text == 0] = np.arange(stops)
    size = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - size] = rank[size:] + 1
        key = rank * (n + stops + 260) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        size *= 2


class BidirectionalIndex:
    """An FM-index of delimited words and one of the words reversed, whose intervals are kept in step.

    ``words`` holds different words as rows of symbols from 1 on, 0 beyond their end.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, symbols: int):
        self.symbols, self.size = symbols, int(lengths.sum()) + len(words) + 1
        width = words.shape[1]
        columns = np.arange(width)[None, :]
        mirrored = np.take_along_axis(words, np.clip(lengths[:, None] - 1 - columns, 0, width - 1), 1)
        mirrored[columns >= lengths[:, None]] = 0
        self.left, self.word_left = self._index(words, lengths, symbols)
        self.right, self.word_right = self._index(mirrored, lengths, symbols)

    @staticmethod
    def _index(words: np.ndarray, lengths: np.ndarray, symbols: int) -> tuple[Ranks, np.ndarray]:
        order = np.lexsort(words.T[::-1])
        text = delimited(words[order], lengths[order])
        return Ranks(text[suffix_order(text) - 1], symbols), order

    def search(self, query: np.ndarray, length: int, half: int, to_right: bool) -> tuple[np.ndarray, np.ndarray]:
        """Words at one substitution or insertion from the queries, as (query, word), each pair once.

        ``query`` has rows of one ``length``.  To the right the first ``half`` symbols
        are matched exactly and the error lies behind them; to the left the last
        ``length - half`` are.
        """
        # The exact part is matched against the direction of the search, whose index takes over then.
        own, other, word = (self.right, self.left, self.word_right) if to_right else (self.left, self.right, self.word_left)
        exact = [*range(half - 1, -1, -1)] if to_right else [*range(half, length)]
        rest = [*range(half, length)] if to_right else [*range(half - 1, -1, -1)]
        at = np.arange(len(query))
        lo, hi, lo_own = np.zeros(len(query), np.int64), np.full(len(query), self.size, np.int64), np.zeros(len(query), np.int64)
        for c in [*(query[:, j] for j in exact), np.zeros(len(query), query.dtype)]:  # the delimiter comes last
            lo_own = lo_own + other.less(c, lo, hi)
            lo, hi = other.step(c, lo, hi)
        lo, hi = lo_own, lo_own + hi - lo
        alive = hi > lo
        at, lo, hi = at[alive], lo[alive], hi[alive]
        done = [np.empty(0, np.int64)] * 3  # queries and intervals that have had their error
        for j in [*rest, None]:
            want = query[:, j] if j is not None else np.zeros(len(query), query.dtype)
            q, c, a, b = self._branches(own, at, lo, hi, want)
            # An inserted symbol differs from the one it stands before, so no word is found by two ways.
            wrong = np.concatenate([done[0], q]), np.concatenate([done[1], a]), np.concatenate([done[2], b])
            x, y = own.step(want[wrong[0]], wrong[1], wrong[2])
            moved = [wrong[0][y > x], x[y > x], y[y > x]]
            if j is not None:
                moved = [np.concatenate([m, n]) for m, n in zip(moved, (q, a, b))]  # substituted: the wanted symbol is gone
                x, y = own.step(want[at], lo, hi)
                at, lo, hi = at[y > x], x[y > x], y[y > x]
            done = moved
        return done[0], word[done[1] - 1]  # the text's end comes before its first delimiter, so rows are one on

    def _branches(self, own: Ranks, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, ...]:
        """All letters but the wanted one that can come next: (query, letter, interval)."""
        letters = np.arange(1, self.symbols)[:, None]
        a, b = own.step(letters, lo[None, :], hi[None, :])
        keep = (b > a) & (letters != want[at][None, :])
        c, k = np.nonzero(keep)
        return at[k], c + 1, a[keep], b[keep]


def near_words(words: list[str], held: np.ndarray, searched: list[tuple[np.ndarray, int, bool]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, near word) as places in ``words``, both ways.

    ``held`` lists the places of the words to index; ``searched`` the places of words of
    one length, that length, and the direction.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.zeros((len(words), int(lengths.max())), np.uint32)
    codes[np.arange(codes.shape[1])[None, :] < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    letters = np.unique(codes[codes > 0])
    coded = ((np.searchsorted(letters, codes) + 1) * (codes > 0)).astype(np.int16)
    index = BidirectionalIndex(coded[held], lengths[held], len(letters) + 1)
    for places, length, to_right in searched:
        half = length // 2
        for start in range(0, len(places), TOGETHER):
            some = places[start : start + TOGETHER]
            query = coded[some][:, :length].astype(np.int64)
            q, found = index.search(query, length, half, to_right)
            found = held[found]
            if not to_right:  # what agrees in the first half is found by the other search
                first = (coded[found][:, :half] == query[q][:, :half]).all(axis=1)
                q, found = q[~first], found[~first]
            yield some[q], found
            longer = lengths[found] > length
            yield found[longer], some[q][longer]  # the longer word's near word by a deletion


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)``: runs of letters, A-Z lower-cased, some with a code point deleted, of at least 7 code points and 2 occurrences.

    Only runs of 7 letters or more can give such a word.  Counts are summed before the shuffle.
    """
    long_runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))
    lowered = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc.alias("doc"), F.explode(long_runs).alias("run")).select("doc", lowered.alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    hashed = runs.select("run", h.alias("h"), F.char_length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    left = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.col("size")))
    words = hashed.select(F.when(F.col("h") % CHANGED == 0, left).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_N)


def halves(words: DataFrame) -> DataFrame:
    """``(word, n, length, right, asks, key)``: the groups that a word belongs to, and whether it is searched there."""
    size = F.char_length("word")

    def group(length: Column, right: bool, asks: bool) -> Column:
        half = F.floor(length / 2).cast("int")
        part = F.substring(F.col("word"), F.lit(1), half) if right else F.right(F.col("word"), length - half)
        key = F.xxhash64(length, F.lit(right), part)
        return F.struct(length.alias("length"), F.lit(right).alias("right"), F.lit(asks).alias("asks"), key.alias("key"))

    own = [group(size, right, True) for right in (True, False)]
    shorter = [F.when(size > LEAST_LENGTH, group(size - 1, right, False)) for right in (True, False)]
    groups = F.filter(F.array(*own, *shorter), lambda g: g.isNotNull())
    return words.select("word", "n", F.explode(groups).alias("g")).select("word", "n", "g.*")


NEAR = "word string, n_near long, best_n long, best string"


def find_near(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """``(word, n_near, best_n, best)`` for words with near words: how many, and that of largest n.

    A group of more than ``shard`` words is indexed in parts; its words are searched in each.
    """
    rows = halves(words)
    shards = max(1, -(-4 * words.count() // shard))
    large = cut(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > shard))
    sized = rows.join(large, "key", "left").withColumn("parts", F.coalesce(F.ceil(F.col("size") / shard), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    every = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    spread = sized.select("word", "n", "length", "right", "asks", "key", "parts", own.alias("own"), F.explode(every).alias("part"))
    alone = F.xxhash64("key", "part")  # a part is a task of its own, so no pair is found in two
    dealt = spread.select(
        "word", "n", "length", "right", "asks", (F.col("own") == F.col("part")).alias("held"),
        F.when(F.col("parts") > 1, alone).otherwise(F.pmod("key", F.lit(shards).cast("long"))).alias("shard"),
    )
    found = dealt.groupBy("shard").applyInPandas(near_of, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    whole = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return whole.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def near_of(rows: pd.DataFrame) -> pd.DataFrame:
    """The near words that a task's words have among those that it holds, counted, and the best of them."""
    names = [c.split()[0] for c in NEAR.split(", ")]
    place, words = pd.factorize(rows["word"], sort=True)
    n = np.zeros(len(words), np.int64)
    n[place] = rows["n"]
    held = np.unique(place[rows["held"].to_numpy()])
    if not len(held):
        return pd.DataFrame({c: [] for c in names})
    asks = rows.assign(place=place)[rows["asks"]].drop_duplicates(["place", "length", "right"])
    searched = [(g["place"].to_numpy(), int(length), bool(right)) for (length, right), g in asks.groupby(["length", "right"])]
    pairs = [*near_words(words.tolist(), held, searched)]
    one, two = (np.concatenate([np.empty(0, np.int64), *side]) for side in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 2
    order = np.lexsort((two, -n[two], one))
    one, two = one[order], two[order]
    first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]])) if len(one) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(one)))
    return pd.DataFrame(dict(zip(names, (words[one[first]], count, n[two[first]], words[two[first]]))))


def with_roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for words with a form: what following forms leads to.

    A form's n is ten times the word's, so chains are short; each turn doubles how far
    a word has come.  The driver sees one yes or no a turn.
    """
    links = cut(forms)
    while True:
        far = links.select(F.col("word").alias("form"), F.col("form").alias("next"))
        moved = cut(links.join(far, "form", "left").select("word", F.coalesce("next", "form").alias("form"), F.col("next").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("word", F.col("form").alias("root"))
        links = moved.select("word", "form")


def variants(docs: DataFrame, ratio: int = RATIO, shard: int = SHARD) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``docs``.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored, null texts have no
    words, a null doc_id counts as the empty text in what marks a run.  Repeated rows
    count again.  ``form`` is the near word of largest n, the smaller one on a tie, if
    its n is ``ratio`` times the word's or more; ``root`` follows forms to the last.
    No words give no rows.
    """
    words = cut(word_counts(docs))
    near = words.join(find_near(words, shard), "word", "left")
    formed = F.col("best_n") >= ratio * F.col("n")
    known = cut(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")))
    roots = with_roots(known.where("form is not null").select("word", "form"))
    whole = known.join(roots, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
