"""Toxicity by noisy-channel deobfuscation.

A written token is taken as a word that went through a channel, which swaps letters
for look-alikes, puts marks or blanks between letters and repeats letters.  The
token's lattice of possible letters is decoded with Viterbi under a character
trigram model of the whole corpus.  Restored words are then scored with a lexicon
of words and stems, learned from labelled documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, release

#: Labelled rows that the lexicon is learned from, at most; chosen by the hash of their ids.
SAMPLE_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
STEMS = (4, 5, 6)
#: A lexicon entry must be held by toxic texts of so many kins, and by a kin for each so
#: large share of toxic texts more, and be right this often, one clean text not counted.
MIN_KIN, KIN_SHARE, PRECISION, FORGIVEN = 4, 0.004, 0.95, 1
#: Log probabilities and shapes of pieces that a task remembers.
MEMO = 300_000
#: Latest tokens whose words a task keeps, features that it counts before it hands them over,
#: and words that are counted before their trigrams are.
RECENT = 60_000
#: A word counts that is on a path this close to the best one, as a difference of logarithms.
MARGIN = 5.0
#: Signs that are decoded at once and what windows share; characters of texts whose blanks are looked up at once.
READ, OVERLAP, GROUP_CHARS = 4096, 128, 1 << 18
LEAST = -math.inf

# Letters that a sign can stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "§": "s", "µ": "u",
}
# Letters of other scripts that look like those of ours.
SHAPES = dict(zip("аеорсухіјѕԁһԛԝкмнтвгпиѵɡıȷοαρνικτυχεηωγ", "aeopcyxijsdhqwkmhtbrnuvgijoapviktuxenwy"))
#: Letters that several signs in a row can stand for.
DRAWN = {
    "|_|": "u", "(_)": "u", "/\\/\\": "m", "|\\/|": "m", "|v|": "m", "|\\|": "n", "/\\/": "n", "\\/\\/": "w", "\\/": "v", "/\\": "a",
    "/-\\": "a", "()": "o", "[]": "o", "|)": "d", "|3": "b", "|-|": "h", "|<": "k", "|=": "f", "><": "x",
}
SEPARATORS = ".-_*~,'’·:/\\ "
#: Log costs of the channel: a swap, a mark between letters, a repeated letter, a mark that ends a word, a blank inside a word;
#: a blank between single signs is as a mark.
SWAP, MARK, REPEAT, BREAK, DROP = -1.5, -0.3, -1.2, -0.3, -2.5
#: Kinds of pieces: of several letters, of one, with several readings at an end, and read with whatever is around.
MANY, ONE, SEVERAL, WILD = range(4)
#: Letters of the model; any other letter is one class of its own.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"

EDGES = ".,;:!?\"'()[]{}<>|*#%&$~`´-_=+/\\…«»„“”‚‘’"
INNER_EDGES = ".,;:?\"'()[]{}<>*#%&~`´-_=/\\…«»„“”‚‘’"
REPEATED, TRIPLED, REPEATS = re.compile(r"(.)\1"), re.compile(r"(.)\1\1"), re.compile(r"(.)\1+")
DRAWING = re.compile("|".join(map(re.escape, DRAWN)))
MARKED = re.compile(f"[{re.escape(SEPARATORS)}]+")
PARTS, FOREIGN = re.compile(r"[^\W\d_]+"), re.compile("[^\x00-ÿ]")


def model_letter(letter: str) -> str:
    return letter if letter in LETTERS else "?"


#: What trigrams are made of: a word's edge, the letters and the class of the others.
SIGNS = " " + LETTERS + "?"
SIGN_OF = np.array([SIGNS.index(model_letter(chr(c))) if chr(c) != " " else 0 for c in range(256)] + [len(SIGNS) - 1])


def grams_of(words: Counter) -> np.ndarray:
    """How often each trigram is in words that are counted with the marks around them, by the places of its signs."""
    bare = [(w, n) for w, n in ((chunk.strip(EDGES), n) for chunk, n in words.items()) if w.isalpha()]
    text = "  " + "  ".join(w for w, _ in bare) + " "
    signs = SIGN_OF[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 256)]
    whole = np.flatnonzero((signs[1:-1] != 0) | (signs[2:] != 0))  # the others reach from a word into the next
    times = np.repeat([n for _, n in bare], [len(w) + 1 for w, _ in bare])
    grams = (signs[whole] * len(SIGNS) + signs[whole + 1]) * len(SIGNS) + signs[whole + 2]
    return np.bincount(grams, times, len(SIGNS) ** 3).astype(np.int64)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """``(gram, n)``: character trigrams of every word of the corpus, edges as blanks.

    Each task counts its own words first, so what is shuffled is bounded by the
    number of letters cubed per task.
    """
    schema = pa.schema([("gram", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        totals = np.zeros(len(SIGNS) ** 3, np.int64)
        words: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                words.update((text.as_py() or "").lower().split())
                if len(words) > RECENT:
                    totals += grams_of(words)
                    words = Counter()
        totals += grams_of(words)
        held = np.flatnonzero(totals)
        names = ["".join(SIGNS[k // len(SIGNS) ** e % len(SIGNS)] for e in (2, 1, 0)) for k in held.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(totals[held])], schema=schema)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class CharModel:
    """Trigram log probabilities, interpolated with bigrams and letters."""

    def __init__(self, counts: dict[str, int]):
        self.tri, self.ctx, self.bi, self.one, self.total = counts, Counter(), Counter(), Counter(), 0
        for gram, n in counts.items():
            self.ctx[gram[:2]] += n
            self.bi[gram[1:]] += n
            self.one[gram[2]] += n
            self.total += n
        self.left: Counter = Counter()
        for gram, n in self.bi.items():
            self.left[gram[0]] += n
        self.known: dict[str, float] = {}

    def logp(self, context: str, letter: str) -> float:
        gram = context + letter
        if gram not in self.known:
            if len(self.known) >= MEMO:
                self.known.clear()
            self.known[gram] = self._logp(context, letter)
        return self.known[gram]

    def _logp(self, context: str, letter: str) -> float:
        a, b, c = *map(lambda x: x if x == " " else model_letter(x), context), letter if letter == " " else model_letter(letter)
        three = self.tri.get(a + b + c, 0) / max(1, self.ctx[a + b])
        two = self.bi[b + c] / max(1, self.left[b])
        one = (self.one[c] + 1) / (self.total + len(LETTERS) + 2)
        return math.log(0.7 * three + 0.2 * two + 0.1 * one)


def moves(signs: str, at: int, drawn: bool) -> list[tuple[int, str, float]]:
    """Width, letter and cost of what the signs from ``at`` on can write."""
    seen = signs[at]
    made = [(1, seen, 0.0)] if seen.isalpha() else [(1, x, SWAP) for x in LOOK_ALIKES.get(seen, "")]
    if drawn:
        made += [(k, DRAWN[signs[at : at + k]], SWAP) for k in (2, 3, 4) if signs[at : at + k] in DRAWN and at + k <= len(signs)]
    return made


def blanks(signs: str, at: int, options: list) -> tuple[float, float] | None:
    """Costs of leaving a sign out and of ending a word with it, or None if it must be read."""
    if signs[at] == " " and not (signs[at - 2 : at - 1] in ("", " ") and signs[at + 2 : at + 3] in ("", " ")):
        return DROP, 0.0
    return (MARK, BREAK) if signs[at] in SEPARATORS or not options else None


def steps(signs: str, at: int, state: str, model: CharModel, repeats: bool, drawn: bool) -> list[tuple[int, str, float, str]]:
    """Where the lattice goes from a state before sign ``at``: place, state, score and what is written.

    A letter is written, by itself or for a look-alike or a drawing; a repeated letter, a
    mark or a blank is left out; or a mark or a blank ends a word.
    """
    options = moves(signs, at, drawn)
    out = [(at + width, state[1] + x, cost + model.logp(state, x), x) for width, x, cost in options]
    if repeats and state[1] != " " and any(x == state[1] for width, x, _ in options if width == 1):
        out.append((at + 1, state, REPEAT, ""))
    costs = blanks(signs, at, options)
    if costs:
        out.append((at + 1, state, costs[1] if state == "  " else costs[0], ""))
        if state != "  ":
            out.append((at + 1, "  ", costs[1] + model.logp(state, " "), " "))
    return out


def restore(signs: str, model: CharModel, repeats: bool = True) -> list[str]:
    """The words on paths through the lattice of lower-case signs that are about as likely as the best.

    States are the last two letters written, two blanks between words.  Viterbi forward
    gives the best score to each state of each place, and backward the best one from
    it; a word counts if the best path that starts it is within ``MARGIN`` of the best
    of all, and so does what it makes with the two words after it, since ends of words
    are the least certain where every letter is set apart.  The words of the best path
    come first.  Without ``repeats`` every letter is written.  Long runs are read in
    windows that overlap by more than a word.
    """
    found: dict[str, None] = {}
    for at in range(0, max(1, len(signs) - OVERLAP), READ - OVERLAP):
        found |= dict.fromkeys(_restore(signs[at : at + READ], model, repeats)[1])
    return [*found]


def _restore(signs: str, model: CharModel, repeats: bool) -> tuple[float, list[str]]:
    drawn, n = DRAWING.search(signs) is not None, len(signs)
    ahead: list[dict[str, float]] = [{} for _ in range(n + 1)]
    edges: list[dict[str, list]] = []
    ahead[0]["  "] = 0.0
    for at in range(n):
        edges.append({})
        for state, score in ahead[at].items():
            edges[at][state] = made = steps(signs, at, state, model, repeats, drawn)
            for place, to, cost, _ in made:
                if ahead[place].get(to, LEAST) < score + cost:
                    ahead[place][to] = score + cost
    behind: list[dict[str, tuple]] = [{} for _ in range(n + 1)]
    behind[n] = {state: (0.0 if state == "  " else model.logp(state, " "), n, "  ", " ") for state in ahead[n]}
    for at in range(n - 1, -1, -1):
        for state, made in edges[at].items():
            behind[at][state] = max((cost + behind[place][to][0], place, to, x) for place, to, cost, x in made)
    best = behind[0]["  "][0]

    def word(at: int) -> tuple[str, int]:
        """The word that the best path from a word's start writes, and where it ends."""
        state, letters = "  ", []
        while at < n:
            _, at, state, x = behind[at][state]
            if x == " " and letters:
                break
            letters += x
        return "".join(letters), at

    words, at = [], 0
    while at < n:
        made, at = word(at)
        words.append(made)
    for at in range(n):
        if "  " in ahead[at] and ahead[at]["  "] + behind[at]["  "][0] >= best - MARGIN:
            one, end = word(at)
            two, end = word(end)
            words += [one, one + two, one + two + word(end)[0]]
    return best, [*dict.fromkeys(w for w in words if w)]


def listed(word: str) -> list[str] | None:
    """All readings of a word of letters with at most two doubled ones; None if there are more."""
    doubled = REPEATED.findall(word)
    if len(doubled) > 2 or TRIPLED.search(word):
        return None
    made = [word]
    for letter in doubled:
        made += [w.replace(letter * 2, letter, 1) for w in made if letter * 2 in w]
    return made


def token_words(token: str, model: CharModel) -> list[str]:
    """The words of lower-case signs: themselves, or their parts and what they restore to.

    A word of letters that never repeat one in a row has no other reading, and the few
    readings of one with a doubled letter or two are listed; all else is decoded.
    """
    if " " in token:
        pieces = token.split()
        plain = all(len(p) > 1 and p.isalpha() and not REPEATED.search(p) for p in pieces)
        return ["".join(pieces)] if plain else restore(token, model)
    core = token.strip(EDGES)
    if core.isalpha() and (read := listed(core)):
        return read
    inner = token.strip(INNER_EDGES)
    read = {w for t in {core, inner, token, *MARKED.split(token)} for w in restore(t, model)}
    if REPEATED.search(core) and not core.isalpha():
        read.update(restore(core, model, repeats=False))
    return [*dict.fromkeys([*PARTS.findall(token), *sorted(read)])]


def trimmed(chunk: str) -> str:
    """A chunk without the marks around it, but for look-alikes that it begins with."""
    return chunk.lstrip(INNER_EDGES).rstrip(EDGES)


class Asked(dict):
    """A memo whose function keeps what it finds itself."""

    def __init__(self, made: Callable):
        super().__init__()
        self.made = made

    def __missing__(self, key):
        return self.made(key)

    def __reduce__(self):
        return Asked, (self.made,)


class Boundaries:
    """Which blanks of a text the lattice of the whole text leaves out.

    The best path leaves out the blank between two chunks only if running on scores
    better than a word end there, and that is a matter of the two letters before and
    after it: a table of all such letters tells.  Where signs at the ends of chunks have
    several readings, any that runs on counts; a chunk of one letter is tried with both
    sides, and several in a row are always read together.  So decoding the runs found
    here gives every word that is read across blanks, without decoding the rest.

    The table is made once, where the model is, and goes to the tasks as bits.
    """

    def __init__(self, model: CharModel):
        letters = LETTERS + "?"
        self.code, self.n, self.shapes, self.many = {c: k for k, c in enumerate(letters)}, len(letters), Asked(self.shape), {}
        pairs, n = [a + b for a in letters for b in letters], len(letters)
        self.pairs = {p: k for k, p in enumerate(pairs) if p[0] != p[1] and "?" not in p}
        self.follow = np.array([[model.logp(p, c) for c in letters] for p in pairs], np.float32)
        self.ends = np.array([model.logp(p, " ") for p in pairs], np.float32)
        self.one_end = np.array([model.logp(" " + a, " ") for a in letters], np.float32)
        self.start = np.array([model.logp("  ", a) for a in letters], np.float32)
        self.second = np.array([[model.logp(" " + a, b) for b in letters] for a in letters], np.float32)
        self.start_two = (self.start[:, None] + self.second).ravel()
        self.joins = np.stack([self._joined_by(t) for t in range(n * n)])

    def _joined_by(self, tail: int) -> np.ndarray:
        """Bits of the heads that are read on with after a tail, the highest bit first."""
        run_on = self.follow[tail][:, None] + self.follow[tail % self.n * self.n : tail % self.n * self.n + self.n]
        return np.packbits(run_on.ravel() + np.float32(DROP) > self.ends[tail] + self.start_two)

    def joined(self, tail: np.ndarray, head: np.ndarray) -> np.ndarray:
        return (self.joins[tail, head >> 3] >> (7 - (head & 7)) & 1).astype(bool)

    def shape(self, chunk: str) -> int:
        """Kind, tails and heads of a chunk in one number; -1 if it holds no letter."""
        piece = trimmed(chunk)
        if len(self.shapes) >= MEMO:
            self.shapes.clear()
            self.many.clear()
        head, tail = self.pairs.get(piece[:2]), self.pairs.get(piece[-2:])
        if head is not None and tail is not None:  # two letters that differ at either end
            self.shapes[chunk] = made = MANY | tail << 2 | tail << 14 | head << 26 | head << 38
            return made
        signs = [self.code[model_letter(c)] if c.isalpha() else [self.code[x] for x in LOOK_ALIKES.get(c, "")] for c in piece]
        read = [[s] if isinstance(s, int) else s for s in signs if s != []]
        if not read:
            made = -1
        elif DRAWING.search(piece):
            made = WILD
        elif len(read) == 1:
            made = ONE | read[0][0] << 2
            if len(read[0]) > 1:
                made = WILD
        else:
            heads, tails = ([a * self.n + b if way == 1 else b * self.n + a for a, b in self.ends_of(read[::way])] for way in (1, -1))
            if len(heads) > 2 or len(tails) > 2:
                made, self.many[chunk] = SEVERAL | tails[0] << 2 | heads[0] << 26, (tails, heads)
            else:
                made = MANY | tails[0] << 2 | tails[-1] << 14 | heads[0] << 26 | heads[-1] << 38
        self.shapes[chunk] = made
        return made

    @staticmethod
    def ends_of(read: list[list[int]]) -> list[tuple[int, int]]:
        """What the first two letters of ``read`` can be, a letter that repeats counting once or twice."""
        out = {(a, b) for a in read[0] for b in read[1]}
        for a in read[0]:
            at = 1
            while at < len(read) and a in read[at]:
                at += 1
                out.update((a, b) for b in (read[at] if at < len(read) else []))
        return sorted(out)

    def runs(self, texts: list[str]) -> list[list[str]]:
        """For each lower-case text the runs of its pieces that are read together, with blanks between them."""
        known, chunks, ends = self.shapes, [], []
        for text in texts:
            chunks += text.split()
            ends.append(len(chunks))
        made = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        text_of = np.repeat(np.arange(len(texts)), np.diff([0, *ends]))
        place = np.flatnonzero(made >= 0)
        made, text_of = made[place], text_of[place]
        out: list[list[str]] = [[] for _ in texts]
        if len(made) < 2:
            return out
        kind, n, mask = made & 3, self.n, (1 << 12) - 1
        tail, tail2, head, head2 = ((made >> k & mask).astype(np.int32) for k in (2, 14, 26, 38))
        t, u, h, i = tail[:-1], tail2[:-1], head[1:], head2[1:]
        many, one, wild, several = (kind == k for k in (MANY, ONE, WILD, SEVERAL))
        linked = self.joined(t, h)
        for a, b in ((u, h), (t, i), (u, i)):
            differ = np.flatnonzero(((a is u) & (u != t)) | ((b is i) & (i != h)))
            linked[differ] |= self.joined(a[differ], b[differ])
        linked &= many[:-1] & many[1:]
        linked |= one[:-1] & one[1:]
        at = 1 + np.flatnonzero(one[1:-1] & many[:-2] & many[2:])
        c, t, h = tail[at], tail[at - 1], head[at + 1]
        into, out_of = self.follow[t, c] + DROP, self.follow[c * n + h // n, h % n] + DROP
        neither = self.ends[t] + self.start[c] + self.one_end[c] + self.start_two[h]
        left = into + self.ends[t % n * n + c] + self.start_two[h]
        right = self.ends[t] + self.start[c] + self.second[c, h // n] + out_of
        both = into + self.follow[t % n * n + c, h // n] + out_of
        linked[at - 1] = np.maximum(left, both) > np.maximum(neither, right)
        linked[at] = np.maximum(right, both) > np.maximum(neither, left)
        linked |= wild[:-1] | wild[1:] | (one[:-1] & several[1:]) | (several[:-1] & one[1:])
        for k in np.flatnonzero(several).tolist():
            for a, b in ((k - 1, k), (k, k + 1)):
                if a >= 0 and b < len(made) and kind[a] in (MANY, SEVERAL) and kind[b] in (MANY, SEVERAL):
                    one_side, other = self.many.get(chunks[place[a]]), self.many.get(chunks[place[b]])
                    tails = one_side[0] if one_side else [tail[a], tail2[a]]
                    heads = other[1] if other else [head[b], head2[b]]
                    linked[a] |= any(self.joined(np.int64(x), np.int64(y)) for x in tails for y in heads)
        linked &= text_of[:-1] == text_of[1:]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], linked.view(np.int8), [0]))))
        for a, b in edges.reshape(-1, 2).tolist():
            out[text_of[a]].append(" ".join(trimmed(chunks[k]) for k in place[a : b + 1].tolist()))
        return out


def word_features(words: list[str]) -> list[str]:
    """Whole words as ``=word`` and stems as their first letters."""
    out = []
    for w in words:
        out.append("=" + w)
        out += [w[:n] for n in STEMS if len(w) > n]
    return out


def unmarked(text: str) -> str:
    """A text without the sentence marks that end chunks, which no reading minds."""
    for mark in ",.;:?":
        text = text.replace(mark + " ", " ").replace(mark + "\n", "\n")
    return text


def folded(text: str) -> str:
    """A text with letters of other scripts and widths as the ones that they look like."""
    return "".join(SHAPES.get(c) or unicodedata.normalize("NFKC", c).lower() if c > "ÿ" else c for c in text)


def text_tokens(texts: list[str], boundaries: Boundaries) -> list[set[str]]:
    """Different tokens of each text, and the runs of pieces that are read across blanks.

    Tokens with letters beyond our own alphabet count as they are and as what they look like.
    """
    low = [unmarked(t.lower()) for t in texts]
    plain = [folded(t) if FOREIGN.search(t) else t for t in low]
    return [{*t.split(), *runs} if t is p else {*t.split(), *p.split(), *runs} for t, p, runs in zip(low, plain, boundaries.runs(plain))]


def in_groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts in their order, in lists of about ``GROUP_CHARS`` characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > GROUP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def in_fold(doc_id: str = "doc_id", held_out: int = HELD_OUT):
    """Whether crc32 of the id as text leaves the held-out remainder."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == held_out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``rows`` labelled rows outside the held-out fold."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~in_fold()).select("doc_id", F.col(label).cast("int").alias("label"))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def kin(features: set[str]) -> int:
    """A number that near copies are likely to share: the least hash of a text's features."""
    return min((zlib.crc32(f.encode("utf-8", "surrogatepass")) for f in features), default=0)


def learn_lexicon(sample: DataFrame, model: CharModel, boundaries: Boundaries | None = None) -> tuple[dict[str, float], float]:
    """Log odds of a document with each lexicon entry, and of one without any.

    An entry must be held by toxic texts of many different kins, so that the other words
    of texts that are copies of each other lend it no support, and by clean texts
    hardly ever.  Of entries that are prefixes of each other the shortest
    stays.  A task hands over, per feature, how many clean texts hold it and the kins
    and numbers of toxic ones, in parts of about ``RECENT`` features that add up.
    """
    schema = "feature string, clean long, kins array<long>, toxic array<long>"
    arrow = pa.schema([("feature", pa.string()), ("clean", pa.int64()), ("kins", pa.list_(pa.int64())), ("toxic", pa.list_(pa.int64()))])

    def counted(clean: Counter, toxic: dict[str, tuple[set[int], list[int]]]) -> pa.RecordBatch:
        names, none = list(clean.keys() | toxic.keys()), ((), ())
        found = [toxic.get(f, none) for f in names]
        lists = [pa.array([list(x[k]) for x in found], pa.list_(pa.int64())) for k in range(2)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([clean[f] for f in names], pa.int64()), *lists], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        clean: Counter = Counter()
        toxic: dict[str, tuple[set[int], list[int]]] = {}
        known = Recent(lambda token: tuple(word_features(token_words(token, model))))
        for batch in batches:
            numbers, texts, marks = (batch.column(k).to_pylist() for k in range(3))
            held = (tokens for group in in_groups([t or "" for t in texts]) for tokens in text_tokens(group, boundaries))
            for number, tokens, label in zip(numbers, held, marks):
                features = {f for token in tokens for f in known[token]}
                if label:
                    own = kin(features)
                    for f in features:
                        kins, numbers = toxic.setdefault(f, (set(), []))
                        kins.add(own)
                        numbers.append(number)
                else:
                    clean.update(features)
                if len(clean) + len(toxic) > RECENT:
                    yield counted(clean, toxic)
                    clean, toxic = Counter(), {}
        yield counted(clean, toxic)

    boundaries = boundaries or Boundaries(model)
    texts = cut(sample.groupBy("text").agg(F.max("label").alias("label")).withColumn("number", F.monotonically_increasing_id()))
    totals = dict(texts.groupBy("label").count().collect())
    features = texts.select("number", "text", "label").mapInArrow(run, schema).groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.size(F.array_distinct(F.flatten(F.collect_list("kins")))).alias("kins"), F.flatten(F.collect_list("toxic")).alias("toxic")
    )
    n, n1, n0 = F.size("toxic"), totals.get(1, 0), totals.get(0, 0)
    strong = features.where((F.col("kins") >= MIN_KIN + KIN_SHARE * n1) & (n >= PRECISION * (n + F.greatest(F.col("clean") - FORGIVEN, F.lit(0))))).collect()  # of a bounded sample
    weights: dict[str, float] = {}
    for r in sorted(strong, key=lambda r: (len(r["feature"].lstrip("=")), r["feature"])):
        word = r["feature"].lstrip("=")
        if not any(word[:k] in weights for k in STEMS):
            weights[r["feature"]] = math.log((len(r["toxic"]) + 0.5) / (r["clean"] + 0.5))
    seen = {i for r in strong if r["feature"] in weights for i in r["toxic"]}
    return weights, math.log((n1 - len(seen) + 0.5) / (n0 + 1))


class Recent(dict):
    """A memo of a function that keeps the ``size`` keys asked for last, or up to twice as many."""

    def __init__(self, made: Callable, size: int = RECENT):
        super().__init__()
        self.made, self.size, self.older = made, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = found = self.older[key] if key in self.older else self.made(key)
        return found


class Outlined(dict):
    """The letter of a sign in an outline, or None; letters that one sign can stand for are one."""

    def __missing__(self, code: int) -> str | None:
        letter = chr(code) if chr(code).isalpha() else LOOK_ALIKES.get(chr(code), "")[:1]
        self[code] = found = next((x[0] for x in LOOK_ALIKES.values() if letter and letter in x), letter) or None
        return found


OUTLINED = Outlined()


def outline(signs: str) -> str:
    """All letters that signs can write, in a row, with those that one sign can stand for as one and none twice in a row.

    A reading writes letters that follow each other, for what is between them is left out, so
    its outline is part of that of the signs, whatever it leaves out or repeats.
    """
    return REPEATS.sub(r"\1", signs.translate(OUTLINED))


class Scorer:
    """Scores texts with a lexicon; remembers what it found in tokens.

    A token is decoded only if its outline holds that of an entry, or a drawing that has
    other letters than its signs; no other one can be read as an entry.
    """

    def __init__(self, model: CharModel, boundaries: Boundaries, weights: dict[str, float], base: float):
        self.model, self.weights, self.base, self.memo, self.boundaries = model, weights, base, Recent(self.entries), boundaries
        self.heads, tails = {f.lstrip("=")[: STEMS[0]] for f in weights}, {}
        for f in weights:
            held = outline(f.lstrip("="))
            tails.setdefault(held[:1], set()).add(re.escape(held[1:]))
        self.possible = re.compile("|".join(f"{re.escape(head)}(?:{'|'.join(sorted(tails[head]))})" for head in sorted(tails)) or "(?!)")

    def entries(self, token: str) -> tuple[str, ...]:
        core = token.strip(EDGES)
        if core.isalpha() and not REPEATED.search(core):  # has itself as its only reading
            return tuple(f for f in word_features([core]) if f in self.weights) if core[: STEMS[0]] in self.heads else ()
        if not self.possible.search(outline(token)) and not DRAWING.search(token):
            return ()
        return tuple(f for f in word_features(token_words(token, self.model)) if f in self.weights)

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[float, int]]:
        """The probability that each text is toxic, and the number of lexicon entries it holds."""
        memo = self.memo
        for group in in_groups([t or "" for t in texts]):
            for tokens in text_tokens(group, self.boundaries):
                found = set(chain.from_iterable(map(memo.__getitem__, tokens)))
                total = max(self.weights[f] for f in found) + math.log(len(found)) if found else self.base
                yield 1 / (1 + math.exp(-max(-50.0, min(50.0, total)))), len(found)


Fitted = tuple[CharModel, Boundaries, dict[str, float], float]


def score(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """``(doc_id, score, n_hits)`` for each row of ``docs``; null texts count as empty."""
    arrow = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_hits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = Scorer(*fitted)
        for batch in batches:
            made = [*scorer(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in made], pa.float64()), pa.array([n for _, n in made], pa.int64())], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, n_hits long")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    fitted = fit(docs, labels, sample_rows)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = Scorer(*fitted)
        for batch in batches:
            yield batch.filter(pa.array([x < THRESHOLD for x, _ in scorer(batch.column(place).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Fitted:
    """The character model of all ``docs`` with its table of blanks, and the lexicon of a bounded labelled sample."""
    model = CharModel({r["gram"]: r["n"] for r in trigram_counts(docs).collect()})  # letters cubed at most
    boundaries = Boundaries(model)
    return model, boundaries, *learn_lexicon(training_rows(docs, labels, "toxic", sample_rows), model, boundaries)


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    Labels come only from rows outside the held-out fold.  Empty and null texts get
    the score of a text without entries; a null doc_id is never held out.  Without
    labelled rows every score is one half or less.
    """
    scored = score(docs, fit(docs, labels, sample_rows))
    return scored.select(
        "doc_id", F.coalesce(in_fold(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits",
    )
