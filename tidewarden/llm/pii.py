"""Personal data by patterns and a character BiLSTM-CRF trained in numpy.

Base spans follow four patterns, found in time linear in the text.  The network adds
spans that are written otherwise, such as ``name (at) host (dot) org``.  It is trained
from labelled spans in sentences that a fixed seed makes; ``python -m
tidewarden.llm.pii`` trains it again and writes ``pii_weights.npz`` beside this
module, so no query trains.  Windows start at fixed places of a text and overlap;
where they do, their scores are averaged, and one Viterbi pass over the joined scores
gives spans, so no window's edge decides.  A decoded span takes the edges of the
written form that it lies on.

A span of any kind has one of four written forms (``FORMS``), and each form holds an
at-sign with a host and a dot after it, nine digits, or four groups of digits, with
nothing but marks and dots between.  Text farther than ``MARGIN`` from all of these
can hold no span and is not read by the network.
"""

from __future__ import annotations

import io
import pkgutil
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
WINDOW, STEP, MARGIN = 96, 48, 48
HIDDEN, TAGS = 16, 1 + 2 * len(KINDS)
TRAIN_BATCHES, BATCH, RATE, SEED = 1800, 64, 0.02, 11
#: Windows that the network reads at once, and characters of texts, and of one stretch, that it has in memory.
GROUP, GROUP_CHARS, STRETCH_CHARS = 1024, 1 << 19, 1 << 18
WEIGHTS_FILE = "pii_weights.npz"

Span = tuple[str, int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

_DOT = r"(?:\s?[(\[{<]\s?(?:dot|\.)\s?[)\]}>]\s?|\sdot\s|\s?\.\s?)"
_HOST = r"[\w-]+(?:(?:\s?[(\[{<]\s?(?:dot|\.)\s?[)\]}>]\s?|\sdot\s|\s\.\s|\.)[\w-]+)+"
#: What spans of each kind look like, however they are written out.
FORMS = {
    "email": re.compile(rf"\w[\w.%+-]*(?:\s?@\s?|\s?[(\[{{<]\s?(?:at|@)\s?[)\]}}>]\s?|\sat\s){_HOST}", re.IGNORECASE),
    "ip": re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE),
    "card": re.compile(r"[0-9](?:[\W_]{0,3}[0-9])+"),
    "phone": re.compile(r"[+(]{0,2}[0-9](?:[\W_]{0,3}[0-9])+"),
}
AT_HOST = re.compile(rf"(?:@|[(\[{{<]\s?(?:at|@)\s?[)\]}}>]|\bat\s)\s?{_HOST}", re.IGNORECASE)
NUMBER = re.compile(r"[0-9](?:(?:[\W_]|dot)*[0-9])+", re.IGNORECASE)
PART = re.compile(r"[\w.%+-]")
GROUPS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, leftmost and non-overlapping per kind, by start."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        for m in DOTTED.finditer(text):
            if m.group().count(".") >= 3:
                parts = [(p.start(), p.end()) for p in re.finditer(r"[0-9]+", m.group())]
                for k in range(0, len(parts) - 3, 4):
                    a, b = m.start() + parts[k][0], m.start() + parts[k + 3][1]
                    if all(len(x := text[m.start() + p : m.start() + q].lstrip("0")) <= 3 and int(x or 0) <= 255 for p, q in parts[k : k + 4]):
                        out.append(("ip", a, b))
        for m in CARD.finditer(text):
            digits = digits_of(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# -- characters and training sentences -------------------------------------------------

ALPHABET = "abcdefghijklmnopqrstuvwxyz !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n"
N_CLASSES = len(ALPHABET) + 3  # a digit, any other letter, anything else


@lru_cache(1)
def class_table() -> np.ndarray:
    table = np.full(0x10000, N_CLASSES - 1, np.int16)
    for code in range(128, 0x3000):
        if chr(code).isalpha():
            table[code] = N_CLASSES - 2
    for k, c in enumerate(ALPHABET):
        table[ord(c)] = table[ord(c.upper())] = k
    table[48:58] = N_CLASSES - 3
    return table


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return class_table()[np.minimum(codes, 0xFFFF)]


def training_sentence(rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A window of invented text with labelled spans and look-alikes that are none."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(pick(SYLLABLES) for _ in range(int(rng.integers(1, 4))))
    name = lambda: pick((word(), word() + pick("._-") + word(), word() + digits(2), digits(2)))
    host = lambda dot: dot.join([pick((word(), word() + digits(1))), *([word()] if rng.random() < 0.3 else []), pick(("com", "org", "net", "de", "fr", "es", "io"))])
    octets = lambda: [str(int(x)) for x in rng.integers(0, 256, 4)]

    def personal() -> tuple[str, str]:
        kind = pick(KINDS)
        if kind == "email":
            at, dot = pick((("@", "."), ("@", "."), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" at ", " dot "), (" @ ", " . "), ("[at]", "[dot]"), (" (at) ", ".")))
            return kind, name() + at + host(dot)
        if kind == "ip":
            return kind, pick((".", ".", "[.]", "(.)", " . ", " dot ", "[dot]")).join(octets())
        if kind == "card":
            sep, number = pick(("", " ", "-", ".", "/", "_", "  ", " - ")), digits(15)
            number += next(d for d in "0123456789" if luhn(number + d))
            return kind, sep.join(number[k : k + 4] for k in range(0, 16, 4))
        plus = pick(("+", "+", "00", "tel: ", ""))
        form = pick(("{a} ({b}) {c}-{d}", "{a} {b} {c} {d}", "{a}-{b}-{c}-{d}", "{a}.{b}.{c}.{d}", "{a} {b}/{c}{d}"))
        made = form.format(a=digits(int(rng.integers(1, 3))), b=digits(3), c=digits(3), d=digits(4))
        return kind, made if plus == "tel: " else plus + made

    def other() -> str:
        return pick((
            digits(int(rng.integers(1, 6))), digits(int(rng.integers(17, 40))), "".join(pick("0123456789abcdef") for _ in range(40)),
            "Version " + ".".join(digits(1) for _ in range(int(rng.integers(2, 4)))), digits(4) + "-" + digits(2) + "-" + digits(2),
            "@" + word(), word() + " @ " + word(), digits(3) + "." + digits(2), digits(2) + ":" + digits(2), word() + " at " + word(), "(at)", "dot",
            "token = \"" + "".join(pick("0123456789abcdef") for _ in range(16)) + "\"", "$" + digits(2) + "," + digits(3),
        ))

    text, spans = "", []
    while len(text) < WINDOW:
        roll = rng.random()
        if roll < 0.12:
            kind, value = personal()
            spans.append((kind, len(text), len(text) + len(value)))
            text += value
        else:
            text += other() if roll < 0.2 else word()
        text += pick((" ", " ", " ", " ", ", ", ". ", ".\n", "### ", "\n", " | ", "! "))
    shift = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
    cut = [(k, max(0, a - shift), min(WINDOW, b - shift)) for k, a, b in spans]
    return text[shift : shift + WINDOW], [s for s in cut if s[2] > s[1]]


SYLLABLES = ("the", "an", "er", "tion", "ou", "en", "eau", "ment", "ver", "lich", "keit", "que", "os", "mente", "ga", "la", "de", "in", "st", "é", "ü", "ñ", "jo", "smi", "mail", "exam", "ple", "at", "do")


def tags_of(spans: list[Span], n: int) -> np.ndarray:
    tags = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        tags[a:b], tags[a] = k + 1, k
    return tags


# -- the network ---------------------------------------------------------------------

Weights = dict[str, np.ndarray]


def initial(rng: np.random.Generator) -> Weights:
    normal = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
    w = {"out": normal(2 * HIDDEN, TAGS), "out_bias": np.zeros(TAGS, np.float32), "trans": normal(TAGS, TAGS)}
    for side in "fb":
        w[f"in_{side}"], w[f"rec_{side}"] = normal(N_CLASSES, 4 * HIDDEN), normal(HIDDEN, 4 * HIDDEN)
        w[f"in_{side}"][:, HIDDEN : 2 * HIDDEN] += 1  # gates that keep the state start open
    return w


def allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large negative score: I follows B or I of its kind."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for inside in range(2, TAGS, 2):
        out[:, inside] = -1e4
        out[inside - 1, inside] = out[inside, inside] = 0
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def lstm(x: np.ndarray, w: Weights, side: str, keep: bool = False):
    """Hidden states (time, batch, hidden) of one direction; ``x`` has classes by time and batch."""
    h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
    out, kept = np.empty((*x.shape, HIDDEN), np.float32), []
    gates_in = w[f"in_{side}"][x]
    for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
        a = gates_in[t] + h @ w[f"rec_{side}"]
        s = sigmoid(a[:, : 3 * HIDDEN])
        g = np.tanh(a[:, 3 * HIDDEN :])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        before, h_before = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            kept.append((t, i, f, o, g, before, tc, h_before))
    return out, kept


def lstm_back(x: np.ndarray, d_out: np.ndarray, kept: list, w: Weights, side: str, grads: Weights) -> None:
    d_h = d_c = np.zeros((x.shape[1], HIDDEN), np.float32)
    rec = w[f"rec_{side}"]
    d_rec, d_in = np.zeros_like(rec), np.zeros_like(w[f"in_{side}"])
    for t, i, f, o, g, before, tc, h_before in reversed(kept):
        d_h = d_h + d_out[t]
        d_c = d_c + d_h * o * (1 - tc * tc)
        d_a = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
        d_rec += h_before.T @ d_a
        np.add.at(d_in, x[t], d_a)
        d_c, d_h = d_c * f, d_a @ rec.T
    grads[f"rec_{side}"], grads[f"in_{side}"] = d_rec, d_in


def emissions(x: np.ndarray, w: Weights) -> np.ndarray:
    both = np.concatenate([lstm(x, w, "f")[0], lstm(x, w, "b")[0]], axis=2)
    return both @ w["out"] + w["out_bias"]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def crf_gradients(scores: np.ndarray, tags: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients of the negative log likelihood in scores and transitions, and its mean."""
    n, batch, _ = scores.shape
    ahead, behind = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = scores[0]
    for t in range(1, n):
        ahead[t] = scores[t] + _log_sum(ahead[t - 1][:, :, None] + trans, 1)
    for t in range(n - 2, -1, -1):
        behind[t] = _log_sum(trans + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
    total = _log_sum(ahead[-1], 1)
    d_scores = np.exp(ahead + behind - total[None, :, None])
    d_trans = np.zeros_like(trans)
    for t in range(1, n):
        d_trans += np.exp(ahead[t - 1][:, :, None] + trans + (scores[t] + behind[t])[:, None, :] - total[:, None, None]).sum(axis=0)
    rows = np.arange(batch)
    gold = np.zeros(batch)
    for t in range(n):
        d_scores[t, rows, tags[t]] -= 1
        gold += scores[t, rows, tags[t]]
        if t:
            np.add.at(d_trans, (tags[t - 1], tags[t]), -1)
            gold += trans[tags[t - 1], tags[t]]
    return d_scores / batch, d_trans / batch, float((total - gold).mean())


@lru_cache(1)
def trained() -> Weights:
    """The weights that :func:`train` made, from the file beside this module."""
    with np.load(io.BytesIO(pkgutil.get_data(__package__, WEIGHTS_FILE))) as kept:
        return {k: kept[k] for k in kept.files}


def train(batches: int = TRAIN_BATCHES) -> Weights:
    """Weights fitted with Adam on sentences of a fixed seed."""
    rng = np.random.default_rng(SEED)
    w, fixed = initial(rng), allowed()
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    for step in range(1, batches + 1):
        made = [training_sentence(rng) for _ in range(BATCH)]
        x = np.stack([classes(t) for t, _ in made], axis=1)
        tags = np.stack([tags_of(s, WINDOW) for _, s in made], axis=1)
        grads: Weights = {}
        ahead, kept_f = lstm(x, w, "f", True)
        back, kept_b = lstm(x, w, "b", True)
        both = np.concatenate([ahead, back], axis=2)
        d_scores, grads["trans"], _ = crf_gradients(both @ w["out"] + w["out_bias"], tags, w["trans"] + fixed)
        flat = d_scores.reshape(-1, TAGS)
        grads["out"], grads["out_bias"] = both.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)
        d_both = d_scores @ w["out"].T
        lstm_back(x, d_both[:, :, :HIDDEN], kept_f, w, "f", grads)
        lstm_back(x, d_both[:, :, HIDDEN:], kept_b, w, "b", grads)
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / batches) + 0.02)
        for k, g in grads.items():
            g = g * min(1.0, 5 / (size + 1e-9))
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.995 * v[k] + 0.005 * g * g
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
    return w


# -- decoding ------------------------------------------------------------------------


def triggers(text: str) -> Iterator[tuple[int, int]]:
    """Places that every span of a written form holds one of."""
    low = text.lower()
    if "@" in low or "at" in low:
        for m in AT_HOST.finditer(text):
            yield m.span()
    for m in NUMBER.finditer(text):
        parts = GROUPS.findall(m.group())
        if len(parts) >= 4 or sum(map(len, parts)) >= 9:
            yield m.span()


def stretches(text: str) -> list[tuple[int, int]]:
    """Stretches of text within ``MARGIN`` of a trigger, merged where they meet.

    One of more than ``STRETCH_CHARS`` is cut into parts that share twice the margin.
    """
    out: list[list[int]] = []
    for a, b in sorted(triggers(text)):
        a, b = max(0, a - MARGIN), min(len(text), b + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(x, min(b, x + STRETCH_CHARS)) for a, b in out for x in range(a, max(a + 1, b - 2 * MARGIN), STRETCH_CHARS - 2 * MARGIN)]


#: Weight of a window's score by its distance from the window's edges.
WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def joined_scores(texts: list[np.ndarray], parts: list[tuple[int, int, int]], w: Weights) -> list[np.ndarray]:
    """The scores of each part ``(text, start, end)``: those of the windows over it, averaged.

    Windows start at multiples of ``STEP`` and at minus ``STEP``, so what a place scores
    does not depend on the parts asked for.
    """
    places = [(k, s) for k, (_, a, b) in enumerate(parts) for s in range(a // STEP * STEP - STEP, b, STEP)]
    totals = [np.zeros((b - a, TAGS), np.float32) for _, a, b in parts]
    weights = [np.zeros((b - a, 1), np.float32) for _, a, b in parts]
    blank = ALPHABET.index(" ")
    for at in range(0, len(places), GROUP):
        group = places[at : at + GROUP]
        x = np.full((WINDOW, len(group)), blank, np.int16)
        for j, (k, s) in enumerate(group):
            piece = texts[parts[k][0]][max(0, s) : s + WINDOW]
            x[max(0, -s) : max(0, -s) + len(piece), j] = piece
        scores = emissions(x, w)
        for j, (k, s) in enumerate(group):
            _, a, b = parts[k]
            lo, hi = max(a, s), min(b, s + WINDOW)
            totals[k][lo - a : hi - a] += scores[lo - s : hi - s, j] * WEIGHT[lo - s : hi - s, None]
            weights[k][lo - a : hi - a] += WEIGHT[lo - s : hi - s, None]
    return [t / n for t, n in zip(totals, weights)]


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    best, back = scores[0] + np.where(np.arange(TAGS) % 2 == 0, np.where(np.arange(TAGS) == 0, 0, -1e4), 0), np.empty((len(scores), TAGS), np.int8)
    for t in range(1, len(scores)):
        moves = best[:, None] + trans
        back[t] = moves.argmax(axis=0)
        best = moves.max(axis=0) + scores[t]
    tags = np.empty(len(scores), np.int64)
    tags[-1] = best.argmax()
    for t in range(len(scores) - 1, 0, -1):
        tags[t - 1] = back[t, tags[t]]
    return tags


def plausible(kind: str, text: str) -> bool:
    """Whether a text of a kind's form can be what it says."""
    digits = digits_of(text)
    if kind == "email":
        return any(c.isalpha() for c in text)
    if kind == "ip":
        return all(int(p) <= 255 for p in GROUPS.findall(text))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(GROUPS.findall(text)) >= 3


def marked(text: str, spans: list[Span]) -> bytearray:
    """Which characters of a text spans hold."""
    mask = bytearray(len(text))
    for _, a, b in spans:
        mask[a:b] = b"\1" * (b - a)
    return mask


def added_spans(text: str, at: int, tags: np.ndarray, taken: bytearray) -> list[Span]:
    """Plausible spans of a decoded stretch that touch no character taken before; theirs are taken then.

    A decoded span takes the edges of a text of its kind's form: for numbers those of the
    groups of digits that it touches, else those of a form that it covers half of or that
    covers half of it.
    """
    out: list[Span] = []
    for s in np.flatnonzero(tags % 2 == 1).tolist():
        end = s + 1
        while end < len(tags) and tags[end] == tags[s] + 1:
            end += 1
        kind, a, b = KINDS[(int(tags[s]) - 1) // 2], at + s, at + end
        for x, y in written(kind, text, a, b):
            both = min(b, y) - max(a, x)
            if both > 0 and 2 * both >= min(b - a, y - x) and plausible(kind, text[x:y]) and taken.find(1, x, y) < 0:
                out.append((kind, x, y))
                taken[x:y] = b"\1" * (y - x)
                break
    return out


def unbroken(text: str, a: int, b: int) -> tuple[int, int]:
    """Edges moved out to where no word or number goes over them."""
    while a > 0 and PART.match(text[a - 1]):
        a -= 1
    while b < len(text) and PART.match(text[b]):
        b += 1
    return a, b


def written(kind: str, text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Edges of the forms of a kind at a decoded span."""
    if kind in ("email", "ip"):
        for m in FORMS[kind].finditer(text, *unbroken(text, max(0, a - MARGIN), b + MARGIN)):
            yield m.span()
        return
    groups = [m.span() for m in GROUPS.finditer(text, *unbroken(text, max(0, a - MARGIN), b + MARGIN))]
    groups = [(x, y) for x, y in groups if min(b, y) - max(a, x) > 0]
    if groups:
        x, y = groups[0][0], groups[-1][1]
        while x > a and text[x - 1] in "+(":
            x -= 1
        if FORMS[kind].fullmatch(text, x, y):
            yield x, y


def find_all(texts: list[str], w: Weights, whole: bool = False) -> Iterator[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text; ``whole`` has the network read all of it."""
    trans = w["trans"] + allowed()
    for held in _in_groups(texts):
        base = [base_spans(t) for t in held]
        parts = [(k, a, b) for k, t in enumerate(held) for a, b in ([(0, len(t))] if whole and t else stretches(t))]
        wanted = {k for k, _, _ in parts}
        coded = [classes(t) if k in wanted else None for k, t in enumerate(held)]
        found: dict[int, list[Span]] = {}
        taken = {k: marked(held[k], base[k]) for k in wanted}
        for lo in range(0, len(parts), 256):
            some = parts[lo : lo + 256]
            for (k, a, _), scores in zip(some, joined_scores(coded, some, w)):
                found.setdefault(k, []).extend(added_spans(held[k], a, viterbi(scores, trans), taken[k]))
        for k, spans in enumerate(base):
            yield spans, sorted(spans + found.get(k, []), key=lambda s: (s[1], KINDS.index(s[0])))


def _in_groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts in lists of about ``GROUP_CHARS`` characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > GROUP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def told(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


FOUND = "doc_id long, base string, spans string, n_email long, n_ip long, n_card long, n_phone long"


def find_pii(docs: DataFrame, weights: Weights | None = None, whole: bool = False) -> DataFrame:
    """``(doc_id, base, spans, n_email, n_ip, n_card, n_phone)`` for each row of ``docs``.

    ``base`` and ``spans`` list kind:start:end in code points, comma-joined; counts are
    those of the base spans.  Null and empty texts have none.  ``whole`` has the network
    read all text, also where no span can be.
    """
    w = weights or trained()
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, (base, spans) in zip(batch.column(0).to_pylist(), find_all(texts, w, whole)):
                counts = [sum(s[0] == kind for s in base) for kind in KINDS]
                out.append((doc_id, told(base), told(spans), *counts))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def mask_text(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans are one."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` masked; null texts stay null, other columns as they are."""
    w = weights or trained()
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            spans = find_all([t or "" for t in texts], w)
            masked = [None if t is None else mask_text(t, all_) for t, (_, all_) in zip(texts, spans)]
            columns = list(batch.columns)
            columns[place] = pa.array(masked, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


if __name__ == "__main__":
    np.savez_compressed(Path(__file__).with_name(WEIGHTS_FILE), **train())
