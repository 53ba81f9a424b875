"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the
context, and its text alone is under the loss mask.  Turns after a conversation's
last assistant turn are kept as a rest that trains nothing.

Turn: ``<s>[INST] role`` newline text ``[/INST]</s>`` newline.  Inside texts and roles
a backslash is doubled and a control string gets a backslash after its first
character, so no text can close or open a turn, and reading undoes it exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", "\n", " [/INST]</s>\n"
CONTROL = re.compile(r"<(?=/?s>)|\[(?=/?INST\])")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(re.escape(OPEN) + r"(.*?)" + MIDDLE + r"(.*?)" + re.escape(CLOSE), re.DOTALL)
EXAMPLES = "conv_id long, example long, is_last boolean, context string, reply string, closing string"
#: Characters after which a task hands over the examples it holds.
FLUSH_CHARS = 8 << 20


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m.group() + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def escape_role(role: str) -> str:
    """A role is one line, so its line ends become an escaped n."""
    return escape(role).replace("\n", "\\n")


def _by_conversation(turns: DataFrame) -> DataFrame:
    return turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def expand(turns: DataFrame) -> DataFrame:
    """``(conv_id, example, is_last, context, reply, closing)``: one row per assistant turn.

    The example's text is context, reply and closing in a row; only ``reply`` is
    trained on, and ``example`` counts from 0.  A rest without an assistant turn has a
    null reply.  ``is_last`` marks the row whose text holds the whole conversation.
    Turns go by ``turn``, nulls first, then role and text; null roles and texts count
    as empty, and null conv_ids form one conversation.  A task streams through sorted
    rows and holds one conversation's prefix, never a group of rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        held = 0
        conv, prefix, pending, n, waiting = object(), "", 0, 0, None

        def frame() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=[c.split()[0] for c in EXAMPLES.split(", ")])
            return made.astype({"conv_id": "Int64", "example": "int64", "is_last": "bool"})

        def ended() -> None:
            if waiting is not None and not pending:
                out.append((*waiting[:2], True, *waiting[3:]))
                return
            if waiting is not None:
                out.append(waiting)
            if pending:
                out.append((conv, n, True, prefix, None, ""))

        for f in frames:
            for key, role, text in zip(f["conv_id"].astype("Int64").tolist(), f["role"], f["text"]):
                key = None if key is pd.NA else key
                if key != conv:
                    ended()
                    conv, prefix, pending, n, waiting = key, "", 0, 0, None
                head = OPEN + escape_role(role) + MIDDLE
                body = escape(text)
                if role == "assistant":
                    if waiting is not None:
                        out.append(waiting)
                        held += len(waiting[3])
                    waiting = (key, n, False, prefix + head, body, CLOSE)
                    n, pending = n + 1, 0
                else:
                    pending += 1
                prefix += head + body + CLOSE
                if held > FLUSH_CHARS:
                    yield frame()
                    out, held = [], 0
        ended()
        if out:
            yield frame()

    return _by_conversation(turns).mapInPandas(run, EXAMPLES)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(examples: DataFrame) -> DataFrame:
    """One row per conversation of what its written examples hold.

    Turns are parsed from the row that holds the whole conversation, the text under
    the loss mask from every example's reply; ``formatted_chars`` counts all of them.
    """
    slim = examples.select(
        "conv_id", "example", "is_last", "reply",
        F.when(F.col("is_last"), F.concat("context", F.coalesce("reply", F.lit("")), "closing")).alias("whole"),
        (F.char_length("context") + F.coalesce(F.char_length("reply"), F.lit(0)) + F.char_length("closing")).alias("chars"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "example")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        hashed, loss, total = hashlib.sha256(), 0, 0
        for f in frames:
            rows = []
            for key, last, reply, whole, chars in zip(f["conv_id"].astype("Int64").tolist(), f["is_last"], f["reply"], f["whole"], f["chars"]):
                total += int(chars)
                if reply is not None:
                    plain = unescape(reply)
                    hashed.update(plain.encode())
                    loss += len(plain)
                if last:
                    turns = read_turns(whole)
                    told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    rows.append((None if key is pd.NA else key, len(turns), told, loss, hashed.hexdigest(), total))
                    hashed, loss, total = hashlib.sha256(), 0, 0
            yield pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})

    return slim.mapInPandas(run, DIGESTS)
