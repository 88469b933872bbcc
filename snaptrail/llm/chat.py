"""Chat formatting with typed content parts.

A turn is a role and a list of parts (text, image, audio, document). A visitor flattens the parts in order: text is
escaped, every attachment becomes a numbered placeholder, and its reference and expanded token count are recorded.

Template of one turn: ``<|im_start|>ROLE\\nCONTENT<|im_end|>\\n``. Inside roles and texts a backslash is doubled and
``<|`` becomes ``<\\|``, also where it is made of two parts, so no text can hold a control string; in roles a line break becomes ``\\n`` spelled out. Both
are undone exactly when the output is read back.

Defined results: null text, role, parts or part type count as empty; an unknown part type keeps its text only; turns
with equal numbers are ordered by role, then formatted text; repeated rows stay repeated turns; a null conversation id
is a conversation of its own; an empty table gives an empty result; other columns are ignored.

A conversation is never held in memory: its turns are formatted one by one where they lie, and the reader streams them
in order through running digests. A digest over one conversation is a chain, so one task reads it, at a fixed size.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN_TYPE = (
    "conv_id long, turn long, role string, formatted string, loss_start int, loss_end int, n_tokens_expanded long, "
    "attachments array<struct<number:int,type:string,ref:string,position:int,tokens:long>>"
)
READ_TYPE = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_attachments long, expanded_tokens long"
)
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(START) + r"(?P<role>[^\n]*)\n(?P<content>.*)" + re.escape(END) + r"\n\Z", re.S)
_PLACEHOLDER = re.compile(r"<\|(?:image|audio|document):\d+\|>")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


class PartVisitor:
    """Flattens the parts of one turn; ``visit_<type>`` handles a type."""

    tile, tokens_a_tile, audio_tokens_a_second, tokens_a_page = 336, 144, 25, 600

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.attachments: list[dict] = []
        self.length = 0

    def add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        text = escape(part.get("text") or "")
        # text parts follow each other without a mark, so "<" and "|" of two of them meet
        if text.startswith("|") and self.pieces and self.pieces[-1].endswith("<"):
            text = "\\" + text
        if text:
            self.add(text)

    def attach(self, part: dict, tokens: int) -> None:
        number = len(self.attachments)
        self.attachments.append({"number": number, "type": part["type"], "ref": part.get("ref"), "position": self.length, "tokens": tokens})
        self.add(f"<|{part['type']}:{number}|>")

    def visit_image(self, part: dict) -> None:
        across, down = (max(1, math.ceil(size_of(part, side) / self.tile)) for side in ("width", "height"))
        self.attach(part, across * down * self.tokens_a_tile)

    def visit_audio(self, part: dict) -> None:
        self.attach(part, max(1, math.ceil(size_of(part, "seconds") * self.audio_tokens_a_second)))

    def visit_document(self, part: dict) -> None:
        self.attach(part, max(1, int(size_of(part, "pages"))) * self.tokens_a_page)


def size_of(part: dict, key: str) -> float:
    """A size, 0 where it is missing."""
    value = part.get(key)
    return 0 if value is None or value != value else value


def format_turns(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, parts) -> one formatted row a turn; no shuffle.

    ``loss_start``/``loss_end`` are code points inside ``formatted``: the content of a trained turn, empty for others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv, turn, role, parts in zip(batch["conv_id"], batch["turn"], batch["role"], batch["parts"], strict=True):
                visitor = PartVisitor()
                for part in () if parts is None else parts:
                    if part is not None:
                        visitor.visit(part)
                role = role or ""
                head = START + escape(role).replace("\n", "\\n") + "\n"
                content = "".join(visitor.pieces)
                end = len(head) + (len(content) if role == trained_role else 0)
                for a in visitor.attachments:
                    a["position"] += len(head)
                out.append((conv, turn, role, f"{head}{content}{END}\n", len(head), end, sum(a["tokens"] for a in visitor.attachments), visitor.attachments))
            yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "n_tokens_expanded", "attachments"]).astype({"conv_id": "Int64", "turn": "Int64"})

    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("parts").cast(f"array<{PART_TYPE}>").alias("parts")).mapInPandas(run, TURN_TYPE)


def ordered(formatted: DataFrame) -> DataFrame:
    """The output in reading order: each conversation in one partition, its turns in order (sorting spills to disk)."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")


def read_turn(formatted: str, loss_start: int, loss_end: int) -> tuple[str, str, str]:
    """Role, text and trained text of one formatted turn, unescaped."""
    m = _TURN.match(formatted)
    if m is None:
        raise ValueError("not a formatted turn")
    plain = _PLACEHOLDER.sub("", m["content"]) if "<|" in m["content"] else m["content"]
    masked = formatted[loss_start:loss_end]
    return unescape(m["role"]), unescape(plain), unescape(_PLACEHOLDER.sub("", masked) if "<|" in masked else masked)


def read_back(in_order: DataFrame) -> DataFrame:
    """Digests per conversation, read from the output of ``ordered`` in a stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: object = run  # no conversation yet
        state: list = []

        def row() -> list:
            return [None if current is None else int(current), state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]]

        for batch in batches:
            done = []
            for conv, text, a, b, tokens, attached in zip(batch["conv_id"], batch["formatted"], batch["loss_start"], batch["loss_end"], batch["n_tokens_expanded"], batch["n_attachments"], strict=True):
                conv = None if pd.isna(conv) else conv
                if current is run or conv != current:
                    if current is not run:
                        done.append(row())
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, content, trained = read_turn(text, a, b)
                state[0] += 1
                state[1].update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(trained)
                state[3].update(trained.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += int(attached)
                state[6] += int(tokens)
            if done:
                yield frame(done)
        if current is not run:
            yield frame([row()])

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]).astype({"conv_id": "Int64"})

    return in_order.select("conv_id", "formatted", "loss_start", "loss_end", "n_tokens_expanded", F.coalesce(F.size("attachments"), F.lit(0)).alias("n_attachments")).mapInPandas(run, READ_TYPE)


def text_parts(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows as turns of one text part; null text is empty."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))
