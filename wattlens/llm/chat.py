"""Chat formatting: a role state machine and a declarative template give text segments with loss flags.

Defined results: a null text or role counts as empty; rows with equal ``turn`` are ordered by
role, then text; repeated rows are turns of their own; null ``conv_id`` rows form one conversation;
a null ``turn`` sorts first. An empty table gives no rows; other columns are ignored.
Conversations with a wrong turn order are formatted all the same and marked.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id long, seq long, role string, segments array<struct<text: string, loss: boolean>>, order_ok boolean, may_end boolean"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
    " formatted_chars long, valid boolean"
)


@dataclass(frozen=True)
class Template:
    """What surrounds a turn, which roles are trained on, and which role may follow which."""

    open: str = "### "
    named: str = ": "
    close: str = " </turn>\n"
    escape: str = "\\"
    trained: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user", "tool"}),
            "tool": frozenset({"assistant"}),
        }
    )
    final: frozenset[str] = frozenset({"assistant"})

    def _controls(self) -> re.Pattern[str]:
        marks = {self.escape, self.open.strip(), self.named.strip(), self.close.strip()}
        return re.compile("|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True)))

    def escaper(self):
        """A function that puts the escape character before every control string of a text."""
        controls, sign = self._controls(), self.escape
        return lambda text: controls.sub(lambda found: sign + found.group(), text)

    def unescape(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.DOTALL)


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per turn with its text segments, in order; their concatenation is the formatted text.

    Turns of a conversation meet in one task, sorted, and stream through it in
    batches, so a very long conversation needs no more memory than a short one.
    """
    template = template or Template()

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        escape = template.escaper()
        current, state, seq, good = (), "", 0, True
        for batch in batches:
            rows = []
            for conv, role, text in zip(batch["conv"], batch["role"], batch["text"], strict=True):
                if conv != current:
                    current, state, seq, good = conv, "", 0, True
                good = good and role in template.follows.get(state, frozenset())
                state = role
                rows.append(
                    (
                        int(conv) if conv else None,
                        seq,
                        role,
                        [
                            {"text": template.open + escape(role) + template.named, "loss": False},
                            {"text": escape(text), "loss": role in template.trained},
                            {"text": template.close, "loss": False},
                        ],
                        good,
                        good and role in template.final,
                    )
                )
                seq += 1
            yield pd.DataFrame(rows, columns=["conv_id", "seq", "role", "segments", "order_ok", "may_end"]).astype(
                {"conv_id": "Int64"}
            )

    ordered = (
        turns.select(
            F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .repartition("conv")
        .sortWithinPartitions("conv", "turn", "role", "text")
        .select("conv", "role", "text")
    )
    return ordered.mapInPandas(emit, SEGMENTS)


class Reader:
    """Reads formatted text back, segment by segment."""

    def __init__(self, template: Template):
        self.template = template
        sign = re.escape(template.escape)
        self.named = re.compile(rf"{sign}.|({re.escape(template.named)})", re.DOTALL)
        self.close = re.compile(rf"{sign}.|({re.escape(template.close)})", re.DOTALL)

    @staticmethod
    def _until(pattern: re.Pattern[str], text: str, start: int) -> re.Match[str] | None:
        return next((m for m in pattern.finditer(text, start) if m.group(1)), None)

    def turns(self, text: str) -> tuple[list[tuple[str, str]], str]:
        """The complete (role, text) turns at the start of ``text`` and what is left over."""
        found, at = [], 0
        while text.startswith(self.template.open, at):
            named = self._until(self.named, text, at + len(self.template.open))
            close = named and self._until(self.close, text, named.end())
            if not close:
                break
            role, body = text[at + len(self.template.open) : named.start()], text[named.end() : close.start()]
            found.append((self.template.unescape(role), self.template.unescape(body)))
            at = close.end()
        return found, text[at:]


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests per conversation, taken from formatted segments alone.

    ``segments`` must come straight from ``format_conversations``, still in its order.
    """
    template = template or Template()

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(template)
        state = None

        def result():
            if state["left"]:
                raise ValueError("formatted text ends inside a turn")
            return (
                state["conv"],
                state["n"],
                state["turns"].hexdigest(),
                state["loss_chars"],
                state["loss"].hexdigest(),
                state["chars"],
                state["valid"],
            )

        for batch in batches:
            done = []
            for conv, seq, parts, may_end in zip(
                batch["conv_id"], batch["seq"], batch["segments"], batch["may_end"], strict=True
            ):
                if seq == 0:
                    if state:
                        done.append(result())
                    state = {"conv": None if pd.isna(conv) else int(conv), "n": 0, "loss_chars": 0, "chars": 0, "left": ""}
                    state |= {"turns": hashlib.sha256(), "loss": hashlib.sha256()}
                read, state["left"] = reader.turns(state["left"] + "".join(p["text"] for p in parts))
                for role, text in read:
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                for part in parts:
                    state["chars"] += len(part["text"])
                    if part["loss"]:
                        plain = template.unescape(part["text"])
                        state["loss_chars"] += len(plain)
                        state["loss"].update(plain.encode())
                state["valid"] = bool(may_end)
            yield _digests(done)
        if state:
            yield _digests([result()])

    return segments.mapInPandas(digest, DIGESTS)


def _digests(rows: list[tuple]) -> pd.DataFrame:
    columns = [c.split()[0] for c in DIGESTS.split(", ")]
    return pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64", "n_turns": "int64"})
