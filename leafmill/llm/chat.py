r"""Chat formatting (operator 8): final messages from an event log, rendered with a loss mask and read back.

Events of a conversation, in the order of their sequence numbers:
  open   starts message `slot` with a role and, it may be, a first text
  delta  appends text to message `slot`
  edit   replaces the text of message `slot` and drops every later message
  redo   empties message `slot` (a regeneration) and drops every later message; deltas follow
Events of any other kind, or of none, say nothing about messages and change nothing.

Template: a turn is `<|turn|>role\n` text `<|end|>\n`. Backslashes and line ends in roles become `\\` and `\n`. In roles and texts `<|` becomes `<\|` and a
backslash run between `<` and `|` gains one backslash, which reading takes away again; so no text can
make a control string, and every text comes back as it was.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import small_batches

OPEN, END = "<|turn|>", "<|end|>"
_ESC, _UNESC = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESC.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESC.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def fold(events: list[tuple]) -> list[list]:
    """Final [role, text] messages from (kind, slot, role, text) events in order."""
    at: dict[int, int] = {}
    out: list[list] = []
    for kind, slot, role, text in events:
        text = text or ""
        if kind == "open":
            if slot in at:  # opened twice: as a redo with a role of its own
                del out[at[slot] :]
            at[slot] = len(out)
            out.append([role or "", [text], slot])
        elif slot not in at or at[slot] >= len(out) or out[at[slot]][2] != slot:
            continue  # of a message that doesn't stand any more
        elif kind == "delta":
            out[at[slot]][1].append(text)
        elif kind in ("edit", "redo"):
            out[at[slot]][1] = [text] if kind == "edit" else []
            del out[at[slot] + 1 :]
    return [[role, "".join(parts)] for role, parts, _ in out]


def render(messages: list[list], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans under the loss mask): the escaped text of each message of role `learn`."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Messages of a formatted text."""
    out = []
    for part in formatted.split(OPEN)[1:]:
        head, _, body = part.partition("\n")
        out.append((unescape_role(head), unescape(body[: -len(END) - 1])))
    return out


def as_events(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece: int = 512) -> DataFrame:
    """A conversation table as a log: an `open` event for each row, then its text in deltas of `piece` characters.

    Every row is a message of its own, with its number in its conversation as slot: rows stand in the order of
    turn, role and text, nulls first. So rows that share a turn, repeated rows and null turns all stay.
    """
    text = F.coalesce(turns[text_col].cast("string"), F.lit(""))
    base = turns.select(turns[conv_col].alias("conv_id"), turns[turn_col].cast("long").alias("turn"), turns[role_col].cast("string").alias("role"), text.alias("text"))
    base = base.withColumn("slot", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    n = F.ceil(F.length("text") / F.lit(piece)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(
        i.alias("k"), F.when(i == 0, "open").otherwise("delta").alias("kind"),
        F.when(i == 0, "").otherwise(F.substring(F.col("text"), (i - 1) * piece + 1, F.lit(piece))).alias("part")))
    return base.select("conv_id", "slot", "role", F.explode(parts).alias("p")).select("conv_id", F.struct("slot", "p.k").alias("seq"), F.col("p.kind").alias("kind"), "slot", "role", F.col("p.part").alias("text"))


def chat(events: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, spans (loss mask: begin and end in code points), read_roles, read_texts from a log.

    Columns: conv_id, seq (any sortable value), kind, slot, role, text. A conversation is partitioned by its
    id and sorted by seq; ties are folded in the order of kind, slot, role and text ("open" is put first),
    repeated events act twice, null texts and roles are empty, a null slot is a slot like any other, unknown
    kinds are passed over. All rows without a conv_id are one conversation, whose id is null. An empty log gives no rows.
    Ids keep their type and value, whatever nulls stand beside them. A task holds one conversation at a time.
    """
    small_batches(events.sparkSession, 2000)
    kind = events.schema["conv_id"].dataType.simpleString()
    # deltas of one turn are sorted by the executors' own spilling sort, not in Python
    rows = events.select("conv_id", "seq", "kind", "slot", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "seq", F.when(F.col("kind") == "open", 0).otherwise(1), "kind", "slot", "role", "text").select("conv_id", "kind", "slot", "role", "text")

    def run(batches):
        now, held, first, typed = None, [], True, None

        def table(done):
            texts = [render(fold(events), learn) for _, events in done]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], typed), pa.array([t for t, _ in texts], pa.string()), pa.array([[list(x) for x in spans] for _, spans in texts], pa.list_(pa.list_(pa.int64())))], ["conv_id", "formatted", "spans"])

        for b in batches:
            typed, done = b.schema.field(0).type, []
            for conv, *event in zip(*(c.to_pylist() for c in b.columns)):
                if first or conv != now:
                    if not first:
                        done.append((now, held))
                    now, held, first = conv, [], False
                held.append(tuple(event))
            if done:
                yield table(done)
        if not first:
            yield table([(now, held)])

    return rows.mapInArrow(run, f"conv_id {kind}, formatted string, spans array<array<long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns, text under the loss mask, and their hashes."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def sha(text):
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = read_back(text)
                learned = "".join(unescape(text[i:j]) for i, j in spans)
                out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(text)))
            made = [pa.array([r[k] for r in out], pa.string() if k in (1, 3) else pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
