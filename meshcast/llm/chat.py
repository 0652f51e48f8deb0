"""Chat formatting by a finite-state machine over roles and a declarative template.

Control strings inside texts and role names get a backslash after their first character and backslashes are doubled, so the
formatted text can be read back without loss.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INPUT = "conv_id long, turn long, role string, text string"


@dataclass(frozen=True)
class Template:
    """parts: role -> (before, after, loss); other roles use `other`, whose `before` names the role. order: state -> allowed next roles."""

    parts: dict = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>", False),
            "user": ("[INST]", "[/INST]", False),
            "assistant": ("<s>", "</s>", True),
        }
    )
    other: tuple = ("<|role|>", "<|text|>", "<|end|>", False)
    order: dict = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple = ("assistant",)

    def controls(self) -> list[str]:
        return sorted({c for b, a, _ in self.parts.values() for c in (b, a)} | set(self.other[:3]), key=lambda c: (-len(c), c))


def escaped(text: str, controls) -> str:
    text = text.replace("\\", "\\\\")
    for c in controls:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


_BACK = re.compile(r"\\(.)", re.S)


def unescaped(text: str) -> str:
    # A doubled backslash is one; the backslash after a control string's first character goes.
    return _BACK.sub(lambda m: m[1], text)


def segments(turns, template: Template):
    """(role, text, loss) segments of one conversation; loss is set on exactly the escaped texts of the roles that are learnt."""
    controls = template.controls()
    for role, text in turns:
        if role in template.parts:
            before, after, loss = template.parts[role]
            yield before, False
        else:
            yield template.other[0] + escaped(role, controls) + template.other[1], False
            after, loss = template.other[2], template.other[3]
        yield escaped(text, controls), loss
        yield after, False


def first_error(roles, template: Template) -> int:
    """Position of the first turn that the machine does not allow; the number of turns if it ends in no final state; -1 if all is well."""
    state = "start"
    for i, role in enumerate(roles):
        if role not in template.order.get(state, ()):
            return i
        state = role
    return -1 if state in template.final else len(roles)


def parsed(formatted: str, template: Template) -> list[tuple[str, str, bool]]:
    """Read (role, text, loss) turns back from a formatted text."""
    starts = {b: (role, a, loss) for role, (b, a, loss) in template.parts.items()}
    pattern = re.compile("|".join(re.escape(c) for c in [*starts, template.other[0]]))
    out, at = [], 0
    while at < len(formatted):
        m = pattern.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn starts at {at}")
        at = m.end()
        if m[0] == template.other[0]:
            end = formatted.index(template.other[1], at)
            role, at = unescaped(formatted[at:end]), end + len(template.other[1])
            after, loss = template.other[2], template.other[3]
        else:
            role, after, loss = starts[m[0]]
        end = formatted.index(after, at)
        out.append((role, unescaped(formatted[at:end]), loss))
        at = end + len(after)
    return out


FORMATTED = "conv_id long, turn long, segments array<struct<text:string,loss:boolean>>"
SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def _format(template: Template):
    def run(batches):
        for batch in batches:
            rows = zip(batch.column("role"), batch.column("text"))
            parts = [[{"text": t, "loss": f} for t, f in segments([(role.as_py() or "", text.as_py() or "")], template)] for role, text in rows]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(parts, SEGMENTS)], ["conv_id", "turn", "segments"])

    return run


def formatted_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per turn of `turns` (conv_id, turn, role, text): the segments of its formatted text with their loss flags.

    The formatted text of a conversation is that of its turns, ordered by turn, then role and text as read back. Null roles and texts
    are empty strings, repeated rows are turns of their own, rows of a null conv_id form one conversation. Each row is formatted by
    itself, so no conversation is held or shuffled; `read_back` says which conversations the machine rejects.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(_format(template), FORMATTED)


PARSED = "conv_id long, turn long, role string, text string, learnt string, chars long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_error long"


def _parse(template: Template):
    """Each formatted turn read back; learnt: what its loss flags mark, null where that is its text."""

    def run(batches):
        for batch in batches:
            out = {"role": [], "text": [], "learnt": [], "chars": []}
            for segs in batch.column("segments"):
                segs = segs.as_py()
                formatted = "".join(s["text"] for s in segs)
                ((role, text, _),) = parsed(formatted, template)
                learnt = "".join(unescaped(s["text"]) for s in segs if s["loss"])
                for name, value in (("role", role), ("text", text), ("learnt", None if learnt == text else learnt), ("chars", len(formatted))):
                    out[name].append(value)
            columns = [batch.column("conv_id"), batch.column("turn"), *(pa.array(out[n], pa.string()) for n in ("role", "text", "learnt")), pa.array(out["chars"], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", *out])

    return run


class _Digest:
    """Running hashes, sums and machine state of one conversation; none of its turns is kept."""

    def __init__(self, conv):
        self.conv, self.n, self.chars, self.loss_chars, self.state, self.error = conv, 0, 0, 0, "start", None
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, learnt: str, chars: int, template: Template) -> None:
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.loss.update(learnt.encode("utf-8", "surrogatepass"))
        if self.error is None and role not in template.order.get(self.state, ()):
            self.error = self.n
        self.state = role
        self.n, self.chars, self.loss_chars = self.n + 1, self.chars + chars, self.loss_chars + len(learnt)

    def row(self, template: Template) -> tuple:
        error = self.n if self.error is None and self.state not in template.final else self.error
        return self.conv, self.n, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, error is None, error


def _digest(template: Template):
    names = [c.split()[0] for c in DIGEST.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in DIGEST.split(", ")]

    def written(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        held, rows = None, []
        for batch in batches:
            for conv, role, text, learnt, chars in zip(*(batch.column(n) for n in ("conv_id", "role", "text", "learnt", "chars"))):
                conv, text, learnt = conv.as_py(), text.as_py(), learnt.as_py()
                if held is None or held.conv != conv:
                    if held is not None:
                        rows.append(held.row(template))
                    held = _Digest(conv)
                held.add(role.as_py(), text, text if learnt is None else learnt, chars.as_py(), template)
            if len(rows) >= 10_000:
                yield written(rows)
                rows = []
        if held is not None:
            yield written([*rows, held.row(template)])

    return run


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: digests of what its formatted turns hold, by parsing them and by their loss flags, and valid and
    first_error from the machine. A conversation that the machine rejects is digested all the same and marked.

    Turns are parsed where they lie. A hash needs them in order, so those of one conversation pass through one task; they are sorted
    on disk and streamed, and only hashes, sums and the machine's state are held.
    """
    rows = formatted.mapInArrow(_parse(template), PARSED)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_digest(template), DIGEST)
