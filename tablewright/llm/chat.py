"""Chat formatting of typed content parts.

A turn's content is a list of parts. A visitor flattens them in order: text is escaped, image, audio and
document parts become placeholders whose reference and expanded token count are recorded. Control strings
inside texts are escaped by a character that is itself escaped, so the output can be read back exactly. Where two
text parts meet, an escaped border keeps them apart, so no control string arises from their ends.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template. OPEN, ROLE_END and CLOSE never occur inside an escaped text.
OPEN, ROLE_END, CLOSE, PART, PART_END = "<|turn|>", "<|says|>", "<|end|>", "<|part:", "|>"
_ESCAPE = "\\"
_BORDER = _ESCAPE + "p"
_SPECIAL = re.compile(r"<\||\\|</?s>|\[/?INST\]|<</?SYS>>")


def escape(text: str) -> str:
    """Every control string, and every backslash, gets a form without the string itself: its characters apart."""
    return _SPECIAL.sub(lambda m: _ESCAPE + "b" if m[0] == _ESCAPE else _ESCAPE + "c" + (_ESCAPE + "j").join(m[0]) + _ESCAPE + "e", text)


def text_parts(text: str) -> list[str]:
    """The text parts that an escaped run of them stands for."""
    parts, out, i = [], [], 0
    while (j := text.find(_ESCAPE, i)) >= 0:
        out.append(text[i:j])
        if text[j + 1] == "b":
            out.append(_ESCAPE)
        elif text[j + 1] == "p":
            parts.append("".join(out))
            out = []
        i = j + 2
    return [*parts, "".join(out) + text[i:]]


def unescape(text: str) -> str:
    return "".join(text_parts(text))


@dataclass
class Formatted:
    """``spans``: role, start and end of each turn's content; ``mask``: spans the loss sees; ``refs``: attachments."""

    text: str = ""
    spans: list[tuple[str, int, int]] = field(default_factory=list)
    mask: list[tuple[int, int]] = field(default_factory=list)
    refs: list[tuple[int, str, str, int]] = field(default_factory=list)


class PartVisitor:
    """Parts are mappings with ``type`` (none: text); sizes decide how many tokens a placeholder stands for.

    A size that is absent, no number or not above 0 counts as the least one (no seconds are no tokens). A part of
    another type is a placeholder of kind ``other`` without tokens, so nothing is lost and no job ends by it.
    """

    patch, patches_a_row, audio_rate, page_tokens = 14, 2, 25, 256
    most = (1 << 31) - 1

    def visit(self, part: dict, refs: list) -> str:
        return getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part, refs)

    def visit_text(self, part: dict, refs: list) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict, refs: list) -> str:
        side = self.patch * self.patches_a_row
        return self._placeholder("image", part, math.ceil(self._size(part, "width", side) / side) * math.ceil(self._size(part, "height", side) / side), refs)

    def visit_audio(self, part: dict, refs: list) -> str:
        return self._placeholder("audio", part, math.ceil(self._size(part, "seconds", 0) * self.audio_rate), refs)

    def visit_document(self, part: dict, refs: list) -> str:
        return self._placeholder("document", part, math.ceil(self._size(part, "pages", 1)) * self.page_tokens, refs)

    def visit_other(self, part: dict, refs: list) -> str:
        return self._placeholder("other", part, 0, refs)

    def _size(self, part: dict, name: str, least: float) -> float:
        try:
            found = float(part.get(name) or 0)
        except (TypeError, ValueError):
            return least
        return min(found, self.most) if found > 0 else least

    def _placeholder(self, kind: str, part: dict, tokens: int, refs: list) -> str:
        tokens = min(tokens, self.most)
        refs.append((len(refs), kind, str(part.get("ref") or ""), tokens))
        return f"{PART}{kind}:{len(refs) - 1}:{tokens}{PART_END}"


def format_turn(role: str, parts: list[dict], visitor: PartVisitor | None = None, learn: frozenset[str] = frozenset({"assistant"})) -> Formatted:
    """One turn; a conversation's text is its turns' texts in a row. The mask spans its runs of text parts, no placeholder."""
    visitor, out = visitor or PartVisitor(), Formatted()
    head = OPEN + escape(role) + ROLE_END
    said, before, at, runs = [], None, len(head), []
    for part in parts:
        kind = part.get("type") or "text"
        piece = _BORDER * (kind == before == "text") + visitor.visit(part, out.refs)
        if kind == "text":
            runs = [*runs[:-1], (runs[-1][0], at + len(piece))] if before == "text" else [*runs, (at, at + len(piece))]
        said.append(piece)
        before, at = kind, at + len(piece)
    body = "".join(said)
    out.text = head + body + CLOSE
    out.spans = [(role, len(head), len(head) + len(body))]
    out.mask = (runs or [(len(head), len(head))] * (not parts)) if role in learn else []
    return out


def format_conversation(turns: list[tuple[str, list[dict]]], **how) -> Formatted:
    whole, pieces, at = Formatted(), [], 0
    for role, parts in turns:
        one = format_turn(role, parts, **how)
        pieces.append(one.text)
        whole.spans += [(r, a + at, b + at) for r, a, b in one.spans]
        whole.mask += [(a + at, b + at) for a, b in one.mask]
        whole.refs += [(len(whole.refs) + i, *rest) for i, *rest in one.refs]
        at += len(one.text)
    whole.text = "".join(pieces)
    return whole


def read_back(formatted: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(role, parts) of every turn of an output; parts are ("text", text) or (kind, "index:tokens").

    An empty text next to a placeholder leaves no trace and is not read back.
    """
    i = 0
    while i < len(formatted):
        if not formatted.startswith(OPEN, i):
            raise ValueError(f"no turn starts at {i}")
        says = formatted.index(ROLE_END, i)
        end = formatted.index(CLOSE, says)
        body, parts, at = formatted[says + len(ROLE_END) : end], [], 0
        while (p := body.find(PART, at)) >= 0:
            if p > at:
                parts += [("text", t) for t in text_parts(body[at:p])]
            stop = body.index(PART_END, p)
            kind, rest = body[p + len(PART) : stop].split(":", 1)
            parts.append((kind, rest))
            at = stop + len(PART_END)
        if at < len(body) or not parts:
            parts += [("text", t) for t in text_parts(body[at:])]
        yield unescape(formatted[i + len(OPEN) : says]), parts
        i = end + len(CLOSE)


OUT = "conv_id long, turn long, role string, formatted string, mask array<struct<start:int,end:int>>, refs array<struct<n:int,kind:string,ref:string,tokens:int>>"


def format_rows(conversations: DataFrame) -> DataFrame:
    """Each row of ``(conv_id, turn, role, text)``, or with ``parts`` (an array of structs with ``type``), formatted.

    Mask spans and reference numbers count from the turn's own start. A null text, role or part list is an
    empty one, parts of unknown types and sizes as :class:`PartVisitor` says. Repeated rows are formatted each time,
    an empty table gives no rows, other columns play no part. One pass without shuffle: the longest conversation
    costs no more memory than its longest turn.
    """
    content = F.col("parts") if "parts" in conversations.columns else F.array(F.struct(F.lit("text").alias("type"), F.col("text").cast("string").alias("text")))
    ready = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(content, F.array()).alias("parts") if "parts" in conversations.columns else content.alias("parts"))
    mask_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    ref_type = pa.list_(pa.struct([("n", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))

    def run(batches):
        for b in batches:
            rows = [format_turn(r, [p for p in ps if p is not None]) for r, ps in zip(b.column("role").to_pylist(), b.column("parts").to_pylist())]
            masks = pa.array([[{"start": s, "end": e} for s, e in x.mask] for x in rows], mask_type)
            refs = pa.array([[dict(zip(("n", "kind", "ref", "tokens"), r)) for r in x.refs] for x in rows], ref_type)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), pa.array([x.text for x in rows], pa.string()), masks, refs], names=["conv_id", "turn", "role", "formatted", "mask", "refs"])

    return ready.mapInArrow(run, OUT)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """What the formatted turns say when read back, a row for each conversation; turns in order, ties by their text.

    A null ``conv_id`` is a conversation of its own, null turns come first in theirs, repeated rows are turns each.
    Rows of a conversation are sorted into one task but streamed through running hashes, never gathered.
    """

    def run(batches):
        key, state = object(), None
        done: list[tuple] = []

        def close():
            if state is not None:
                n, turns, chars, loss, size = state
                done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for b in batches:
            for conv, text, mask in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), b.column("mask").to_pylist()):
                if state is None or conv != key:
                    close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, parts in read_back(text):
                    state[0] += 1
                    said = "".join(p[1] for p in parts if p[0] == "text")
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in mask:
                    learnt = unescape(text[span["start"] : span["end"]])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
            if len(done) >= 1000:
                yield _digests(done)
                done.clear()
        close()
        yield _digests(done)

    dealt = formatted.select("conv_id", "turn", "formatted", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return dealt.mapInArrow(run, DIGEST)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    cols = list(zip(*rows)) if rows else [()] * 6
    names = [c.split()[0] for c in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)
