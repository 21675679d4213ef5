"""URL rules as one bit-parallel automaton.

Glob rules are packed into multiword Shift-And masks: one bit for each pattern symbol, one column of words
for each byte value. One step over a byte moves all patterns of all URLs of a batch at once. ``*`` stands
for any run of bytes without ``/``, ``**`` for any run; a starred bit keeps itself while the byte is in its
class. URLs are judged in a canonical form: the host in lower case, then the path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``verdict`` for hosts that are ``host`` or end in ``.host`` with a path that starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[str, str]:
        return (f"{self.text}**", f"*.{self.text}**")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    head = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.translate(head, upper, lower))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(tail)


class ShiftAnd:
    """Patterns are compiled once and carried to the tasks as numpy arrays."""

    def __init__(self, globs: list[str]):
        starts, ends, keep_any, keep_seg, literal = [], [], [], [], []
        for glob in globs:
            raw, bit = glob.encode(), len(literal)
            literal.append(None)  # the state before the first symbol
            starts.append(bit)
            i = 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    keep_any.append(len(literal) - 1)
                    i += 2
                elif raw[i : i + 1] == b"*":
                    keep_seg.append(len(literal) - 1)
                    i += 1
                else:
                    literal.append(raw[i])
                    i += 1
            ends.append(len(literal) - 1)
        self.n, self.words = len(literal), max(1, -(-len(literal) // 64))
        self.moves = np.zeros((256, self.words), dtype=np.uint64)
        self.stays = np.zeros((256, self.words), dtype=np.uint64)
        for bit, byte in enumerate(literal):
            if byte is not None:
                self.moves[byte, bit // 64] |= np.uint64(1 << bit % 64)
        for bit in keep_any:
            self.stays[:, bit // 64] |= np.uint64(1 << bit % 64)
        for bit in keep_seg:
            self.stays[np.arange(256) != ord("/"), bit // 64] |= np.uint64(1 << bit % 64)
        self.start = np.zeros(self.words, dtype=np.uint64)
        for bit in starts:
            self.start[bit // 64] |= np.uint64(1 << bit % 64)
        self.ends = ends

    def run(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix: texts by patterns. Longest texts first, so finished ones leave the front."""
        out = np.zeros((len(texts), len(self.ends)), dtype=bool)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        begin = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        live = len(texts)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes[:live], -step, side="left"))  # texts longer than step
            byte = flat[begin[:live] + step]
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.moves[byte]) | (now & self.stays[byte])
        for p, bit in enumerate(self.ends):
            out[order, p] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
        return out


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row, repeated rows included.

    The longest rule that fits wins (of equally long ones the first in code point order); without one
    ``rule`` is null and the verdict is ``default``. A null url or one without ``://`` has an empty host
    and path. One pass, no shuffle; very long urls cost steps, not memory.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text))
    machine = ShiftAnd([g for r in ranked for g in r.globs])
    names, verdicts = [r.text for r in ranked], [r.verdict for r in ranked]

    def run(batches):
        for batch in batches:
            hosts, paths = batch.column("host"), batch.column("path")
            texts = [h.encode() + p.encode() for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            hit = machine.run(texts).reshape(len(texts), len(names), 2).any(axis=2) if texts and names else np.zeros((len(texts), 1), dtype=bool)
            first = np.where(hit.any(axis=1), hit.argmax(axis=1), -1).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), hosts, paths, pa.array([names[i] if i >= 0 else None for i in first], pa.string()), pa.array([verdicts[i] if i >= 0 else default for i in first], pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    url = F.col(url_col).cast("string")
    ready = pages.select(F.col(id_col).cast("long").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    return ready.mapInArrow(run, f"`{id_col}` long, host string, path string, rule string, verdict string")
