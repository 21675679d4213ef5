"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a marked word: one or more whitespace markers (U+2581) and what follows up to the next marker.
Where no piece holds a marker after another character, no merge crosses a chunk's edge, so a text's ids are
its chunks' ids in order. Each task keeps a table from chunk to ids and decoded surface, segments a chunk
when it is first seen and joins the results back by position. Models whose pieces do cross the marker, or
that change the text before segmentation, are recognised and given whole texts instead.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkTable(dict):
    """chunk -> (count, ids as text, surface). At most ``limit`` chunks of at most ``longest`` characters are kept."""

    def __init__(self, model_file: str, limit: int = 150_000, longest: int = 64):
        import sentencepiece

        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.limit, self.longest = limit, longest
        self.lone = self.sp.piece_to_id(MARK)
        self.guard = self._guard()
        self.chunked = self.guard is not None and self._separable()

    def _guard(self) -> int | None:
        """A piece of one plain letter: put before ids, it keeps the decoder from dropping their first blank."""
        found = self.sp.piece_to_id("a")
        return found if self.sp.id_to_piece(found) == "a" else None

    def _separable(self) -> bool:
        """Whether chunks are independent: no piece crosses a marker, nothing is normalised, a marker is put in front."""
        sp = self.sp
        crossing = any(MARK in p.lstrip(MARK) for p in map(sp.id_to_piece, range(sp.get_piece_size())))
        plain = sp.normalize("  ﬁ Ａ\t  \n") == f"{MARK * 3}ﬁ{MARK}Ａ\t{MARK * 2}\n"
        return not crossing and plain and sp.is_byte(sp.piece_to_id("<0x0A>")) and self.lone != sp.unk_id()

    def __missing__(self, chunk: str) -> tuple[int, str, str]:
        ids = self.sp.encode(chunk[1:].replace(MARK, " "), num_threads=1) if len(chunk) > 1 else [self.lone]
        row = (len(ids), ",".join(map(str, ids)), self.sp.decode([self.guard, *ids])[1:])
        if len(chunk) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = row
        return row

    def encode_text(self, text: str) -> tuple[int, str, str]:
        """(number of ids, decimal ids joined by commas, decoded text) of a whole text."""
        if not text:
            return 0, "", ""
        if not self.chunked:
            ids = self.sp.encode(text, num_threads=1)
            return len(ids), ",".join(map(str, ids)), self.sp.decode(ids)
        rows = list(map(self.__getitem__, _CHUNK.findall(MARK + text.replace(" ", MARK))))
        counts, ids, surfaces = zip(*rows)
        return sum(counts), ",".join(ids), "".join(surfaces)[1:]


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """Every whole text's ids and decoded form; a null text is an empty one, repeated rows are encoded each.

    An empty table gives no rows; other columns, of any name, play no part.

    With ``digests`` the columns are ``(id, n_tokens, ids_sha256, decoded_sha256)``, else ``(id, n_tokens,
    ids array<int>, decoded)``. ``model_file`` is a path on every executor. One pass, no shuffle: the table
    of chunks belongs to a task and is emptied at its limit, so memory does not follow the vocabulary.
    """
    schema = f"`{id_col}` long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches):
        table = ChunkTable(model_file)
        for batch in batches:
            rows = [table.encode_text(t or "") for t in batch.column("text").to_pylist()]
            if digests:
                cols = [pa.array([sha(r[1]) for r in rows], pa.string()), pa.array([sha(r[2]) for r in rows], pa.string())]
            else:
                cols = [pa.array([[int(x) for x in r[1].split(",") if x] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())]
            names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r[0] for r in rows], pa.int64()), *cols], names=names)

    ready = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return ready.mapInArrow(run, schema)
