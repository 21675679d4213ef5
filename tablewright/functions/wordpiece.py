"""WordPiece: longest pieces first inside lower-cased words without accents; never trained here."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import EMPTY, format_text

#: Marks of the vocabulary.
UNKNOWN, EMPTY_PIECE, UNUSED, INNER = "[UNK]", "[EMPTY]", "[unused0]", "##"

#: Bytes of texts cut at once: a piece may be a character, and takes some hundred bytes until it is an Arrow value.
CHUNK_BYTES = 1 << 18


def read_vocabulary(spark: SparkSession, path: str) -> list[str]:
    """Pieces by id, one for each line; the first unused one becomes the piece of empty texts.

    The file comes to the driver whole: a vocabulary has tens of thousands of lines, whatever the corpus has.
    """
    lines = spark.read.text(path, wholetext=True).first()
    pieces = lines["value"].split("\n") if lines else []
    return [EMPTY_PIECE if p == UNUSED else p for p in (pieces[:-1] if pieces and not pieces[-1] else pieces)]


@functools.lru_cache(maxsize=4)
def _tokenizer(vocabulary: tuple[str, ...], longest: int):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    ids = {p: i for i, p in enumerate(vocabulary)}
    ids.setdefault(UNKNOWN, len(ids))
    out = Tokenizer(models.WordPiece(ids, unk_token=UNKNOWN, max_input_chars_per_word=longest))
    out.normalizer = normalizers.BertNormalizer(clean_text=True, handle_chinese_chars=True, strip_accents=True, lowercase=True)
    out.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    return out


def _encoded(texts: pa.Array, words: tuple[str, ...], longest: int) -> Iterator[list]:
    """The texts' encodings in order, null ones None, in lists of some ``CHUNK_BYTES`` of text, whatever the batch holds."""
    bound, start, held = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist(), 0, 0
    for end, n in enumerate([*bound, CHUNK_BYTES]):
        if start < end and (held + n > CHUNK_BYTES or end == len(bound)):
            part = texts.slice(start, end - start).to_pylist()
            found = _tokenizer(words, longest).encode_batch(["" if t is None else t for t in part], add_special_tokens=False)
            yield [None if t is None else e for t, e in zip(part, found)]
            start, held = end, 0
        held += n


def _joined(parts: Iterator[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([pa.array([], kind), *parts])


def pieces(x: str | Column, vocabulary: list[str], longest: int = 200) -> Column:
    """Array of pieces. Words of more than ``longest`` characters or without a cover are ``[UNK]``; texts that format
    as empty are ``[EMPTY]``; null stays null."""
    words, kind = tuple(vocabulary), pa.list_(pa.string())

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(texts: pa.Array) -> pa.Array:
        return _joined((pa.array([None if e is None else e.tokens for e in part], kind) for part in _encoded(texts, words, longest)), kind)

    col = F.col(x) if isinstance(x, str) else x
    return F.when(format_text(col) == EMPTY, F.array(F.lit(EMPTY_PIECE))).otherwise(cut(col))


def piece_counts(x: str | Column, vocabulary: list[str], longest: int = 200) -> Column:
    """How many :func:`pieces` a text has, without making them columns."""
    words = tuple(vocabulary)

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        return _joined((pa.array([None if e is None else len(e) for e in part], pa.int64()) for part in _encoded(texts, words, longest)), pa.int64())

    col = F.col(x) if isinstance(x, str) else x
    return F.when(format_text(col) == EMPTY, F.lit(1).cast("long")).otherwise(count(col))


def is_inner(piece: Column) -> Column:
    return F.startswith(piece, F.lit(INNER))


def whole_words(tokens: Column) -> Column:
    """Pieces joined back to the words they were cut from."""
    start = F.array().cast("array<string>")
    glued = lambda ws, p: F.concat(F.slice(ws, 1, F.size(ws) - 1), F.array(F.concat(F.element_at(ws, -1), F.substring(p, 3, 1 << 30))))
    return F.aggregate(tokens, start, lambda ws, p: F.when(is_inner(p) & (F.size(ws) > 0), glued(ws, p)).otherwise(F.concat(ws, F.array(p))))


def aligned_pieces(x: str | Column, vocabulary: list[str], longest: int = 200) -> Column:
    """Pieces with their places in the text as it was: ``array<struct<piece, begin, end>>``, in characters, end excluded.

    Places are kept through normalising (cases, accents, control characters, CJK spacing), so the characters from the
    begin of one piece to the end of another are what these pieces were made of. Null texts stay null, others that
    format as empty have no pieces.
    """
    words = tuple(vocabulary)
    kind = T.ArrayType(T.StructType().add("piece", T.StringType()).add("begin", T.IntegerType()).add("end", T.IntegerType()))

    arrow = pa.list_(pa.struct([("piece", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(kind)
    def cut(texts: pa.Array) -> pa.Array:
        one = lambda e: None if e is None else [{"piece": p, "begin": b, "end": c} for p, (b, c) in zip(e.tokens, e.offsets)]
        return _joined((pa.array([one(e) for e in part], arrow) for part in _encoded(texts, words, longest)), arrow)

    return cut(F.col(x) if isinstance(x, str) else x)


def original_text(text: str | Column, aligned: Column, first: Column, last: Column) -> Column:
    """The text behind pieces ``first`` to ``last`` (places from 0, both in), whole words: to the ends of words that they cut."""
    col = F.col(text) if isinstance(text, str) else text
    places = F.sequence(F.lit(0), F.size(aligned) - 1)
    inner = lambda i: F.coalesce(is_inner(F.get(aligned, i)["piece"]), F.lit(False))
    start = F.array_max(F.filter(places, lambda i: (i <= first) & (~inner(i) | (i == 0))))
    stop = F.coalesce(F.array_min(F.filter(places, lambda i: (i > last) & ~inner(i))) - 1, F.size(aligned) - 1)
    begin, end = F.get(aligned, start)["begin"], F.get(aligned, stop)["end"]
    return F.when((first >= 0) & (first <= last) & (last < F.size(aligned)), F.substring(col, begin + 1, end - begin))


def answer_texts(answers: DataFrame, cells: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``(question_id, text, row_index, column_index)``: the cell text that an answer's pieces were cut from.

    ``answers``: ``question_id, table_id, pieces array<string>``; ``cells``: ``table_id, row_index, column_index, text``. Of
    all places where the pieces stand in a cell of the table the shortest text counts, then the first cell. Pieces
    that stand in none are joined to words, without a cell.
    """
    from ..operators.match import find_sublist

    cut = cells.where("text is not null").withColumn("_a", aligned_pieces("text", vocabulary))
    met = answers.where(F.size("pieces") > 0).join(cut, "table_id").withColumn("_at", find_sublist(F.col("pieces"), F.transform("_a", lambda p: p["piece"]))).where("_at is not null")
    read = met.withColumn("_t", original_text("text", F.col("_a"), F.col("_at"), F.col("_at") + F.size("pieces") - 1))
    best = read.groupBy("question_id").agg(F.min(F.struct(F.length("_t").alias("n"), "row_index", "column_index", F.col("_t").alias("text"))).alias("_b"))
    out = answers.join(best, "question_id", "left")
    return out.select("question_id", F.coalesce("_b.text", F.array_join(whole_words(F.col("pieces")), " ")).alias("text"), F.col("_b.row_index").alias("row_index"), F.col("_b.column_index").alias("column_index"))
