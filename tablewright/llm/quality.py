"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

A text's features are counts, as shares of its words, of hashed 1- and 2-grams over two views of each word:
the word with A-Z in lower case, and its shape (runs of capitals, letters, digits, other marks), where a word equal to
the one before it has a shape of its own. A score is a sparse dot product through the logistic function.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import checkpoint
from ._words import as_utf8, mix, split_words

_RUNS = re.compile(r"([A-ZÀ-ÖØ-Þ]+)|([^\W\d_]+)|(\d+)|([\W_]+)")


@dataclass(frozen=True)
class Settings:
    """``train_rows`` bounds the labelled sample that comes to the driver; each of its texts has at most ``2 ** bits`` features."""

    bits: int = 16
    train_rows: int = 6_000
    epochs: int = 4
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    seed: int = 7


def shape_of(word: str) -> str:
    """Kinds of the word's runs of characters: ``A`` capitals, ``Aa`` / ``a`` letters, ``9`` digits, marks as they are, once."""
    out = []
    for caps, letters, digits, marks in _RUNS.findall(word):
        out.append("A" if len(caps) > 1 else "C" if caps else "a" if letters else "9" if digits else "".join(sorted(set(marks))))
    return "".join(out)


class Features(dict):
    """word -> (hash of the word with A-Z in lower case, hash of its shape)."""

    def __init__(self, bits: int, limit: int = 200_000):
        super().__init__()
        self.mask, self.limit = np.uint64((1 << bits) - 1), limit

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= self.limit:
            self.clear()
        row = (xxhash.xxh64_intdigest(word.lower(), 11), xxhash.xxh64_intdigest(shape_of(word.decode("utf-8", "replace")), 12))
        self[word] = row
        return row

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """(indexes, values) of a whole text; an empty one has none, so only the bias speaks."""
        words = split_words(text)
        if not words:
            return np.empty(0, dtype=np.int64), np.empty(0)
        pairs = np.array(list(map(self.__getitem__, words)), dtype=np.uint64)
        word, shape = pairs[:, 0], pairs[:, 1].copy()
        shape[1:][word[1:] == word[:-1]] ^= np.uint64(0x5BD1E995)
        grams = [word, shape]
        for view in (word, shape):
            grams.append(mix(view[:-1] * np.uint64(3) + view[1:]))
        short = np.uint64(xxhash.xxh64_intdigest(str(min(len(words), 1 << 12).bit_length()), 13))
        where, n = np.unique((np.concatenate([mix(g) for g in grams]) & self.mask).astype(np.int64), return_counts=True)
        value = np.sqrt(n / len(words))
        return np.append(where, int(mix(np.array([short]))[0] & self.mask)), np.append(value, 0.3)


class FTRL:
    """FTRL-proximal with per-coordinate rates; weights are derived from the two accumulators when touched."""

    def __init__(self, s: Settings):
        size = (1 << s.bits) + 1  # the last one is the bias
        self.s, self.z, self.n = s, np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        shrunk = np.sign(z) * np.maximum(np.abs(z) - s.l1, 0)
        return -shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.s.alpha
        self.z[at] += g - rate * w
        self.n[at] += g * g


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, by ``modulus``; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", allowed: Column | None = None) -> np.ndarray:
    """Weights, the bias last, from at most ``train_rows`` labelled documents.

    The sample is those of the least seeded hash among the rows of ``labels`` that ``allowed`` admits and
    whose label is 0 or 1; only their ids (a bounded table) are broadcast to pick the texts, and only their
    features come to the driver, all of them: partition by partition into a temporary file, from which they
    are learnt row by row. Of a document labelled more than once the lowest label holds, of several texts of one
    id the least by its bytes, so no more than ``train_rows`` rows come to the driver however often ids repeat.
    Null texts are empty ones. Without labelled rows, or without documents, all weights are 0.
    """
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (allowed if allowed is not None else F.lit(True)))
    picked = rows.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y")).withColumn("_rank", F.xxhash64(F.col("_id").cast("string"), F.lit(settings.seed))).orderBy("_rank", "_id").limit(settings.train_rows)
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(as_utf8(text_col), F.lit(b"")).alias("text")).join(F.broadcast(picked), F.col("_doc") == F.col("_id"))
    sample = texts.groupBy(F.col("_id"), F.col("_rank").alias("rank"), F.col("_y").cast("int").alias("y")).agg(F.min("text").alias("text")).drop("_id")

    def run(batches):
        features = Features(settings.bits)
        for b in batches:
            kept = [features.of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("rank"), b.column("y"), pa.array([at.astype("<i4").tobytes() for at, _ in kept], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in kept], pa.binary())], names=["rank", "y", "at", "x"]
            )

    features = checkpoint(sample.mapInArrow(run, "rank long, y int, at binary, x binary"))
    model, bias = FTRL(settings), 1 << settings.bits
    turn = np.random.default_rng(settings.seed)
    with tempfile.TemporaryFile() as file:
        places = []  # (rank, label, features of equal rank in order, where, how many)
        for r in features.toLocalIterator():
            at, x = bytes(r["at"]), bytes(r["x"])
            places.append((r["rank"], r["y"], hashlib.sha256(at + x).digest(), file.tell(), len(at) // 4))
            file.write(at + x)
        places.sort()
        for _ in range(settings.epochs):
            for i in turn.permutation(len(places)):
                _, y, _, start, n = places[i]
                file.seek(start)
                at, x = np.frombuffer(file.read(4 * n), dtype="<i4"), np.frombuffer(file.read(4 * n), dtype="<f4")
                model.learn(np.append(at, bias), np.append(x.astype(float), 1.0), float(y))
    return model.weights(slice(None))


def score(docs: DataFrame, weights: np.ndarray, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, score)`` and the ``carry`` columns for every row; null and empty texts are scored by the bias.

    Repeated rows are scored each time, rows of equal texts alike; an empty table gives no rows. ``weights`` (2 ** bits doubles, a fixed size) travel with the task. One pass, no shuffle.
    """
    from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

    others = [c for c in carry if c != text_col]
    fields = [*docs.select(id_col, *others).schema.fields, *([StructField("_text", BinaryType())] if text_col in carry else [])]

    def run(batches):
        features, bias = Features(settings.bits), weights[-1]
        for b in batches:
            z = np.array([float(weights[at] @ x) + bias for at, x in map(features.of, b.column("_text").to_pylist())], dtype=float)
            kept = [b.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))), pa.float64())], names=[*[f.name for f in fields], "_score"])

    scored = docs.select(id_col, *others, as_utf8(text_col).alias("_text")).mapInArrow(run, StructType([*fields, StructField("_score", DoubleType())]))
    shown = [F.col("_text").cast("string").alias(c) if c == text_col else F.col(c) for c in carry]
    return scored.select(id_col, *shown, F.col("_score").alias("score"))  # a carried text goes to Python and back once
