"""Language-model scoring by deleted interpolation.

A token's probability mixes two maximum-likelihood estimates, bigram and unigram, with a floor of 1 / (V + 1),
the share of one of the V known tokens or of the unknown one; each of the three sums to 1 over these. The
mixture weights belong to buckets of the context's frequency and are learned by expectation-maximisation on
held-out counts: one text in ``FOLD`` of the training texts (copies of a text together) is deleted from the
counts and predicted by the rest. The final scores use the counts of all training texts.

Counts are exact and cover all training texts. They travel block by block (see ``_blocks``): a block asks for
each of its distinct tokens and bigrams once and gets their corpus counts back in the order of its questions.
Texts of the fold are in blocks of their own, so only these are predicted for the weights. Everything is one
plan: the texts and the answers are dealt out once, and the weights (a row of bounded size) join the answers.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._blocks import BLOCK_BYTES, answered, asked, by_range, exchange, pack, ranges_for, shuffle_partitions, unpack
from ._words import WordHashes, as_utf8, mix

#: The token that ends every text; no word equals it, as a word has no blank.
END = b" "
#: Key ranges of bigrams are numbered after those of tokens.
_PAIRS = 1 << 24
#: As many buckets and levels as 64-bit counts have powers of two, and quarters of them: nothing is ever clipped.
BUCKETS = 65
_LEVELS = 512
#: One in so many training texts is deleted from the counts to learn the weights.
FOLD = 8
#: Answers with this block number hold a key range's totals.
_TOTALS = -1


def tokens_of(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Keys of a text's tokens, A-Z lower-cased, the end last."""
    return hashes.of([*(text or b"").lower().split(), END])


def bigrams_of(tokens: np.ndarray) -> np.ndarray:
    """Keys of each token with the one before it; a text's first token follows the end."""
    return mix(np.roll(tokens, 1) * np.uint64(0x9E3779B97F4A7C15) + tokens)


def _pack_counts(x: np.ndarray) -> bytes:
    """Counts (64-bit, none negative) by bytes of like weight, as many as the largest needs."""
    planes = np.ascontiguousarray(x, dtype="<i8").view(np.uint8).reshape(-1, 8)
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return bytes([width]) + zlib.compress(np.ascontiguousarray(planes[:, :width].T).tobytes(), 1)


def _counts(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(memoryview(blob)[1:]), dtype=np.uint8).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : blob[0]] = planes.T
    return out.view("<i8").ravel()


class _Block:
    """A block's tokens and bigrams: sorted distinct keys, the block's own training counts, each token's place."""

    def __init__(self, docs: pa.Table, parts: int):
        hashes = WordHashes()
        tokens = [tokens_of(t, hashes) for t in docs.column("_text").to_pylist()]
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.before = np.concatenate([np.roll(np.arange(b - m, b), 1) for b, m in zip(np.cumsum(self.sizes).tolist(), self.sizes.tolist())])
        learn = np.repeat(np.array(docs.column("_learn").to_pylist(), dtype=np.float64), self.sizes)
        self.sides = []
        for first, keys in ((0, tokens), (_PAIRS, [bigrams_of(t) for t in tokens])):
            uniq, place = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(place, weights=learn, minlength=len(uniq)).astype(np.int64)
            ranges = [(first + p, s) for p, s in by_range(uniq, parts)]
            self.sides.append((uniq, place, n, ranges))

    def counts(self, told: pa.Table, column: str, with_own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(each token's count, its bigram's, its context's) as an answer's column tells them."""
        more = dict(zip(told.column("part").to_pylist(), told.column(column).to_pylist()))
        found = []
        for _, place, own, ranges in self.sides:
            n = own.copy() if with_own else np.zeros_like(own)
            for p, s in ranges:
                n[s] += _counts(more[p])
            found.append(n[place])
        return found[0], found[1], found[0][self.before]


def _ask(parts: int):
    def run(table: pa.Table) -> pa.Table:
        """All keys of the block in order, with their counts in its training texts."""
        if not table.num_rows:
            return asked([])
        block = table.column("block")[0].as_py()
        return asked([(p, block, pack(uniq[s]), _pack_counts(n[s])) for uniq, _, n, ranges in _Block(table, parts).sides for p, s in ranges])

    return run


def _answer(first_held: int):
    def run(table: pa.Table) -> pa.Table:
        """To every block that asked, in the order of its keys: how much the corpus counts exceed its own.

        Blocks of the fold also get the counts without the fold, in place of the keys. One more row holds the
        range's totals as text: training tokens and distinct ones, with the fold and without.
        """
        blocks, part = table.column("block").to_pylist(), table.column("part")[0].as_py()
        lists = [unpack(b) for b in table.column("keys").to_pylist()]
        own = [_counts(b) for b in table.column("extra").to_pylist()]
        keys, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        everything, rest = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        places = np.split(inverse, np.cumsum([len(x) for x in lists])[:-1])
        for block, at, mine in zip(blocks, places, own):
            everything[at] += mine
            if block < first_held:
                rest[at] += mine
        out = [(block, part, _pack_counts(rest[at]) if block >= first_held else b"", _pack_counts(everything[at] - mine)) for block, at, mine in zip(blocks, places, own)]
        if part < _PAIRS:
            out.append((_TOTALS, part, b"", " ".join(str(x) for n in (everything, rest) for x in (n.sum(), (n > 0).sum())).encode()))
        return answered(out)

    return run


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Buckets of context frequency: 0 for none, then by powers of two."""
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(context + 1.0))).astype(np.int64)


def estimates(own: np.ndarray, pair: np.ndarray, context: np.ndarray, n: int, v: int) -> np.ndarray:
    """Rows: the bigram's and the unigram's maximum likelihood, and the floor."""
    return np.stack([np.where(context > 0, pair / np.maximum(context, 1), 0.0), own / max(n, 1), np.full(len(own), 1 / (v + 1))])


def _level(x: np.ndarray) -> np.ndarray:
    """Level 0 for nothing; else by quarter powers of two from 1 (a count, or one over a share)."""
    return np.where(np.isfinite(x) & (x > 0), 1 + np.rint(4 * np.log2(np.where(np.isfinite(x) & (x > 0), x, 1.0))), 0).astype(np.int64)


def heldout_events(own: np.ndarray, pair: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Numbers of (bucket, level of the bigram estimate, level of the unigram count) of tokens that the rest predicts."""
    share = np.divide(context, pair, out=np.zeros(len(own)), where=pair > 0)
    return (bucket_of(context) * _LEVELS + _level(share)) * _LEVELS + _level(own.astype(np.float64))


def learn_weights(events: np.ndarray, times: np.ndarray, n: int, v: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (bucket, 3) by expectation-maximisation; buckets without events take the mean.

    ``n`` and ``v`` are the tokens and the distinct tokens that predict. Without any event the floor has all weight
    if there is no training token, else the three share it.
    """
    power = lambda level: 2.0 ** ((level - 1) / 4)
    bucket, bi, uni = events // (_LEVELS * _LEVELS), events // _LEVELS % _LEVELS, events % _LEVELS
    p = np.stack([np.where(bi > 0, 1 / power(bi), 0.0), np.where(uni > 0, power(uni) / max(n, 1), 0.0), np.full(len(events), 1 / (v + 1))])
    w = np.full((BUCKETS, 3), 1 / 3)
    seen = np.bincount(bucket, weights=times, minlength=BUCKETS) > 0
    for _ in range(rounds):
        share = w[bucket].T * p
        share *= times / share.sum(axis=0)
        w = np.stack([np.bincount(bucket, weights=s, minlength=BUCKETS) for s in share], axis=1) + 1e-6
        w /= w.sum(axis=1, keepdims=True)
    w[~seen] = np.average(w[seen], axis=0) if seen.any() else [0, 0, 1] if not n else [1 / 3] * 3
    w[0] = w[0] * [0, 1, 1] / max(1e-12, w[0, 1:].sum())  # no context, no bigram
    return w


def _predict(parts: int, first_held: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        """Histogram of the held-out events of a block of the fold; of the totals' group the totals, as events below 0."""
        at, times = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        if not docs.num_rows:
            times = np.sum([[int(x) for x in row.split()] for row in told.column("extra").to_pylist()], axis=0)
            at = -1 - np.arange(len(times))
        elif docs.column("block")[0].as_py() >= first_held:
            at, times = np.unique(heldout_events(*_Block(docs, parts).counts(told, "keys", False)), return_counts=True)
        return pa.table({"event": at, "n": times})

    return run


_WEIGHTS = "weights binary, n long, v long"


def _learn(table: pa.Table) -> pa.Table:
    """One row of the weights and totals, from the whole histogram: a bounded number of cells, and four totals below 0."""
    event, n = table.column("event").to_numpy(), table.column("n").to_numpy()
    totals = {-1 - e: x for e, x in zip(event.tolist(), n.tolist()) if e < 0}
    cells = np.argsort(event, kind="stable")
    cells = cells[event[cells] >= 0]
    w = learn_weights(event[cells], n[cells].astype(np.float64), totals.get(2, 0), totals.get(3, 0))
    return pa.table({"weights": pa.array([w.astype("<f8").tobytes()], pa.binary()), "n": pa.array([totals.get(0, 0)], pa.int64()), "v": pa.array([totals.get(1, 0)], pa.int64())})


def _score(names: list[str], parts: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:  # the totals' group
            return pa.Table.from_arrays([docs.column(c).combine_chunks() for c in names] + [pa.array([], t) for _, t in _SCORES], names=[*names, *[c for c, _ in _SCORES]])
        w = np.frombuffer(told.column("weights")[0].as_py(), dtype="<f8").reshape(BUCKETS, 3)
        n, v = told.column("n")[0].as_py(), told.column("v")[0].as_py()
        block = _Block(docs, parts)
        own, pair, context = block.counts(told, "extra", True)
        low = np.log10((own + 1) / (n + v + 1))
        full = np.log10((w[bucket_of(context)].T * estimates(own, pair, context, n, v)).sum(axis=0))
        start = np.cumsum(block.sizes) - block.sizes  # every text has a token, its end
        cols = [block.sizes, np.add.reduceat((own > 0).astype(np.int64), start), np.full(len(start), n), np.add.reduceat(low, start), np.add.reduceat(full, start)]
        return pa.Table.from_arrays([*[docs.column(c).combine_chunks() for c in names], *[pa.array(c, t) for c, (_, t) in zip(cols, _SCORES)]], names=[*names, *[c for c, _ in _SCORES]])

    return run


_SCORES = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def in_fold(text: Column, seed: int = 10) -> Column:
    """Whether a training text is among those that the weights are learned on; copies of a text are so together."""
    return F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(FOLD)) == 0


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id, carry columns, n_tokens, n_known, train_tokens, base_score, score)``, a row for every row.

    ``learn`` says which rows' texts give the counts (null: no); a repeated row counts each time. ``base_score`` is
    the add-one unigram model's log10 probability, ``score`` the mixture's. Null and empty texts are the end token
    alone. With no training text all counts are 0 and the floor is all. Tokens and bigrams meet as 64-bit hashes:
    two that collide share a count. The driver sees the texts' size only; an empty table gives no rows. Blocks
    follow hashes of id and text, so null and repeated ids are dealt out like others; rows equal in both, and a text
    itself, are in one block.
    """
    names = list(dict.fromkeys([id_col, *carry]))
    text, learn = as_utf8(text_col), F.coalesce(learn, F.lit(False))
    length = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    marked = docs.select(*[F.col(c).alias(f"_keep_{c}") for c in names], text.alias("_text"), learn.alias("_learn"), length.alias("_size"), (learn & in_fold(F.coalesce(text, F.lit(b"")))).alias("_held"))
    size, held = marked.agg(F.sum("_size"), F.sum(F.when(F.col("_held"), F.col("_size")))).first()
    size, held = size or 0, held or 0
    blocks = max(2 * shuffle_partitions(docs), math.ceil((size - held) / block_bytes))
    held_blocks = max(1, math.ceil(blocks * held / max(1, size)))
    parts, place = ranges_for(size), F.xxhash64(f"_keep_{id_col}", "_text", F.lit(11))
    dealt = F.when(F.col("_held"), blocks + F.pmod(place, F.lit(held_blocks))).otherwise(F.pmod(place, F.lit(blocks))).cast("int")
    kept = [f"_keep_{c}" for c in names]
    ready = marked.select(dealt.alias("block"), *kept, "_text", "_learn").repartitionById(blocks + held_blocks, F.col("block"))
    told = exchange(ready, 2 * parts, _ask(parts), _answer(blocks)).repartitionById(blocks + held_blocks, F.col("block"))
    events = ready.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_predict(parts, blocks), "event long, n long")
    cells = events.groupBy("event").agg(F.sum("n").alias("n"))
    weights = cells.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_learn, _WEIGHTS)  # cells: at most buckets x levels x levels, whatever the corpus
    answers = told.crossJoin(F.broadcast(weights))  # one row of two kilobytes
    types = [StructField(f"_keep_{c}", docs.schema[c].dataType) for c in names]
    schema = StructType([*types, *StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    out = ready.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(kept, parts), schema)
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, names)], "n_tokens", "n_known", "train_tokens", "base_score", "score")
