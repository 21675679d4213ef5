"""Substring dedup: passages of ``n`` words that an earlier document already holds.

Three steps, each block by block (see ``_blocks``). *Confirm*: every block names the distinct hashes of its
windows of ``n`` words once; a key range tells each block which of them an earlier block holds. With those and
the windows that repeat in the block, the block knows which of its distinct windows recur, and by one place of
each spells the recurring passages: maximal runs of such windows. *Compile*: the passages, cut into phrases of
half a window so that every window holds a whole one, become Aho-Corasick automata, as many as their number
asks for. *Stream*: all documents of the block run through the automata, which alone say where passages occur;
the windows around each hit are compared with the passage word by word, and covered where it has a smaller id.

Blocks are ranges of document ids, so "an earlier block holds it" means a smaller id does.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ._blocks import BLOCK_BYTES, answered, asked, by_range, exchange, pack, ranges_for, text_bytes, unpack, with_block
from ._words import WordHashes, as_utf8, split_words, window_hashes

#: Phrases in one automaton, at most.
SHARD = 200_000
#: A word is spelt in digits of this base, each place with characters of its own: nodes of the automata keep
#: few children, which they search one by one, and no match begins inside a word.
BASE = 32
#: Words spelt for the automata, and windows compared word by word, at once.
_READ = 1 << 17
_CHECKED = 1 << 16


def _ask(n: int, ranges: int):
    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return asked([])
        hashes, block = WordHashes(), table.column("block")[0].as_py()
        found = [window_hashes(hashes.of(split_words(t)), n) for i, t in zip(table.column("_id").to_pylist(), table.column("_text").to_pylist()) if i is not None]
        keys = np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)
        return asked([(p, block, pack(keys[s]), b"") for p, s in by_range(keys, ranges)])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """To each block those of its keys that a block of a smaller number holds."""
    blocks, blobs = table.column("block").to_numpy(), table.column("keys").to_pylist()
    part = table.column("part")[0].as_py() if table.num_rows else 0
    order = np.argsort(blocks, kind="stable")
    lists = [unpack(blobs[i]) for i in order]
    keys, owner = np.concatenate(lists), np.repeat(blocks[order], [len(x) for x in lists])
    by = np.argsort(keys, kind="stable")  # equal keys stay in the order of blocks
    keys, owner = keys[by], owner[by]
    again = np.flatnonzero(keys[1:] == keys[:-1]) + 1
    keys, owner = keys[again], owner[again]
    out = []
    for block in np.unique(owner):
        out.append((int(block), part, pack(keys[owner == block]), b""))
    return answered(out)


class Vocabulary(dict):
    """word -> its number in the block, with the words' hashes by number. Equal numbers are equal words."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return found


class PhraseAutomata:
    """Phrases of equal length over word numbers, in sharded Aho-Corasick automata."""

    def __init__(self, phrases: np.ndarray, shard: int = SHARD):
        self.length = phrases.shape[1]
        self.machines = []
        for a in range(0, len(phrases), shard):
            part = phrases[a : a + shard]
            letters = np.unique(part)
            digits = 1
            while BASE**digits < len(letters):
                digits += 1
            machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            size = digits * self.length
            flat = self._spell(np.searchsorted(letters, part).ravel(), digits)
            for i in range(0, len(flat), size):
                machine.add_word(flat[i : i + size])
            machine.make_automaton()
            self.machines.append((letters, digits, machine))

    @staticmethod
    def _spell(numbers: np.ndarray, digits: int) -> str:
        """Fixed-width spelling; -1 is a word that no phrase holds."""
        codes, rest = np.empty((len(numbers), digits), dtype="<u4"), numbers.astype(np.int32)
        for place in range(digits):
            codes[:, place] = np.where(numbers < 0, 0, rest % BASE + (place * BASE + 1))
            rest //= BASE
        return codes.tobytes().decode("utf-32-le")

    def hits(self, words: np.ndarray, most: int = _READ) -> np.ndarray:
        """First words of all phrases in a text, from every shard's automaton; ``most`` words are spelt at a time."""
        found: list[np.ndarray] = [np.empty(0, dtype=np.int64)]
        for letters, digits, machine in self.machines:
            for a in range(0, len(words), most):
                part = words[a : a + most + self.length - 1]  # a phrase that begins here may end there
                spot = np.minimum(np.searchsorted(letters, part), len(letters) - 1)
                text = self._spell(np.where(letters[spot] == part, spot, -1), digits)
                ends = np.fromiter((end for end, _ in machine.iter(text)), dtype=np.int64) // digits
                found.append(ends + (a - self.length + 1))
        return np.unique(np.concatenate(found))


class RepeatedPassages:
    """The recurring windows of a block's documents, and the automata of the passages that they make up."""

    def __init__(self, n: int, documents: list[list[bytes]], ids: list[int | None], earlier: np.ndarray, shard: int = SHARD):
        """``earlier``: sorted hashes of windows that documents of smaller ids, outside the block, hold."""
        self.n, words = n, Vocabulary()
        numbers = [np.fromiter(map(words.__getitem__, d), dtype=np.int32, count=len(d)) for d in documents]
        self.sizes = np.array([len(x) for x in numbers], dtype=np.int64)
        self.flat = np.concatenate([np.empty(0, dtype=np.int32), *numbers])
        hashes = np.array(words.hashes, dtype=np.uint64)
        self.keys = window_hashes(hashes[self.flat], n)
        self.ends = np.cumsum(self.sizes)
        end = np.repeat(np.where([i is None for i in ids], 0, self.ends), self.sizes)[: len(self.keys)] if ids else np.empty(0, dtype=np.int64)
        self.whole = np.arange(len(self.keys)) + n <= end  # windows inside one document that has an id
        self.owner = np.repeat(np.array([0 if i is None else i for i in ids], dtype=np.int64), self.sizes)
        self._confirm(earlier)
        self.automata = PhraseAutomata(self._phrases(), shard)

    def _confirm(self, earlier: np.ndarray) -> None:
        """Distinct windows that recur: their hashes, the smallest id that holds each, one place of each."""
        at = np.flatnonzero(self.whole)
        at = at[np.argsort(self.keys[at], kind="stable")]
        keys, owner = self.keys[at], self.owner[at]
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]]))
        none = np.empty(0, dtype=np.int64)
        first, last = (np.minimum.reduceat(owner, starts), np.maximum.reduceat(owner, starts)) if len(starts) else (none, none)
        keys = keys[starts]
        if len(earlier) and len(keys):
            spot = np.minimum(np.searchsorted(earlier, keys), len(earlier) - 1)
            first = np.where(earlier[spot] == keys, np.iinfo(np.int64).min, first)
        recurs = first < last
        # a place in the earliest rows, so neighbouring windows are spelt from one document
        self.recurring, self.first, self.place = keys[recurs], first[recurs], at[starts[recurs]]

    def _phrases(self) -> np.ndarray:
        """The passages, maximal runs of recurring windows, cut every half window."""
        length = (self.n + 1) // 2
        spots = np.sort(self.place)
        if not len(spots):
            return np.empty((0, length), dtype=np.int32)
        cut = np.flatnonzero(np.diff(spots) != 1) + 1
        begin, end = spots[np.concatenate([[0], cut])], spots[np.concatenate([cut - 1, [len(spots) - 1]])] + self.n
        count = (end - begin) // length
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        rows = self.flat[(np.repeat(begin, count) + step * length)[:, None] + np.arange(length)]
        return np.unique(rows, axis=0)

    def covered(self) -> np.ndarray:
        """Which words lie in an occurrence of a passage that a smaller id holds, as the automata find them."""
        change = np.zeros(len(self.flat) + 1, dtype=np.int32)
        hits = self.automata.hits(self.flat) if len(self.recurring) else np.empty(0, dtype=np.int64)
        near = np.zeros(len(self.keys), dtype=bool)
        for back in range(self.n - self.automata.length + 1):
            at = hits - back
            near[at[(at >= 0) & (at < len(near))]] = True
        spots, width = np.flatnonzero(near & self.whole), np.arange(self.n)
        for a in range(0, len(spots), _CHECKED):
            at = spots[a : a + _CHECKED]
            which = np.minimum(np.searchsorted(self.recurring, self.keys[at]), len(self.recurring) - 1)
            same = (self.flat[at[:, None] + width] == self.flat[self.place[which][:, None] + width]).all(axis=1)
            at = at[same & (self.first[which] < self.owner[at])]
            change[at] += 1
            change[at + self.n] -= 1
        return np.cumsum(change[:-1]) > 0


def _strip(n: int, names: list[str], keep_form: bool):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        texts = docs.column("_text").to_pylist()
        documents = [split_words(t) for t in texts]
        earlier = np.sort(np.concatenate([unpack(b) for b in told.column("keys").to_pylist()])) if told.num_rows else np.empty(0, dtype=np.uint64)
        passages = RepeatedPassages(n, documents, docs.column("_id").to_pylist(), earlier)
        covered, kept = passages.covered(), []
        total = np.concatenate([[0], np.cumsum(covered)])
        removed = total[passages.ends] - total[passages.ends - passages.sizes]
        for text, words, end, gone in zip(texts, documents, passages.ends.tolist(), removed.tolist()):
            if gone:
                words = [w for w, g in zip(words, covered[end - len(words) : end].tolist()) if not g]
            kept.append(text if keep_form and not gone else b" ".join(words))
        out = [docs.column(c).combine_chunks() for c in names]
        return pa.Table.from_arrays([*out, pa.array(passages.sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=[*names, "_n_words", "_n_removed", "_kept"])

    return run


def remove_repeats(docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), keep_form: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id, carry columns, n_words, n_removed, kept binary)``, a row for every row of ``docs``.

    A word goes if a window of ``n`` words that covers it also starts in a document of a smaller id; windows
    are those of the input. ``kept`` holds the other words joined by one blank; with ``keep_form`` a text that loses
    nothing stays as it is, null included. Rows of one id are one
    document, so they never count as earlier than each other; a null id counts for nobody and loses nothing.
    Null and empty texts have no words; an empty table gives no rows. Windows of different blocks meet as 64-bit
    hashes, inside a block they are compared word by word; a text is never split over tasks.
    """
    names, kept = [id_col, *carry], [f"_keep_{c}" for c in (id_col, *carry)]
    size = text_bytes(docs, text_col)
    dealt, blocks = with_block(docs, id_col, text_col, size, block_bytes)
    ready = dealt.select("block", F.col(id_col).cast("long").alias("_id"), as_utf8(text_col).alias("_text"), *[F.col(c).alias(k) for c, k in zip(names, kept)]).repartitionById(blocks, F.col("block"))
    ranges = ranges_for(size)
    told = exchange(ready, ranges, _ask(n, ranges), _answer).repartitionById(blocks, F.col("block"))  # the same rows, so Spark deals the texts out once
    fields = [StructField(k, docs.schema[c].dataType) for c, k in zip(names, kept)]
    schema = StructType([*fields, StructField("_n_words", LongType()), StructField("_n_removed", LongType()), StructField("_kept", BinaryType())])
    out = ready.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_strip(n, kept, keep_form), schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(names, kept)], F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept").alias("kept"))
