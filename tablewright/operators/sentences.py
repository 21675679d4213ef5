"""Sentence boundaries learnt from a corpus: which words are abbreviations, what goes together, what begins sentences.

A word is an abbreviation if it stands before a period much more often than words do, the shorter and the more often the
better; the words around abbreviations then tell collocations and sentence starters by log-likelihood ratios. All of it
is counts of words and of pairs, aggregated over the corpus; the model is a few sets of words. A token pass cuts texts:
by one model, or, where the sets are too large for that, by what each text asks of them, which joins bring to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import split_marks
from ..shared import checkpoint
from .retrieval import small

# Fixed values of the published method: what the ratios must reach, and the share of periods after an abbreviation.
ABBREVIATION, COLLOCATION, STARTER, AFTER_ABBREVIATION = 0.3, 7.88, 30.0, 0.99
_NUMBER = "##number##"
#: Entries of a set that may come to the driver and to every task; larger sets are met by joins.
MOST = 20_000


@dataclass(frozen=True)
class Model:
    """Sets of words in lower case, without their last period; ``collocations`` are pairs joined by a blank."""

    abbreviations: frozenset[str] = frozenset()
    collocations: frozenset[str] = frozenset()
    starters: frozenset[str] = frozenset()
    seen_lower: frozenset[str] = frozenset()
    upper_inside: frozenset[str] = field(default_factory=frozenset)


@dataclass(frozen=True)
class Learnt:
    """The same sets, whole, as frames ``(name, score)``."""

    abbreviations: DataFrame
    collocations: DataFrame
    starters: DataFrame
    seen_lower: DataFrame
    upper_inside: DataFrame

    def sets(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def model(self, most: int | None = None) -> Model | None:
        """All of it as a model, or None if a set has more than ``most`` entries."""
        found = {}
        for name, df in self.sets().items():
            rows = df.select("name").limit((most or MOST) + 1).collect()
            if len(rows) > (most or MOST):
                return None
            found[name] = frozenset(r[0] for r in rows)
        return Model(**found)


def _core(word: Column) -> Column:
    """A word in lower case without marks around it, but for a period behind it; numbers are one word."""
    bare = F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", ""))
    return F.regexp_replace(bare, r"^[0-9][0-9.,]*?(\.?)$", f"{_NUMBER}$1")


def _beside(docs: DataFrame, text: str) -> DataFrame:
    """A row for each word: ``word, before, after`` (the words beside it, null at the ends)."""
    split = docs.select(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "").alias("_w")).where(F.size("_w") > 0)
    shifted = split.select(F.arrays_zip(F.col("_w").alias("word"), F.concat(F.array(F.lit(None).cast("string")), F.col("_w")).alias("before"), F.slice("_w", F.lit(2), F.size("_w")).alias("after")).alias("_z"))
    return shifted.select(F.explode("_z").alias("z")).select("z.*").where("word is not null")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with a ``word`` and what it is by itself; words without letters and digits are left out."""
    rest = [c for c in rows.columns if c != "word"]
    core, bare = _core(F.col("word")), F.regexp_replace("word", r"^[^\p{L}\p{N}]+", "")
    marked = rows.where(F.regexp_like("word", F.lit(r"[\p{L}\p{N}]"))).select("word", *rest, core.alias("_core"), bare.alias("_bare"))
    return marked.select(
        "word", F.regexp_replace("_core", r"\.$", "").alias("type"), F.col("_core").endswith(".").alias("period"), F.regexp_like("word", F.lit(r"[!?][^\p{L}\p{N}]*$")).alias("stop"),
        F.regexp_like("_bare", F.lit(r"^\p{Lu}")).alias("upper"), F.regexp_like("_bare", F.lit(r"^\p{Ll}")).alias("lower"), *rest,
    )


def words(docs: DataFrame, text: str) -> DataFrame:
    """A row for each word: ``word, type`` (its core without a last period), ``period, stop`` (ends with ! or ?), ``upper`` and ``lower``
    (first letter), ``before, after`` (the words beside it, null at the ends)."""
    return _marked(_beside(docs, text))


def different_words(docs: DataFrame, text: str) -> DataFrame:
    """The same for each different word, with ``times``, how often it occurs: a word is looked into once, not at every place."""
    split = docs.select(F.explode(F.split(F.col(text), r"\s+")).alias("word")).where("word <> ''")
    return _marked(split.groupBy("word").agg(F.count("*").alias("times")))


def contexts(docs: DataFrame, text: str) -> DataFrame:
    """``word, inside, after, times``: each different word by whether it follows a word without a mark behind it, and, where the word
    has a mark that may end a sentence, by the word after it (else null)."""
    inside = F.col("before").isNotNull() & ~F.regexp_like("before", F.lit(r"[.!?:;][^\p{L}\p{N}]*$"))
    after = F.when(F.regexp_like("word", F.lit("[.!?]")), F.col("after"))
    return _beside(docs, text).groupBy("word", F.coalesce(inside, F.lit(False)).alias("inside"), after.alias("after")).agg(F.count("*").alias("times"))


def _log(k: Column, n: Column, x: Column) -> Column:
    """Log-likelihood of ``k`` of ``n`` at probability ``x``; nothing times log 0 is 0."""
    part = lambda a, p: F.when(a > 0, a * F.ln(p)).otherwise(F.lit(0.0))
    return part(k, x) + part(n - k, 1 - x)


def ratio(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """How much better two probabilities explain ``ab`` of ``a`` and ``b`` of ``n`` than one does."""
    p, p1, p2 = b / n, ab / a, F.when(n > a, (b - ab) / (n - a)).otherwise(F.lit(0.0))
    return -2 * (_log(ab, a, p) + _log(b - ab, n - a, p) - _log(ab, a, p1) - _log(b - ab, n - a, p2))


def abbreviation_scores(tokens: DataFrame) -> DataFrame:
    """``(type, with_period, without, score)`` of every type of letters that a period ever follows; 0.3 makes an abbreviation.

    The ratio of an abbreviation's share of periods against that of any word, times e to the minus of the length,
    the number of periods, and the length to the minus of the occurrences without one. Types that never abbreviate get 0 or less.
    ``tokens``: ``words``, or ``different_words`` with their ``times``. The counts are checkpointed, as they are read twice.
    """
    times = F.col("times") if "times" in tokens.columns else F.lit(1)
    of = lambda c: F.sum(F.when(c, times).otherwise(0)).cast("long")
    counts = checkpoint(tokens.groupBy("type").agg(of(F.col("period")).alias("with_period"), of(~F.col("period")).alias("without")))
    whole = counts.agg(F.sum("with_period").alias("_p"), F.sum(F.col("with_period") + F.col("without")).alias("_n"))
    some = counts.where((F.col("with_period") > 0) & F.regexp_like("type", F.lit(r"\p{L}"))).crossJoin(F.broadcast(whole))  # whole: one row
    share = F.col("_p") / F.col("_n")
    n = F.col("with_period") + F.col("without")
    better = -2 * (_log(F.col("with_period"), n, share) - _log(F.col("with_period"), n, F.lit(AFTER_ABBREVIATION)))
    dots = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - dots
    score = better * F.exp(-letters.cast("double")) * (dots + 1) * F.pow(letters.cast("double"), -F.col("without").cast("double"))
    return some.select("type", "with_period", "without", score.alias("score"))


def learn(docs: DataFrame, text: str = "text", known: tuple[str, ...] = (), most: int | None = None) -> Learnt:
    """What a corpus teaches, whole; ``most`` is a bound on the abbreviations, as in :func:`train`.

    ``known`` are abbreviations (lower case, without their last period) whatever the corpus says. One pass over the texts
    counts words in their contexts, all else is made of these; nothing comes to the driver. Null texts have no words.
    """
    following = F.when(F.col("after").isNotNull(), F.regexp_replace(_core(F.col("after")), r"\.$", ""))
    tokens = checkpoint(_marked(contexts(docs, text)).withColumn("next", following))
    scored = _best(abbreviation_scores(tokens).where(F.col("score") >= ABBREVIATION).select(F.col("type").alias("name"), "score"), most)
    given = docs.sparkSession.createDataFrame([(x, None) for x in known], "name string, score double")
    abbreviations = checkpoint(scored.unionByName(given).groupBy("name").agg(F.max("score").alias("score")))
    short = small(abbreviations.select(F.col("name").alias("type"), F.lit(True).alias("_short")), MOST)
    initial = F.regexp_like("type", F.lit(r"^\p{L}$"))
    marked = tokens.join(short, "type", "left").withColumn("open", F.col("period") & (F.coalesce("_short", F.lit(False)) | initial | (F.col("type") == _NUMBER)))
    marked = marked.withColumn("ends", (F.col("period") & ~F.col("open")) | F.col("stop"))
    of = lambda c: F.sum(F.when(c, F.col("times")).otherwise(0))
    one = checkpoint(tokens.groupBy("type").agg(F.sum("times").alias("n"), of(F.col("lower")).alias("low"), of(F.col("upper") & F.col("inside")).alias("inside")))
    # words that follow a word, by whether that ends a sentence or leaves it open: the rest needs no other pass over texts
    follows = checkpoint(marked.where((F.col("ends") | F.col("open")) & F.col("after").isNotNull()).groupBy("type", "next", "ends", "open").agg(F.sum("times").alias("times")))
    whole = one.agg(F.sum("n").cast("double").alias("_n")).crossJoin(F.broadcast(follows.agg(F.coalesce(F.sum(F.when(F.col("ends"), F.col("times"))), F.lit(0)).cast("double").alias("_ends"))))  # one row
    begun = follows.where(F.col("ends") & F.regexp_like("next", F.lit(r"\p{L}"))).groupBy(F.col("next").alias("type")).agg(F.sum("times").cast("double").alias("first"))
    starts = begun.join(one, "type").crossJoin(F.broadcast(whole)).withColumn("ll", ratio(F.col("_ends"), F.col("n").cast("double"), F.least("first", "n"), F.col("_n")))
    starters = starts.where((F.col("ll") >= STARTER) & (F.col("first") / F.col("_ends") > F.col("n") / F.col("_n")))
    pairs = follows.where(F.col("open") & F.regexp_like("next", F.lit(r"\p{L}|##"))).groupBy("type", "next").agg(F.sum("times").cast("double").alias("ab")).where("ab > 1")
    sides = pairs.join(one.select("type", F.col("n").cast("double").alias("a")), "type").join(one.select(F.col("type").alias("next"), F.col("n").cast("double").alias("b")), "next").crossJoin(F.broadcast(whole))
    bound = sides.withColumn("ll", ratio(F.col("a"), F.col("b"), F.least("ab", "b"), F.col("_n"))).where((F.col("ll") >= COLLOCATION) & (F.col("ab") / F.col("a") > F.col("b") / F.col("_n")))
    # letters' case matters only for words that follow an open period
    after = checkpoint(follows.where("open and next <> ''").groupBy(F.col("next").alias("type")).agg(F.sum("times").alias("times")).join(one, "type"))
    lower, inside = (after.where(F.col(c) > 0).select(F.col("type").alias("name"), F.col("times").alias("score")) for c in ("low", "inside"))
    return Learnt(abbreviations, checkpoint(bound.select(F.concat_ws(" ", "type", "next").alias("name"), F.col("ll").alias("score"))), checkpoint(starters.select(F.col("type").alias("name"), F.col("ll").alias("score"))), lower, inside)


def _best(df: DataFrame, most: int | None) -> DataFrame:
    return df if most is None else df.orderBy(F.desc("score"), "name").limit(most)


def train(docs: DataFrame, text: str = "text", known: tuple[str, ...] = (), most: int = MOST) -> Model:
    """A model of bounded size: each set holds at most ``most`` entries, those of the greatest ratio (or count), and ``known``.

    Of a corpus that teaches more, :func:`learn` keeps all.
    """
    found = learn(docs, text, known, most).sets()
    whole = found.pop("abbreviations")
    return Model(frozenset(r[0] for r in whole.select("name").collect()), **{name: frozenset(r[0] for r in _best(df, most).select("name").collect()) for name, df in found.items()})


_WORD = re.compile(r"\S+")
_EDGES = re.compile(r"^[\W_]+|[^\w.]+$")
_NUMERIC = re.compile(r"^[0-9][0-9.,]*?(\.?)$")
_CLOSING = "\"')]}»”’"


def _typed(word: str) -> str:
    return _NUMERIC.sub(rf"{_NUMBER}\1", _EDGES.sub("", word).lower())


def ends_sentence(word: str, after: str | None, model: Model) -> bool:
    """Whether a sentence ends with ``word`` before the word ``after`` (None: the text ends)."""
    bare = word.rstrip(_CLOSING)
    if after is None or bare.endswith(("!", "?")):
        return True
    if not bare.endswith(".") or bare.endswith("..."):
        return bare.endswith("...") and _EDGES.sub("", after)[:1].isupper()
    kind, following = _typed(bare).rstrip("."), _typed(after).rstrip(".")
    initial, number = len(kind) == 1 and kind.isalpha(), kind == _NUMBER
    first = _EDGES.sub("", after)[:1]
    if not (kind in model.abbreviations or initial or number):
        return True
    if f"{kind} {following}" in model.collocations or first.islower():
        return False
    if number:
        return first.isupper()
    if first.isupper() and following in model.starters and not initial:
        return True
    # a capital letter ends it if the word is written small elsewhere, and never with a capital inside a sentence
    return first.isupper() and following in model.seen_lower and following not in model.upper_inside


def cut(text: str | None, model: Model) -> list[str]:
    """The sentences of a text, by line and in order, without white space around them."""
    out = []
    for line in (text or "").split("\n"):
        found = list(_WORD.finditer(line))
        start = 0
        for i, m in enumerate(found):
            if ends_sentence(m[0], found[i + 1][0] if i + 1 < len(found) else None, model):
                out.append(line[found[start].start() : m.end()])
                start = i + 1
    return out


def sentences(text: str | Column, model: Model) -> Column:
    """The sentences of a text as an array; of a null text none."""
    return F.pandas_udf(lambda x: x.map(lambda t: cut(t, model)), T.ArrayType(T.StringType()))(text)


def asked(text: str | None) -> list[tuple[str, str]]:
    """The different pairs of a word with a last period and the word after it that :func:`cut` asks a model about."""
    out = set()
    for line in (text or "").split("\n"):
        found = line.split()
        for word, after in zip(found, found[1:]):
            bare = word.rstrip(_CLOSING)
            if bare.endswith(".") and not bare.endswith("..."):
                out.add((_typed(bare).rstrip("."), _typed(after).rstrip(".")))
    return sorted(out)


def _own_models(docs: DataFrame, id_col: str, text: str, learnt: Learnt) -> DataFrame:
    """``docs`` with the entries of each set that the document asks about, as arrays ``_abbreviations`` and so on (null: none).

    A row may see what another one of its id, or of the id's hash, asks about: entries hold for all texts.
    """
    pairs = F.pandas_udf(lambda x: x.map(lambda t: [{"kind": k, "following": f} for k, f in asked(t)]), T.ArrayType(T.StructType().add("kind", "string").add("following", "string")))
    keyed = docs.withColumn("_key", F.xxhash64(id_col))
    rows = checkpoint(keyed.select("_key", F.explode(pairs(text)).alias("p")).select("_key", "p.*").distinct())
    met = rows.select("kind", "following").distinct()
    name_of = {"abbreviations": F.col("kind"), "collocations": F.concat_ws(" ", "kind", "following")}
    for name, df in learnt.sets().items():
        met = met.withColumn("name", name_of.get(name, F.col("following"))).join(df.select("name", F.lit(True).alias(f"_{name}")), "name", "left").drop("name")
    # of a word that is no abbreviation, initial or number no more is asked
    met = met.where(F.col("_abbreviations") | (F.length("kind") == 1) | (F.col("kind") == _NUMBER))
    kept = [F.collect_set(F.when(F.col(f"_{name}"), name_of.get(name, F.col("following")))).alias(f"_{name}") for name in learnt.sets()]
    return keyed.join(rows.join(met, ["kind", "following"]).groupBy("_key").agg(*kept), "_key", "left").drop("_key")


def _cut_by_own(text: pd.Series, *sets: pd.Series) -> pd.Series:
    return pd.Series([cut(t, Model(*(frozenset(() if x is None else x) for x in own))) for t, *own in zip(text, *sets)], dtype=object)


def statements(docs: DataFrame, id_col: str, text: str, model: Model | Learnt, least: int = 4, most: int = 32, title: str | None = None) -> DataFrame:
    """``(id, place, sentence, n_tokens)``: sentences of ``least`` to ``most`` tokens; rows whose ``title`` is null or empty have none."""
    kept = docs if title is None else docs.where(F.coalesce(F.trim(F.col(title)) != "", F.lit(False)))
    whole = model.model() if isinstance(model, Learnt) else model
    if whole is not None:
        found = sentences(text, whole)
    else:
        kept = _own_models(kept, id_col, text, model)
        found = F.pandas_udf(lambda t, a, b, c, d, e: _cut_by_own(t, a, b, c, d, e), T.ArrayType(T.StringType()))(text, *[f"_{name}" for name in model.sets()])
    one = kept.select(F.col(id_col), F.posexplode(found).alias("place", "sentence"))
    return one.withColumn("n_tokens", F.size(split_marks("sentence"))).where(F.col("n_tokens").between(least, most))
