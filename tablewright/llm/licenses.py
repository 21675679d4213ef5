"""Licence scans by ordered signature rules, with DataFrame and SQL functions only.

A text becomes its words. Where it holds no rule's keyword, nothing more is done. Else each place of a keyword gets a
window of the words around it, the keyword marked, and the rules of that keyword are tried on the window, in order.
A match is an interval of words; one that lies inside a match of the same or a higher priority is hidden by it, of two
over the same words the one of the higher priority, then the earlier rule, stays.

All of it happens inside the row: no shuffle, and a very long text is cut into segments of ``SEGMENT`` words (with
margins of the longest match), so work grows with the words and the number of matches, not with their square.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import AFTER, BEFORE, KINDS, Rule, compiled

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEGMENT, SPAN = 1024, BEFORE + 1 + AFTER
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(WORD_PATTERN), 0)


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _detections(column: str, rules: list[Rule]) -> str:
    """SQL: of an array of words, an array of all matches as ``(start, stop, rule, kept)``, by place."""
    of_keyword = defaultdict(list)
    for r in rules:
        of_keyword[r.keyword].append(f"struct({r.number} AS rule, regexp_extract(h.around, {_quoted(r.pattern)}, 0) AS m)")
    keywords = ", ".join(map(_quoted, sorted(of_keyword)))
    # places of keywords in the words of a segment and its margins
    places = f"""filter(transform(slice({column}, greatest(g - {SPAN}, 0) + 1, {SEGMENT + 2 * SPAN}), (w, i) -> if(w IN ({keywords}), i + greatest(g - {SPAN}, 0), NULL)), p -> p IS NOT NULL)"""
    before = f"array_join(slice({column}, greatest(p - {BEFORE}, 0) + 1, least(p, {BEFORE})), ' ')"
    after = f"array_join(slice({column}, p + 1, {AFTER + 1}), ' ')"
    windows = f"transform({places}, p -> struct(p AS p, {column}[p] AS k, concat(' ', {before}, if(p > 0, ' ', ''), '@', {after}, ' ') AS around))"
    cases = " ".join(f"WHEN {_quoted(k)} THEN array({', '.join(of_keyword[k])})" for k in sorted(of_keyword))
    tried = f"flatten(transform({windows}, h -> transform(filter(CASE h.k {cases} END, d -> d.m <> ''), d -> struct(h.p AS p, d.rule AS rule, d.m AS m))))"
    # a match is a blank, words before the mark, the mark and the words from it on, each followed by a blank
    blanks = "length({0}) - length(replace({0}, ' ', ''))"
    start = f"d.p - ({blanks.format(chr(39).join(['substring_index(d.m, ', '@', ', 1)']))} - 1)"
    length = f"{blanks.format('d.m')} - 1"
    priority = "array(" + ", ".join(str(r.priority) for r in rules) + ")[d.rule]"
    placed = f"transform(transform({tried}, d -> struct(int({start}) AS s, int({length}) AS n, {priority} AS priority, d.rule AS rule)), d -> struct(d.s AS s, -d.n AS n, -d.priority AS priority, d.rule AS rule))"
    # in this order an interval's covers come before it; the state is the furthest stop of each priority so far
    levels = max(p for p, _ in KINDS.values())
    hidden = "exists(slice(a.stops, -d.priority, 100), e -> e >= d.s - d.n)"
    folded = f"""aggregate(sort_array({placed}), struct(array_repeat(0, {levels}) AS stops, CAST(array() AS array<struct<start:int,stop:int,rule:int,kept:boolean>>) AS found),
      (a, d) -> struct(transform(a.stops, (e, i) -> if(i = -d.priority - 1, greatest(e, d.s - d.n), e)) AS stops,
        concat(a.found, array(struct(d.s AS start, d.s - d.n AS stop, d.rule AS rule, NOT {hidden} AS kept))) AS found), a -> a.found)"""
    mine = f"filter({folded}, d -> d.start >= g AND d.start < g + {SEGMENT})"
    return f"flatten(transform(sequence(0, greatest(size({column}) - 1, 0), {SEGMENT}), g -> {mine}))"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``(id, n_words long, detections, labels array<string>, score)``, a row for every row of ``docs``.

    ``detections`` has every match of every rule by place: ``start`` and ``stop`` in words from 0 (stop excluded), the
    ``rule``'s number, its ``label`` and ``kind``, and ``kept``, false where another match hides it. ``labels`` are those
    of the kept ones, distinct and sorted, and ``score`` the confidence of the best of them, 0 without.

    Null and empty texts have no words and no matches. Repeated rows, and rows of one id, are scanned each; an empty
    table gives no rows. Other columns, of any name, play no part.
    """
    rules = compiled() if rules is None else rules
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in rules})])
    read = docs.select(F.col(id_col).alias("_id"), words(F.col(text_col)).alias("_words"))
    gated = F.when(F.arrays_overlap("_words", keywords), F.expr(_detections("_words", rules)))
    none = F.array().cast("array<struct<start:int,stop:int,rule:int,kept:boolean>>")
    found = read.select("_id", F.size("_words").cast("long").alias("n_words"), F.coalesce(gated, none).alias("_found"))
    labels, kinds = (F.array(*[F.lit(x) for x in xs]) for xs in ([r.label for r in rules], [r.kind for r in rules]))
    best = F.array(*[F.lit(r.confidence) for r in rules])
    named = F.transform("_found", lambda d: F.struct(d["start"].alias("start"), d["stop"].alias("stop"), d["rule"].alias("rule"), F.get(labels, d["rule"]).alias("label"), F.get(kinds, d["rule"]).alias("kind"), d["kept"].alias("kept")))
    kept = F.filter("_found", lambda d: d["kept"])
    return found.select(
        F.col("_id").alias(id_col), "n_words", named.alias("detections"), F.array_sort(F.array_distinct(F.transform(kept, lambda d: F.get(labels, d["rule"])))).alias("labels"),
        F.coalesce(F.array_max(F.transform(kept, lambda d: F.get(best, d["rule"]))), F.lit(0.0)).alias("score"),
    )


def with_base(scanned: DataFrame, id_col: str = "doc_id", kind: str = "BASE") -> DataFrame:
    """Of a scan: the places of the rules of one kind, hidden or not, their labels, and all labels with these."""
    base = F.filter("detections", lambda d: d["kind"] == kind)
    places = scanned.select(id_col, "n_words", "labels", "score", base.alias("_base"))
    starts, marks = F.transform("_base", lambda d: d["start"]), F.transform("_base", lambda d: d["label"])
    return places.select(
        id_col, "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(marks)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat("labels", marks))), ",").alias("labels"), "score",
    )
