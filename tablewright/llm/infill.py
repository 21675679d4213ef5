"""Fill-in-middle: a text cut at two seeded places and written with sentinels, and read back, in Spark SQL alone.

``regexp_extract_all`` makes the array of units, the digits of a SHA-256 give the cuts and the form, ``slice`` and
``array_join`` build the arrangement, and a split at the sentinels restores the text. One pass, no shuffle: a row needs
its own text only, and its array of units lives as long as the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One code point, line ends included.
CODE_POINT = "(?s)."


@dataclass(frozen=True)
class Sentinels:
    """Marks of prefix, suffix and middle: different, not empty, each begun by ``<`` and free of it afterwards.

    So no mark can begin inside another or across the edge of one, and the marks of an output are found by a search.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        all_ = (self.prefix, self.suffix, self.middle)
        if len(set(all_)) < 3 or any(len(s) < 2 or s.rfind("<") != 0 or "\\E" in s for s in all_) or any(a != b and a.startswith(b) for a in all_ for b in all_):
            raise ValueError(f"sentinels must differ, begin with '<' and hold no other '<': {all_}")

    @property
    def pattern(self) -> str:
        return "|".join(rf"\Q{s}\E" for s in (self.prefix, self.suffix, self.middle))


def draw(id_col: Column, group: int, seed: int) -> Column:
    """The ``group``-th (from 1) eight hex digits of the SHA-256 of ``seed:id``, as an unsigned number; a null id is ``null``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, keep_percent: int = 10, spm_percent: int = 20,
    sentinels: Sentinels = Sentinels(), unit: str = CODE_POINT,
) -> DataFrame:
    """``(id, n, form, prefix_units, middle_units, output)``, a row for every row of ``docs``.

    Of ``n`` units the prefix ends after the smaller of two seeded places in 0..n and the middle after the larger.
    ``form`` is ``plain`` for texts without units, texts that hold a sentinel and ``keep_percent`` of the others;
    ``spm`` (suffix, prefix, middle) for ``spm_percent`` of the rest, else ``psm``. ``unit`` is a regular expression
    whose matches, joined, are the text.

    A null text is an empty one. A null id draws as the word ``null``; rows of one id draw alike, each on its own text,
    so repeated rows have equal outputs. An empty table gives no rows. Other columns, of any name, play no part.
    """
    mine = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    drawn = mine.select("_id", "_text", F.regexp_extract_all("_text", F.lit(unit), 0).alias("_units"), *[draw(F.col("_id"), k, seed).alias(f"_h{k}") for k in range(1, 5)])
    n = F.size("_units").cast("long")
    cut = drawn.select("_id", "_text", "_units", n.alias("n"), (F.col("_h1") % (n + 1)).alias("_a"), (F.col("_h2") % (n + 1)).alias("_b"), "_h3", "_h4")
    plain = (F.col("n") == 0) | F.col("_text").rlike(sentinels.pattern) | (F.col("_h3") % 100 >= 100 - keep_percent)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < spm_percent, "spm").otherwise("psm")
    formed = cut.select("_id", "_text", "_units", "n", form.alias("form"), F.least("_a", "_b").cast("int").alias("_from"), F.greatest("_a", "_b").cast("int").alias("_to"))

    def part(start: Column, count: Column) -> Column:
        return F.array_join(F.slice("_units", start + 1, count), "")

    spm, total = F.col("form") == "spm", F.col("n").cast("int")
    prefix, suffix = part(F.lit(0), F.col("_from")), part(F.col("_to"), total - F.col("_to"))
    middle = part(F.col("_from"), F.col("_to") - F.col("_from"))
    p, s, m = map(F.lit, (sentinels.prefix, sentinels.suffix, sentinels.middle))
    output = F.when(F.col("form") == "plain", F.col("_text")).when(spm, F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    cutting = F.col("form") != "plain"
    return formed.select(
        F.col("_id").alias(id_col), "n", "form", F.when(cutting, F.col("_from").cast("long")).alias("prefix_units"),
        F.when(cutting, (F.col("_to") - F.col("_from")).cast("long")).alias("middle_units"), output.alias("output"),
    )


def restore(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text from an output and its form, by the output's sentinels; null where these are not as the form has them."""
    p, s, m = sentinels.prefix, sentinels.suffix, sentinels.middle
    found, parts = F.regexp_extract_all(output, F.lit(sentinels.pattern), 0), F.split(output, sentinels.pattern, -1)

    def read(order: tuple[str, ...], *at: int) -> Column:
        in_place = output.startswith(order[0]) & (found == F.array(*map(F.lit, order)))
        return F.when(in_place, F.concat(*[F.get(parts, F.lit(k)) for k in at]))

    return F.when(form == "plain", output).when(form == "psm", read((p, s, m), 1, 3, 2)).when(form == "spm", read((s, p, m), 2, 3, 1))
