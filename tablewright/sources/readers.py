"""Question and table files as DataFrames. Schemas are stated, so no read infers one from the data."""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

COORDINATES = r"\(\s*(-?\d+)\s*,\s*(-?\d+)\s*\)"


def parse_coordinates(c: Column) -> Column:
    """``['(1, 2)', ...]`` to an array of ``struct<row, col>``."""
    rows = F.regexp_extract_all(c, F.lit(COORDINATES), F.lit(1))
    cols = F.regexp_extract_all(c, F.lit(COORDINATES), F.lit(2))
    return F.zip_with(rows, cols, lambda r, k: F.struct(r.cast("int").alias("row"), k.cast("int").alias("col")))


def parse_texts(c: Column) -> Column:
    """``['a', u'b']`` to an array of texts."""
    found = F.regexp_extract_all(c, F.lit(r"""u?('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""), F.lit(1))
    return F.transform(found, lambda s: F.regexp_replace(F.substring(s, F.lit(2), F.length(s) - 2), r"\\(.)", "$1"))


def question_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Question rows grouped to sequences: ``(id, table_file, questions)``, questions by position.

    Of rows of one sequence and position the last of the file counts. Optional columns are null if absent.
    """
    lines = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    for c in ("aggregation", "float_answer", "class_index"):
        lines = lines if c in lines.columns else lines.withColumn(c, F.lit(None).cast("string"))
    one = lines.select(
        text.sequence_id("id", "annotator").alias("id"), "table_file", F.col("position").cast("int").alias("position"), F.col("question").alias("text"), parse_coordinates(F.col("answer_coordinates")).alias("coordinates"),
        parse_texts(F.col("answer_text")).alias("answer_texts"), F.nullif(F.upper(F.trim("aggregation")), F.lit("")).alias("aggregation"), F.col("float_answer").try_cast("float").alias("float_answer"),
        F.col("class_index").try_cast("int").alias("class_index"), F.monotonically_increasing_id().alias("_line"),
    )
    row = F.struct("position", text.question_id("id", "position").alias("question_id"), "text", "coordinates", "answer_texts", "aggregation", "float_answer", "class_index")
    last = one.groupBy("id", "table_file", "position").agg(F.max_by(row, "_line").alias("q"))
    return last.groupBy("id", "table_file").agg(F.sort_array(F.collect_list("q")).alias("questions"))


def csv_tables(spark: SparkSession, paths: str | list[str], sep: str = ",", escape: str = "\\") -> DataFrame:
    """A directory of small CSV tables as long cells, header row apart as ``column_name``; all cells are text.

    Tables differ in their columns, so each file is one row that Python's CSV reader cuts into cells.
    """

    def cut(batches):
        import csv
        import io

        for pdf in batches:
            out = []
            for path, body in zip(pdf.path, pdf.value):
                rows = list(csv.reader(io.StringIO(body), delimiter=sep, escapechar=escape or None, doublequote=True))
                header = rows[0] if rows else []
                out += [(path, r, c, header[c] if c < len(header) else None, x) for r, row in enumerate(rows[1:]) for c, x in enumerate(row)]
            yield pd.DataFrame(out, columns=["table_file", "row_index", "column_index", "column_name", "text"])

    files = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("path"), "value")
    return files.mapInPandas(cut, "table_file string, row_index int, column_index int, column_name string, text string")


def query_jsonl(spark: SparkSession, path: str) -> DataFrame:
    schema = "question string, table_id string, sql struct<agg:int,sel:int,conds:array<array<string>>>"
    return spark.read.schema(schema).json(path).withColumn("split", F.regexp_extract(F.col("_metadata.file_name"), r"^([A-Za-z]+)", 1))


def table_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Structured tables ``{id, header, types, rows}`` as long cells with ``type`` and, for real columns, ``number``."""
    from ..functions import numbers

    tables = spark.read.schema("id string, header array<string>, types array<string>, rows array<array<string>>").json(path)
    rows = tables.select("id", "header", "types", F.posexplode("rows").alias("row_index", "_r"))
    cells = rows.select(F.col("id").alias("table_id"), "row_index", "header", "types", F.posexplode("_r").alias("column_index", "text"))
    kind = F.element_at("types", F.col("column_index") + 1)
    return cells.select("table_id", "row_index", "column_index", F.element_at("header", F.col("column_index") + 1).alias("column_name"), kind.alias("type"), "text", F.when(kind == "real", numbers.to_float("text")).alias("number"))


def value_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with target values only: ``(id, utterance, table_file, answers)``."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return rows.select("id", "utterance", F.regexp_replace("context", r"(\w+)-csv/(\w+)\.csv", "table_$1-$2.tsv").alias("table_file"), F.split("targetValue", r"\|").alias("answers"))


def statement_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object for each file, table id to [statements, labels, title]: a row for each statement."""
    body = spark.read.text(path, wholetext=True)
    entries = body.select(F.explode(F.from_json("value", "map<string,string>")).alias("table_id", "raw"))
    parts = entries.select("table_id", F.from_json("raw", "array<string>").alias("p"))
    both = F.arrays_zip(F.from_json(F.col("p")[0], "array<string>").alias("statement"), F.from_json(F.col("p")[1], "array<int>").alias("label"))
    return parts.select("table_id", F.col("p")[2].alias("title"), F.posexplode(both).alias("position", "s")).select("table_id", "title", "position", "s.statement", "s.label")


def xml_tables(spark: SparkSession, path: str) -> DataFrame:
    """XML tables whose cells carry row and column spans, each expanded to single cells; the text stays upper left."""
    schema = "_id string, row array<struct<cell:array<struct<`_col-start`:int,`_col-end`:int,`_row-start`:int,`_row-end`:int,_text:string>>>>"
    tables = spark.read.format("xml").option("rowTag", "table").schema(schema).load(path)
    c = tables.select(F.col("_id").alias("table_id"), F.explode("row").alias("r")).select("table_id", F.explode("r.cell").alias("c"))
    grid = c.select("table_id", "c", F.explode(F.sequence(F.col("c.`_row-start`"), F.col("c.`_row-end`"))).alias("row_index")).select("table_id", "c", "row_index", F.explode(F.sequence(F.col("c.`_col-start`"), F.col("c.`_col-end`"))).alias("column_index"))
    corner = (F.col("row_index") == F.col("c.`_row-start`")) & (F.col("column_index") == F.col("c.`_col-start`"))
    return grid.select("table_id", "row_index", "column_index", F.when(corner, F.col("c._text")).otherwise("").alias("text"))


def hits_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Neighbour lists, one query a line: ``(query_id, table_id, rank, score)``, rank from 0 by place."""
    rows = spark.read.schema("query_id string, table_scores array<struct<table_id:string,score:double>>").json(path)
    return rows.select("query_id", F.posexplode("table_scores").alias("rank", "h")).select("query_id", "h.table_id", "rank", "h.score")


def predictions_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Prediction files; ``logits_cls`` as one number or a bracketed list becomes an array."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    if "logits_cls" in rows.columns:
        rows = rows.withColumn("logits_cls", F.transform(F.filter(F.split(F.regexp_replace("logits_cls", r"[\[\],]", " "), r"\s+"), lambda s: s != ""), lambda s: s.try_cast("double")))
    if "answer_coordinates" in rows.columns:
        rows = rows.withColumn("answer_coordinates", parse_coordinates(F.col("answer_coordinates")))
    return rows


class _Tables(HTMLParser):
    """Cells of every table of a page: kind, text, and where the content stands in the page; nested tables are tables of
    their own, hidden elements are skipped, spans over rows or columns count as one cell."""

    VOID = ("br", "img", "hr", "input", "meta", "link", "wbr", "col")

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.done, self.open, self.hidden = [], [], 0
        self.lines = [0]
        for line in html.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(html)

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        style = dict(attrs).get("style") or ""
        if self.hidden or "display:none" in style.replace(" ", ""):
            self.hidden += tag not in self.VOID
        elif tag == "table":
            self.open.append([])
        elif self.open and tag == "tr":
            self.open[-1].append([])
        elif self.open and tag in ("td", "th") and self.open[-1]:
            begin = self._at() + len(self.get_starttag_text())
            self.open[-1][-1].append([tag, "", begin, begin])

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden -= 1
        elif tag == "table" and self.open:
            self.done.append([[(kind, " ".join(text.split()), a, b) for kind, text, a, b in r] for r in self.open.pop() if r])
        elif tag in ("td", "th") and self.open and self.open[-1] and self.open[-1][-1]:
            self.open[-1][-1][-1][3] = self._at()

    def handle_data(self, data):
        if self.open and not self.hidden and self.open[-1] and self.open[-1][-1]:
            self.open[-1][-1][-1][1] += data


def _laid_out(rows: list[list[tuple]]) -> tuple[str, list[list[tuple]]] | None:
    """(layout, rows) of a rectangular table: pairs of a heading and a cell are an infobox, turned into two rows; else None."""
    if not rows or len({len(r) for r in rows}) != 1:
        return None
    if all([c[0] for c in r] == ["th", "td"] for r in rows):
        return "infobox", [[r[0] for r in rows], [r[1] for r in rows]]
    return "horizontal", rows


def _byte_places(text: str) -> Callable[[int], int]:
    """Where a place of the text stands in its UTF-8 bytes; the text is read once, whatever is asked."""
    if text.isascii():
        return lambda i: i
    wide = [(i, len(c.encode("utf-8", "surrogatepass")) - 1) for i, c in enumerate(text) if c > "\x7f"]
    places, extra = [i for i, _ in wide], [0, *itertools.accumulate(n for _, n in wide)]
    return lambda i: i + extra[bisect.bisect_left(places, i)]


def html_tables(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Rectangular tables of HTML pages as long cells: ``(id, table_index, layout, row_index, column_index, text, begin, end)``.

    ``begin`` and ``end`` are the content's places in the page's UTF-8 bytes (equal for a cell that is never closed).
    Tables are numbered by where they end; the parser is Python's, batch by batch.
    """
    kind = dict(pages.dtypes)[id_col]

    def cut(batches):
        frame = lambda out: pd.DataFrame(out, columns=[id_col, "table_index", "layout", "row_index", "column_index", "text", "begin", "end"])
        for pdf in batches:
            out: list[tuple] = []
            for key, html in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                html = html or ""
                place = _byte_places(html)
                for t, rows in enumerate(_Tables(html).done):
                    if found := _laid_out(rows):
                        for r, row in enumerate(found[1]):
                            out += [(key, t, found[0], r, c, x, place(a), place(b)) for c, (_, x, a, b) in enumerate(row)]
                            if len(out) >= 20_000:  # a page may have any number of cells
                                yield frame(out)
                                out = []
            yield frame(out)

    return pages.select(id_col, html_col).mapInPandas(cut, f"`{id_col}` {kind}, table_index int, layout string, row_index int, column_index int, text string, begin long, end long")


def text_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON message a line (plain or gzip)."""
    return spark.read.schema(schema).json(path)


def parse_message(text: str) -> dict:
    """A message in text format: ``field: value``, ``field { ... }``, repeated fields as lists, enums as their names.

    Every field is a list, as the text alone does not tell single from repeated ones. Raises ValueError on other text.
    """
    import ast
    import re

    token = re.compile(r"""\s*(?:\#[^\n]*\n\s*)*(?:([A-Za-z_][\w.]*)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(-?[\d.][\w.+-]*)|([{}<>:;,\[\]]))""")
    found, at = [], 0
    while at < len(text.rstrip()):
        m = token.match(text, at)
        if m is None:
            raise ValueError(f"no token at {at}")
        found.append((m.lastindex, m[m.lastindex]))
        at = m.end()
    found.append((0, ""))

    def value(i):
        kind, x = found[i]
        if x in "{<" and kind == 4:
            return fields(i + 1, "}" if x == "{" else ">")
        if kind == 2:
            parts = []
            while found[i][0] == 2:  # neighbouring strings are one
                parts.append(ast.literal_eval("b" + found[i][1]) if found[i][1].isascii() else ast.literal_eval(found[i][1]).encode())
                i += 1
            return b"".join(parts).decode("utf-8", "replace"), i
        if kind == 1:
            return {"true": True, "false": False}.get(x, x), i + 1
        if kind == 3:
            plain = x.rstrip("fF") if not x.lower().startswith("0x") else x
            return (int(plain, 0) if re.fullmatch(r"-?(0x[0-9a-fA-F]+|\d+)", plain) else float(plain)), i + 1
        raise ValueError(f"no value at token {i}")

    def fields(i, end):
        out: dict = {}
        while found[i] != ((4, end) if end else (0, "")):
            kind, name = found[i]
            if kind != 1:
                raise ValueError(f"no field at token {i}")
            i += 1 + (found[i + 1] == (4, ":"))
            if found[i] == (4, "["):
                i += 1
                while found[i] != (4, "]"):
                    x, i = value(i)
                    out.setdefault(name, []).append(x)
                    i += found[i] == (4, ",")
                i += 1
            else:
                x, i = value(i)
                out.setdefault(name, []).append(x)
            i += found[i] in ((4, ","), (4, ";"))
        return out, i + bool(end)

    return fields(0, "")[0]


def _shaped(value, kind):
    """A parsed field list in the form of a Spark type."""
    from pyspark.sql import types as T

    if isinstance(kind, T.ArrayType):
        return [_shaped([v], kind.elementType) for v in value or []]
    if not value:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _shaped(value[-1].get(f.name), f.dataType) for f in kind.fields}
    return str(value[-1]) if isinstance(kind, T.StringType) else float(value[-1]) if isinstance(kind, (T.FloatType, T.DoubleType)) else value[-1]


def text_messages(spark: SparkSession, path: str, schema) -> DataFrame:
    """Text-format messages, one a line (plain or gzip), in the form of ``schema`` (a struct type); ``error`` says why a line is none."""
    import json

    from pyspark.sql import types as T

    def read(batches):
        for pdf in batches:
            out, errors = [], []
            for line in pdf.value:
                try:
                    out.append(json.dumps(_shaped([parse_message(line)], schema)))
                    errors.append(None)
                except (ValueError, SyntaxError, AttributeError) as e:
                    out.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"j": out, "error": errors})

    lines = spark.read.text(path).where(F.trim("value") != "").mapInPandas(read, "j string, error string")
    return lines.select(F.from_json("j", T.StructType(schema.fields)).alias("m"), "error").select("m.*", "error")


def split_files(spark: SparkSession, paths: dict[str, list[str]], schema: str, parts: int = 0) -> DataFrame:
    """JSON lines of several files, tagged by their split; gzip files are one task each, so rows may be dealt out anew."""
    import functools

    one = [spark.read.schema(schema).json(files).withColumn("split", F.lit(name)) for name, files in paths.items()]
    rows = functools.reduce(DataFrame.unionByName, one)
    return rows.repartition(parts) if parts else rows


def json_directory(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a file: its columns and ``key``, the file's name without its ending. Equal names are an error."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    keyed = rows.withColumn("key", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))
    from pyspark.sql.window import Window

    once = F.count("*").over(Window.partitionBy("key"))
    return keyed.withColumn("key", F.when(once > 1, F.raise_error(F.concat(F.lit("two files named "), F.col("key")))).otherwise(F.col("key")))


def embedding_tsv(spark: SparkSession, path: str, id_col: str, vector_col: str) -> DataFrame:
    """Vectors written as list literals: ``(id, vector array<double>)``."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return rows.select(id_col, F.from_json(F.regexp_replace(vector_col, r"\s+", " "), "array<double>").alias("vector"))


def reference_lists(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of question lists: ``(question_id, kind)`` for the ``table`` and ``passage`` answers, each once."""
    rows = spark.read.schema("table array<string>, passage array<string>").option("multiLine", True).json(path)
    lists = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("ids")) for k in ("table", "passage")]))
    return rows.select(lists.alias("l")).select(F.explode("l.ids").alias("question_id"), "l.kind").distinct()


def from_arrays(spark: SparkSession, examples: list[dict], schema: str) -> DataFrame:
    """In-memory examples (dictionaries of values and arrays) as rows of a stated schema."""
    return spark.createDataFrame(examples, schema)
