"""Retrieval: posting lists, BM25, TF-IDF cosine, vector neighbours, negatives, rank metrics.

Queries are the small side; a side is broadcast only where ``broadcast_rows`` says how many rows it may have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import checkpoint


#: Terms whose weights (some 40 bytes each) are broadcast; a larger vocabulary meets the documents' terms by a shuffle.
BROADCAST_TERMS = 1_000_000


#: Rows of a shuffle that one task holds: some 100 MB with the sort's copies.
TASK_ROWS = 1_000_000


def partitions(df: DataFrame, rows: int, most: int = TASK_ROWS) -> int:
    """Partitions in which ``rows`` rows stand ``most`` together, the session's number at least: a task's share does not grow."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A broadcast hint for a side of at most ``most`` rows; other sides are joined by Spark's own choice."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Tokens of the documents that a task counts at a time, unless one has more.
COUNTED = 200_000


def _token_slices(batch, most: int | None = None):
    """Slices of an Arrow batch whose lists ``_t`` hold some ``most`` tokens in all: only a slice's become Python objects."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("_t")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + (most or COUNTED), "right")))
        yield batch.slice(start, end - start)
        start = end


def term_counts(docs: DataFrame, doc_id: str, tokens: Column) -> DataFrame:
    """``(doc_id, token, tf, dl)`` with the document's length: terms are counted inside the row, so no text is moved.

    One row for every document and token, of a document one after another. A document without tokens has none.
    """
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    ready = docs.select(F.col(doc_id), tokens.alias("_t"))
    fields = ready.select(doc_id).schema.add("token", "string").add("tf", "long").add("dl", "long")

    def run(batches):
        for b in (part for whole in batches for part in _token_slices(whole)):
            lists = b.column("_t").to_pylist()
            counts = [Counter(t) if t else {} for t in lists]
            sizes = np.fromiter(map(len, counts), np.int64, len(counts))
            rows = np.repeat(np.arange(len(counts)), sizes)
            lengths = np.fromiter((len(t or ()) for t in lists), np.int64, len(lists))
            words, tf = pa.array([w for c in counts for w in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(doc_id).take(pa.array(rows)), words, tf, pa.array(lengths[rows])], names=[doc_id, "token", "tf", "dl"])

    return ready.mapInArrow(run, fields)


def vocabulary(docs: DataFrame, tokens: Column, limit: int = 500_000) -> DataFrame:
    """``(token, df, cf)``, and one row of a null token with the number of documents and of all tokens; read once, kept.

    Counted inside each task first, in a table that is sent on whenever it holds ``limit`` tokens.
    """
    from collections import Counter

    import pyarrow as pa

    def rows(df, cf):
        return pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64()), pa.array([cf[w] for w in df], pa.int64())], names=["token", "df", "cf"])

    def run(batches):
        df, cf = Counter(), Counter()
        for b in (part for whole in batches for part in _token_slices(whole)):
            for words in b.column("_t").to_pylist():
                df[None] += 1
                cf[None] += len(words or ())
                cf.update(words or ())
                df.update(set(words or ()))
                if len(df) > limit:
                    yield rows(df, cf)
                    df, cf = Counter(), Counter()
        if df:
            yield rows(df, cf)

    part = docs.select(tokens.alias("_t")).mapInArrow(run, "token string, df long, cf long")
    return checkpoint(part.groupBy("token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")))


def asked_terms(queries: DataFrame, query_id: str, tokens: Column) -> DataFrame:
    """``(query_id, token, times)``; repeated query tokens count again."""
    return queries.select(F.col(query_id), F.explode(tokens).alias("token")).groupBy(query_id, "token").agg(F.count("*").alias("times"))


def _only(terms: DataFrame, asked: DataFrame | None) -> DataFrame:
    """Rows of tokens that somebody asks for; all without a question."""
    return terms if asked is None else terms.join(small(asked.select("token").distinct(), 100_000), "token", "left_semi")


def postings(docs: DataFrame, doc_id: str, tokens: Column, min_rank: int = 0, drop_frequency: bool = True, asked: DataFrame | None = None) -> DataFrame:
    """``(token, doc_id, weight)``: 1 / (log2(collection frequency) + 1), times the count unless dropped.

    ``min_rank`` most frequent tokens are left out; frequency ties are ordered by token. With ``asked``, only its
    tokens get weights.
    """
    pairs = term_counts(docs, doc_id, tokens)
    if not min_rank and asked is not None:
        pairs = checkpoint(_only(pairs, asked))  # what is asked for, read once; other terms go no further than their task
    frequency = pairs.groupBy("token").agg(F.sum("tf").alias("cf"))
    if min_rank:
        top = frequency.orderBy(F.desc("cf"), "token").limit(min_rank).select("token")
        frequency = _only(frequency.join(top, "token", "left_anti"), asked)
    weight = F.lit(1.0) / (F.log2("cf") + 1)
    return pairs.join(frequency, "token").select("token", doc_id, (weight if drop_frequency else weight * F.col("tf")).alias("weight"))


def lookup(asked: DataFrame, query_id: str, index: DataFrame, doc_id: str, weight: str) -> DataFrame:
    """Summed weights for each query and document."""
    return index.join(small(asked, 100_000), "token").groupBy(query_id, doc_id).agg(F.sum(F.col("times") * F.col(weight)).alias("score"))


def bm25_index(docs: DataFrame, doc_id: str, tokens: Column, k1: float = 1.5, b: float = 0.75, eps: float = 0.25, asked: DataFrame | None = None) -> DataFrame:
    """``(token, doc_id, weight)``; negative idf becomes ``eps`` times the mean idf, which is that of all tokens.

    Documents without tokens count towards the average length. With ``asked``, only its tokens get weights.
    """
    words = vocabulary(docs, tokens)
    whole = words.where("token is null").select(F.col("df").alias("n"), (F.col("cf") / F.col("df")).alias("avgdl"))
    idf = words.where("token is not null").crossJoin(F.broadcast(whole))  # whole: one row
    idf = idf.withColumn("idf", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    idf = _only(idf, asked).crossJoin(F.broadcast(mean)).select("token", "avgdl", F.when(F.col("idf") < 0, F.lit(eps) * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    share = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    met = term_counts(docs, doc_id, tokens).join(small(idf, BROADCAST_TERMS), "token")  # terms that nobody asks for end here
    return met.select("token", doc_id, (F.col("idf") * share).alias("weight"))


def tfidf_index(docs: DataFrame, doc_id: str, tokens: Column, min_df: int = 1, max_df: float = 1.0, asked: DataFrame | None = None, task_rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(unit document vectors ``(token, doc_id, weight)``, ``(token, idf)``) with idf ln((1+n)/(1+df)) + 1.

    Norms are those of whole documents; with ``asked``, only its tokens have rows. Documents are counted once; their terms meet
    the weights, and then each other, in as many partitions as keep some ``task_rows`` of them in a task.
    """
    words = vocabulary(docs, tokens)
    whole = words.where("token is null").select(F.col("df").alias("n"))
    idf = words.where("token is not null").crossJoin(F.broadcast(whole)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))  # whole: one row
    idf = idf.select("token", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    terms, rows = words.where("token is not null").agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    shuffled = lambda df, key: df.repartition(partitions(df, rows, task_rows), key)
    told = idf.withColumn("_asked", F.lit(True)) if asked is None else idf.join(small(asked.select("token").distinct().withColumn("_asked", F.lit(True)), 100_000), "token", "left")
    counts = term_counts(docs, doc_id, tokens).select(doc_id, "token", "tf")
    met = counts.join(F.broadcast(told), "token") if terms <= BROADCAST_TERMS else shuffled(counts, "token").join(shuffled(told, "token").hint("merge"), "token")
    w = F.col("tf") * F.col("idf")
    # terms that nobody asks for only add to their document's norm
    kept = shuffled(met.select(doc_id, F.when(F.col("_asked"), F.col("token")).alias("token"), w.alias("w")), doc_id)
    sums = kept.groupBy(doc_id, "token").agg(F.sum(F.col("w") * F.col("w")).alias("_s"), F.max("w").alias("w"))
    norm = F.sqrt(F.sum("_s").over(Window.partitionBy(doc_id)))
    return sums.withColumn("weight", F.col("w") / norm).where("token is not null").select("token", doc_id, "weight"), idf


def cosine(asked: DataFrame, query_id: str, index: DataFrame, idf: DataFrame, doc_id: str) -> DataFrame:
    raw = asked.join(idf, "token").withColumn("w", F.col("times") * F.col("idf"))
    norm = raw.groupBy(query_id).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = raw.join(norm, query_id).select(query_id, "token", (F.col("w") / F.col("norm")).alias("_unit"))
    return index.join(small(unit, 100_000), "token").groupBy(query_id, doc_id).agg(F.sum(F.col("_unit") * F.col("weight")).alias("score"))


def expand(tokens: Column, low: int, high: int) -> Column:
    """Word n-grams of ``low`` to ``high`` words, joined by a blank."""
    grams = lambda n: F.transform(F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.concat(*[grams(n) for n in range(low, high + 1)])


def char_grams(x: str | Column, low: int, high: int, inside_words: bool = False) -> Column:
    """Runs of ``low`` to ``high`` characters of a text in lower case with single blanks.

    ``inside_words`` takes them from each word with a blank before and behind it; of a word that is no longer than a
    run, itself is the last one.
    """
    c = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))), r"(?U)\s+", " "))
    runs = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, n))
    sizes = F.sequence(F.lit(low), F.lit(high))
    if not inside_words:
        return F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.length(c)), lambda n: runs(c, n)))
    words = F.transform(F.filter(F.split(c, " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(words, lambda w: F.flatten(F.transform(F.filter(sizes, lambda n: (n <= F.length(w)) | (n == low)), lambda n: runs(w, n)))))


def best(scores: DataFrame, query_id: str, doc_id: str, k: int, digits: int = 6, above: float | None = None, exact: int = 9) -> DataFrame:
    """The ``k`` best, ties to the smaller id, with ``rank`` from 1; scores are shown with ``digits`` digits.

    They are ranked by ``exact`` digits: enough to tell scores apart, and few enough that the order in which a score's
    parts were added does not.
    """
    s = scores.withColumn("_exact", F.round("score", max(exact, digits)))
    s = s if above is None else s.where(F.col("_exact") > above)
    order = Window.partitionBy(query_id).orderBy(F.desc("_exact"), doc_id)
    return s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("score", F.round("_exact", digits)).drop("_exact")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def usable(vector: str | Column) -> Column:
    """Whether a vector can be compared: neither null nor empty, without null or non-finite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


#: Scores of queries and points that a task holds at a time (8 bytes each, and as much again for their order).
SCORES = 1 << 20


def neighbours(queries: DataFrame, query_id: str, points: DataFrame, point_id: str, vector: str, k: int, digits: int = 6, shard_rows: int = 16_384) -> DataFrame:
    """The ``k`` best inner products of a stated query set against all points, a point of the query's own id left out.

    Points are dealt to shards of bounded size; in each, queries stream past as matrix products and keep a top k, so
    no side is broadcast and no pair becomes a row. Scores are rounded before ranking, ties go to the smaller id.
    Vectors that are null, empty or hold null or non-finite components take no part; a query meets points of its own length.
    """
    import math

    import numpy as np
    import pyarrow as pa

    points, queries = points.where(usable(vector)), queries.where(usable(vector))
    rows = points.count()
    shards = max(1, math.ceil(rows / shard_rows), min(points.sparkSession.sparkContext.defaultParallelism, rows // 1024))
    home = F.pmod(F.xxhash64(point_id), F.lit(shards)).cast("int")
    side = lambda df, key, shard, kind: df.select(shard.alias("shard"), F.size(vector).alias("dim"), F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = side(points, point_id, home, 0).unionByName(side(queries, query_id, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), 1))

    def best_of(own, v, ids, matrix):
        """(query, point, score) of the k best for each query of a block, all at once."""
        scores = np.round(v @ matrix.T, digits)
        scores[own[:, None] == ids[None, :]] = -np.inf
        cut = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(own), -np.inf)
        q, p = np.nonzero((scores >= cut[:, None]) & (scores > -np.inf))
        order = np.lexsort((ids[p], -scores[q, p], q))
        q, p = q[order], p[order]
        first = np.searchsorted(q, q)  # where the query's run begins
        kept = np.arange(len(q)) - first < k
        return own[q[kept]], ids[p[kept]], scores[q[kept], p[kept]]

    def run(batches):
        at, ids, held, matrix = None, [], [], None
        for b in batches:
            marks = np.stack([b.column(c).to_numpy() for c in ("shard", "dim", "kind")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                part = b.slice(start, end - start)
                own, v = part.column("id").to_numpy(), part.column("v").flatten().to_numpy().reshape(end - start, -1)
                if tuple(marks[:2, start]) != at:
                    at, ids, held, matrix = tuple(marks[:2, start]), [], [], None
                if marks[2, start] == 0:
                    ids.append(own.copy())
                    held.append(v.copy())
                elif held or matrix is not None:
                    if matrix is None:
                        matrix = np.concatenate(ids), np.concatenate(held)
                        ids, held = [], []  # the points are kept once
                    step = max(1, SCORES // len(matrix[0]))
                    for i in range(0, len(own), step):
                        found = best_of(own[i : i + step], v[i : i + step], *matrix)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=[query_id, point_id, "score"])

    found = rows.repartition(shards, "shard").sortWithinPartitions("shard", "dim", "kind").mapInArrow(run, f"`{query_id}` long, `{point_id}` long, score double")
    return best(found, query_id, point_id, k, digits)


def hit_rate(ranked: DataFrame, query_id: str, hit: Column, ks: list[int]) -> DataFrame:
    """Share of queries with a hit among the first k, by k."""
    first = ranked.groupBy(query_id).agg(F.min(F.when(hit, F.col("rank"))).alias("first"))
    rates = F.array(*[F.struct(F.lit(k).alias("k"), F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias("rate")) for k in ks])
    return first.agg(rates.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def hard_negatives(ranked: DataFrame, query_id: str, doc_id: str, gold: DataFrame, n: int) -> DataFrame:
    """The first ``n`` ranked documents of each query that are not gold for it, renumbered from 0."""
    left = ranked.join(gold, [query_id, doc_id], "left_anti")
    order = Window.partitionBy(query_id).orderBy("rank")
    return left.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < n)


def merge_queries(queries: DataFrame, query_id: str, vector: str, dim: int) -> DataFrame:
    """Mean vectors (all ``dim`` components) of the rows of one query id, without exploding."""
    return queries.groupBy(query_id).agg(F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(dim)]).alias("mean"), F.count("*").alias("n"))


def search(docs: DataFrame, group: str, doc_id: str, tokens: Column, queries: DataFrame, query_tokens: Column, n: int, low: int = 1, high: int = 2, min_df: int = 1, max_df: float = 0.9, above: float = 0.0, analyzer: str = "word") -> DataFrame:
    """``(group, doc_id, score, rank)``: in each group the ``n`` documents of a TF-IDF cosine above ``above`` to its query.

    Each group (a question, say, with the sentences of its descriptions) is an index of its own over word n-grams of
    ``low`` to ``high`` words; grams in fewer than ``min_df`` documents or more than ``max_df`` of them do not count,
    but in an index of one document all do. With the ``analyzer`` ``char`` or ``char_wb`` both token columns are texts, and
    grams are runs of characters, across words or inside each.
    """
    kinds = {"word": expand, "char": char_grams, "char_wb": lambda x, a, b: char_grams(x, a, b, True)}
    grams = lambda x: kinds[analyzer](x, low, high)
    terms = docs.select(F.col(group), F.col(doc_id), F.explode(grams(tokens)).alias("token")).groupBy(group, doc_id, "token").agg(F.count("*").alias("tf"))
    size = docs.groupBy(group).agg(F.count_distinct(doc_id).alias("_n"))
    df = terms.groupBy(group, "token").agg(F.count("*").alias("_df")).join(size, group)
    df = df.where((F.col("_n") == 1) | ((F.col("_df") >= min_df) & (F.col("_df") <= max_df * F.col("_n"))))
    idf = df.select(group, "token", (F.ln((1 + F.col("_n")) / (1 + F.col("_df"))) + 1).alias("idf"))
    weighted = lambda t, keys: t.join(idf, [group, "token"]).withColumn("w", F.col("tf") * F.col("idf")).select(*keys, "token", "w")
    length = lambda w, keys, name: w.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(name))
    d = weighted(terms, [group, doc_id])
    q = weighted(queries.select(F.col(group), F.explode(grams(query_tokens)).alias("token")).groupBy(group, "token").agg(F.count("*").alias("tf")), [group])
    dots = d.join(q.withColumnRenamed("w", "_q"), [group, "token"]).groupBy(group, doc_id).agg(F.sum(F.col("w") * F.col("_q")).alias("dot"))
    scores = dots.join(length(d, [group, doc_id], "_d"), [group, doc_id]).join(length(q, [group], "_l"), group)
    return best(scores.select(group, doc_id, (F.col("dot") / (F.col("_d") * F.col("_l"))).alias("score")), group, doc_id, n, above=above)


def describe_cells(cells: DataFrame, questions: DataFrame, descriptions: DataFrame, n: int = 3, with_title: bool = True) -> DataFrame:
    """Cell texts followed by `` ( title : sentences )`` of the entities they name, the ``n`` sentences nearest the question.

    ``cells``: ``question_id, row_index, column_index, text, entities array<string>``; ``questions``: ``question_id,
    question``; ``descriptions``: ``question_id, identifier, title, text``. Sentences stay in the order of their text;
    entities without a chosen sentence add nothing.
    """
    from ..functions import text as texts

    one = descriptions.select("question_id", "identifier", "title", F.posexplode(texts.sentences("text")).alias("place", "sentence"))
    one = one.withColumn("at", F.concat_ws("#", "identifier", F.lpad(F.col("place").cast("string"), 6, "0")))
    words = lambda c: texts.tokenize(c)
    near = search(one, "question_id", "at", words(F.col("sentence")), questions, words(F.col("question")), n).select("question_id", "at")
    chosen = one.join(near, ["question_id", "at"]).groupBy("question_id", "identifier").agg(F.max("title").alias("title"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "sentence"))), lambda x: x["sentence"]), " ").alias("said"))
    note = F.concat(F.lit(" ( "), F.when(F.lit(with_title) & F.col("title").isNotNull(), F.concat("title", F.lit(" : "))).otherwise(""), F.col("said"), F.lit(" )"))
    asked = cells.select("question_id", "row_index", "column_index", F.posexplode("entities").alias("_e", "identifier")).join(chosen.withColumn("note", note), ["question_id", "identifier"])
    notes = asked.groupBy("question_id", "row_index", "column_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_e", "note"))), lambda x: x["note"]), "").alias("_notes"))
    return cells.join(notes, ["question_id", "row_index", "column_index"], "left").withColumn("text", F.concat("text", F.coalesce("_notes", F.lit("")))).drop("_notes")
