"""Recall: full-text and vector top-k, and the routes of a search as ranked rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TOKEN, query_tokens, tokens
from ..functions.vectors import cosine, dot, euclidean
from ..sources.scratch import written

K1, B = 1.2, 0.75
#: Digits that scores are rounded to before they are ordered, so that the order of sums can't decide a tie.
DIGITS = 6
FIRST_DEPTH, LAST_DEPTH = 200, 2000


def _bounded(term: str) -> str:
    """A regular expression of a term that stands as a token of its own."""
    return rf"(?<![\p{{L}}\p{{N}}_]){re.escape(term)}(?![\p{{L}}\p{{N}}_])"


def _counted(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id_col, dl, tf0 ..): the length of every text in tokens, and how often it has each term.  Tokens are counted, never
    listed, and a term's only in texts that hold its letters."""
    texts = docs.select(id_col, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    counts = [F.when(F.contains(F.col("_text"), F.lit(w)), F.regexp_count("_text", F.lit(_bounded(w)))).otherwise(0).alias(f"tf{i}") for i, w in enumerate(terms)]
    return texts.select(id_col, F.regexp_count("_text", F.lit(TOKEN)).alias("dl"), *counts)


def _statistics(counted: DataFrame, terms: int) -> DataFrame:
    """(n, avgdl, df0 ..) of counted texts: a single row."""
    return counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(terms)])


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", corpus: DataFrame | None = None) -> DataFrame:
    """(id_col, score) of the rows of docs with any token of the query, by BM25 over the statistics of corpus; without a
    corpus over those of docs, whose texts are then read once."""
    if corpus is None:
        return bm25_routes(docs, [query], id_col, text_col)[0]
    terms = query_tokens(query)
    stats = _statistics(_counted(corpus, terms, id_col, text_col), len(terms))
    any_ = F.lit(False)
    for w in terms:
        any_ = any_ | F.contains(F.lower(F.col(text_col)), F.lit(w))
    rows = _counted(docs.where(any_), terms, id_col, text_col)
    return _scored(rows.crossJoin(F.broadcast(stats)), list(range(len(terms))), id_col)  # a single row


def bm25_routes(docs: DataFrame, queries: list[str], id_col: str = "doc_id", text_col: str = "text") -> list[DataFrame]:
    """(id_col, score) for each query.  All of them and their statistics share one pass over the texts: its counts, a few
    numbers a row, go through one exchange that every reader of them uses again."""
    terms = list(dict.fromkeys(w for q in queries for w in query_tokens(q)))
    counted = _counted(docs, terms, id_col, text_col).repartition(id_col)
    stats = _statistics(counted, len(terms))
    both = counted.crossJoin(F.broadcast(stats))  # a single row
    return [_scored(both, [terms.index(w) for w in query_tokens(q)], id_col) for q in queries]


def _scored(rows: DataFrame, terms: list[int], id_col: str) -> DataFrame:
    """(id_col, score) of rows with tf0 .. and the length dl, and the statistics n, avgdl, df0 .. beside them, by the terms
    of these numbers."""
    score: Column = F.lit(0.0)
    for i in terms:
        tf = F.col(f"tf{i}").cast("double")
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # A row with none of the terms has score 0, others more.  As a condition on the score it stays above the exchange, which
    # is the same for all readers then.
    return rows.withColumn("score", score).where("score > 0").select(id_col, F.round("score", DIGITS).alias("score"))


POSTINGS = T.StructType().add("term", T.StringType()).add("docs", T.ArrayType(T.LongType())).add("tfs", T.ArrayType(T.IntegerType()))


def postings(texts: DataFrame, number_col: str = "number", text_col: str = "text") -> DataFrame:
    """(term, docs, tfs): lists of the texts, by their numbers, that have a term, and how often each has it.

    A list is that of one batch of texts, so a term has a row for each batch with it and none of them grows with the rows.
    """

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).flatten().dictionary_encode()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
            codes = coded.indices.to_numpy().astype(np.int64)
            keys, tfs = np.unique(codes * batch.num_rows + doc, return_counts=True)
            term, row = np.divmod(keys, max(1, batch.num_rows))
            ends = np.searchsorted(term, np.arange(len(coded.dictionary) + 1)).astype(np.int32)
            docs = batch.column(0).cast(pa.int64()).to_numpy()[row]
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.ListArray.from_arrays(ends, pa.array(docs)), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))], POSTINGS.names)

    return texts.select(F.col(number_col), F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>"))).mapInArrow(lists, POSTINGS)


def length_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(n, avgdl): one row, the number of texts and their mean length in tokens."""
    return docs.agg(F.count("*").alias("n"), F.avg(text_length(F.col(text_col))).alias("avgdl"))


def text_length(text: Column) -> Column:
    """The tokens of a text; null has none."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN))


def bm25_postings(index: DataFrame, texts: DataFrame, stats: DataFrame, query: str, pool: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """(id_col, score) by BM25 from postings (seq, term, docs, tfs), the texts they speak of (seq, number, id, dl) and the row of
    length statistics, of the ids in pool if there is one.

    Only the query's terms are read; a text that isn't there any more is in no count.
    """
    terms = query_tokens(query)
    known = texts.select("seq", "number", F.col(id_col), "dl")
    if not terms:
        return known.select(id_col, F.lit(0.0).alias("score")).where(F.lit(False))
    mine = index.where(F.col("term").isin(terms)).select("seq", "term", F.inline(F.arrays_zip(F.col("docs").alias("number"), F.col("tfs").alias("tf"))))
    counts = [F.coalesce(F.max(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, w in enumerate(terms)]
    rows = mine.groupBy("seq", "number").agg(*counts).join(known, ["seq", "number"])
    found = rows.agg(*[F.coalesce(F.sum((F.col(f"tf{i}") > 0).cast("long")), F.lit(0)).alias(f"df{i}") for i in range(len(terms))])
    if pool is not None:
        rows = rows.join(pool.select(id_col), id_col, "left_semi")
    return _scored(rows.crossJoin(F.broadcast(found)).crossJoin(F.broadcast(stats)), list(range(len(terms))), id_col)  # single rows


def matrix(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors) of the lists of an array that aren't null, as one array without a Python number for each value."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    column = column.drop_null()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return there, flat.reshape(len(there), -1) if len(there) else np.zeros((0, 0))


def neighbours(
    vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", rows: int = 1 << 16, block: int = 256
) -> DataFrame:
    """(query_id, id_col, score, rank): the k best rows for every query vector, ties going to the smaller id.

    Rows and queries are dealt to parts of about ``rows`` and ``block``, and each pair of parts is one matrix product in
    one task, which gives every query's best k of the part; the bests of parts are ranked per query.
    """
    parts = [1 + df.count() // n for df, n in ((vectors, rows), (queries, block))]
    p, q = [F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int") for n in parts]
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in parts]
    left = vectors.select(F.lit(0).alias("side"), p.alias("p"), every[1].alias("q"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    right = queries.select(F.lit(1).alias("side"), every[0].alias("p"), q.alias("q"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"))

    def best(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        ids, (there, all_) = table["id"].to_numpy(), matrix(table["v"])
        known, asked = there[side[there] == 0], there[side[there] == 1]
        known = known[np.argsort(ids[known], kind="stable")]
        out: list[tuple] = []
        if len(known) and len(asked):
            place = np.zeros(len(table), np.int64)
            place[there] = np.arange(len(there))
            a, b = all_[place[known]], all_[place[asked]]
            score = b @ a.T
            if metric == "cosine":
                length = np.linalg.norm(b, axis=1)[:, None] * np.linalg.norm(a, axis=1)[None]
                score = np.divide(score, length, out=np.zeros_like(score), where=length > 0)
            elif metric == "euclidean":
                score = np.array([0.0 - np.sqrt(((a - x) ** 2).sum(1)) for x in b])
            score = np.round(score, DIGITS)
            for i, row in zip(asked, score):
                for j in np.argsort(-row, kind="stable")[:k]:
                    out.append((ids[i], ids[known[j]], float(row[j])))
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(columns[0], table["id"].type), pa.array(columns[1], table["id"].type), pa.array(columns[2], pa.float64())], names=["query_id", id_col, "score"])

    schema = T.StructType([T.StructField("query_id", queries.schema[id_col].dataType), T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    found = left.unionByName(right).groupBy("p", "q").applyInArrow(best, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_scores(vectors: DataFrame, query: DataFrame, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, score) of every row for a query of one vector; of distances the score is the negative."""
    one = query.select(F.col(vector_col).alias("_q")).limit(1)
    measure = {"cosine": cosine, "dot": dot, "euclidean": lambda a, b: F.lit(0.0) - euclidean(a, b)}[metric]
    rows = vectors.select(id_col, vector_col).crossJoin(F.broadcast(one))  # a single row
    return rows.select(id_col, F.round(measure(F.col(vector_col), F.col("_q")), DIGITS).alias("score"))


def top(scored: DataFrame, k: int, id_col: str) -> DataFrame:
    """The k best rows with their rank; ties go to the smaller id.  k is at most LAST_DEPTH or a report's length, so the
    window runs over what the top-k left."""
    best = scored.orderBy(F.desc("score"), F.asc(id_col)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(id_col))))


def route(scored: DataFrame, name: str, path: str, id_col: str, depth: int = LAST_DEPTH) -> DataFrame:
    """(route, path, id, rank, score): a route's hits to a depth."""
    ranked = top(scored, depth, id_col)
    return ranked.select(F.lit(name).alias("route"), F.lit(path).alias("path"), F.col(id_col).alias("id"), "rank", "score")


def collapse(hits: DataFrame, members: DataFrame, id_col: str = "id", group_col: str = "group") -> DataFrame:
    """hits with the id that is ranked: the group's, whose major member must exist, or the member's own."""
    public = members.select(F.col(id_col).alias("_id"), F.coalesce(group_col, id_col).alias("public_id"))
    major = members.where(F.col(group_col).isNull() | (F.col(group_col) == F.col(id_col))).select(F.col(id_col).alias("public_id"))
    return hits.join(public, F.col("id") == F.col("_id")).drop("_id").join(major, "public_id", "left_semi")


def majors(members: DataFrame, id_col: str = "id", group_col: str = "group") -> DataFrame:
    """(id, major) of members whose group, or its group, and so on, is a major member, which has none or itself.

    Pointers are doubled, so a chain of n takes log n joins and a table of ids written for each.  Members of a cycle, of a
    group that isn't there, or of what leads to either have no major: once a step leads no one further to an end, those who
    are left never get there.
    """
    at = written(members.select(F.col(id_col).alias("id"), F.coalesce(F.col(group_col), F.col(id_col)).alias("up")), "majors")
    ends = at.where("id = up").select(F.col("id").alias("end")).distinct()
    open_ = -1
    while True:
        done = at.join(ends, F.col("up") == F.col("end"), "left")
        left = done.where("end IS NULL").count()
        if left in (0, open_):
            return done.where("end IS NOT NULL").select("id", F.col("up").alias("major"))
        open_ = left
        ahead = at.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
        at = written(at.join(ahead, F.col("up") == F.col("_id")).select("id", F.col("_up").alias("up")), "majors")


def adaptive_depth(hits: DataFrame, limit: int, id_col: str = "id") -> DataFrame:
    """(depth, candidates): the first of the depths 200, 400 .. 2000 at which the routes have max(5 * limit, 50) candidates
    or none of them reaches the depth.  Routes are ranked once, to the last depth; a depth is a filter on ranks."""
    depths = [FIRST_DEPTH]
    while depths[-1] < LAST_DEPTH:
        depths.append(min(LAST_DEPTH, 2 * depths[-1]))
    first = hits.groupBy(id_col).agg(F.min("rank").alias("rank"))
    counts = first.agg(*[F.sum((F.col("rank") <= d).cast("long")).alias(f"c{d}") for d in depths])
    sizes = hits.groupBy("route").agg(F.max("rank").alias("n")).agg(F.max("n").alias("longest"))
    both = counts.crossJoin(sizes)  # a row each
    depth: Column = F.lit(depths[-1])
    for d in reversed(depths):
        depth = F.when((F.col(f"c{d}") >= max(5 * limit, 50)) | (F.col("longest") < d), F.lit(d)).otherwise(depth)
    chosen = F.lit(0).cast("long")
    for d in depths:
        chosen = F.when(depth == d, F.coalesce(F.col(f"c{d}"), F.lit(0))).otherwise(chosen)
    return both.select(depth.alias("depth"), chosen.alias("candidates"))
