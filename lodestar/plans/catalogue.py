"""The queries of this library by name, each over whole tables, and the SQL that says the same.

The tables hold documents, not files, so views give every document a path, a size and a time; both sides define them
alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, embed, fusion, index, lexical, recall, segments, vector_lists
from ..sources import files as S
from ..sources.scratch import scratch
from ..streaming import bursts, changes
from . import search

QUERY_A, QUERY_B = "thanedble attion erster", "les dans être"
GREP = "thanedble|Ouenti"
BASE_MS = 1_700_000_000_000


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; every third is Markdown by name, every seventh code."""
    name = F.when(F.col("doc_id") % 7 == 0, "py").when(F.col("doc_id") % 3 == 0, "md").otherwise("txt")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit("."), name))
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", "lang", "source", "n_chars", path.alias("path"), (F.lit(BASE_MS) + F.col("doc_id") % 1440 * 1000).alias("last_modified"))


FILES = f"""files AS (
  SELECT doc_id, text, lang, source, n_chars, {BASE_MS} + doc_id % 1440 * 1000 AS last_modified,
         source || '/' || lang || '/' || doc_id || '.' || CASE WHEN doc_id % 7 = 0 THEN 'py' WHEN doc_id % 3 = 0 THEN 'md' ELSE 'txt' END AS path
  FROM documents)"""


def _bm25_sql(name: str, query: str, where: str = "TRUE") -> str:
    terms = X.query_tokens(query)
    df = ", ".join(f"sum(CAST(list_contains(t, '{w}') AS BIGINT)) AS df{i}" for i, w in enumerate(terms))
    parts = []
    for i, w in enumerate(terms):
        tf = f"CAST(len(list_filter(t, lambda x: x = '{w}')) AS DOUBLE)"
        parts.append(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * {tf} * 2.2 / ({tf} + 1.2 * (1 - 0.75 + 0.75 * len(t) / avgdl))")
    listed = ", ".join(f"'{w}'" for w in terms)
    return f"""{name}_t AS (SELECT *, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS t FROM files),
{name}_n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl, {df} FROM {name}_t),
{name} AS (SELECT doc_id, round({' + '.join(parts)}, 6) AS score FROM {name}_t, {name}_n
  WHERE list_has_any(t, [{listed}]) AND ({where}))"""


def _top_sql(name: str, scored: str, id_: str, k: int) -> str:
    return f"{name} AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, {id_}) AS INTEGER) AS rank FROM (SELECT * FROM {scored} ORDER BY score DESC, {id_} LIMIT {k}))"


def _products(f: str) -> str:
    return f"list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: {f}))"


_DOT = _products("CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)")
_SELF = "sqrt(list_sum(list_transform({}.embedding, lambda p: CAST(p AS DOUBLE) * CAST(p AS DOUBLE))))"
METRICS = {
    "cosine": f"CASE WHEN {_SELF.format('v')} * {_SELF.format('q')} = 0 THEN 0.0 ELSE {_DOT} / ({_SELF.format('v')} * {_SELF.format('q')}) END",
    "dot": _DOT,
    "euclidean": "0.0 - sqrt(" + _products("(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))") + ")",
}


def _vector_sql(name: str, metric: str = "cosine", where: str = "TRUE", query: int = 0) -> str:
    return f"{name} AS (SELECT v.vec_id, round({METRICS[metric]}, 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = {query}) q WHERE {where})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# Recall


@query(f"WITH {FILES}, {_bm25_sql('s', QUERY_A)}, {_top_sql('r', 's', 'doc_id', 20)} SELECT doc_id, score, rank FROM r")
def bm25_topk(spark, sf):
    return recall.top(recall.bm25(documents(spark, sf), QUERY_A), 20, "doc_id")


_FILTER = "lang IN ('en', 'fr') AND last_modified BETWEEN 1700000010000 AND 1700000400000 AND regexp_matches(path, '^src1[^/]*/')"


def _filtered(docs: DataFrame) -> DataFrame:
    keep = X.matches_path(F.col("path"), "src1*/**") & F.col("last_modified").between(BASE_MS + 10_000, BASE_MS + 400_000)
    return docs.where(keep & F.col("lang").isin("en", "fr"))


@query(f"WITH {FILES}, {_bm25_sql('s', QUERY_A, _FILTER)}, {_top_sql('r', 's', 'doc_id', 20)} SELECT doc_id, score, rank FROM r")
def bm25_filtered(spark, sf):
    docs = documents(spark, sf)
    return recall.top(recall.bm25(_filtered(docs), QUERY_A, corpus=docs), 20, "doc_id")


@query(
    f"WITH {FILES}, {_bm25_sql('a', QUERY_A)}, {_bm25_sql('b', QUERY_B)}, {_top_sql('ra', 'a', 'doc_id', 50)}, {_top_sql('rb', 'b', 'doc_id', 50)} "
    "SELECT 'fts' AS route, 'fts' AS path, doc_id AS id, rank, score FROM ra UNION ALL SELECT 'fts-2', 'fts', doc_id, rank, score FROM rb"
)
def bm25_multi_route(spark, sf):
    a, b = recall.bm25_routes(documents(spark, sf), [QUERY_A, QUERY_B])
    return recall.route(a, "fts", "fts", "doc_id", 50).unionByName(recall.route(b, "fts-2", "fts", "doc_id", 50))


def _vectors(spark, sf, metric="cosine", where=None, number=0):
    vectors = _t(spark, sf, "embeddings")
    return recall.vector_scores(vectors.where(where) if where is not None else vectors, vectors.where(F.col("vec_id") == number), metric)


def _nearest(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf):
        vectors = _t(spark, sf, "embeddings")
        return recall.neighbours(vectors, vectors.where("vec_id % 100 = 0"), 20, metric)

    return run


for _metric in METRICS:
    _name = f"vector_topk_{'l2' if _metric == 'euclidean' else _metric}"
    QUERIES[_name] = _nearest(_metric)
    SQL[_name] = (
        f"WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round({METRICS[_metric]}, 6) AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q), "
        "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 20"
    )


_KEPT = FILES.replace("FROM documents)", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))")


@query(f"WITH {_KEPT}, {_bm25_sql('s', QUERY_A)}, {_top_sql('r', 's', 'doc_id', 20)} SELECT doc_id AS id, score, rank FROM r")
def bm25_from_postings(spark, sf):
    """Top k from a log of postings, as a workspace stores it: every text is stale at first, two updates replace the English
    ones and the rest, and what is labelled as poor is removed."""
    docs = documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("file_id"), "lang", "text")
    log = segments.Log(spark, scratch(spark, "postings"), {"texts": segments.Order(), "postings": segments.POSTED}, derived={"postings": ("texts", recall.postings)})
    rows = lambda df: {"texts": df.withColumn("dl", recall.text_length(F.col("text")))}
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    log = log.append(rows(docs.withColumn("text", F.concat_ws(" ", "text", "text"))))
    for mine in (english, ~english):
        log = log.append(rows(docs.where(mine)), docs.where(mine).select("file_id", F.lit(True).alias("whole")))
    poor = _t(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("file_id")).distinct()
    log = log.append({}, poor.withColumn("whole", F.lit(True)))
    texts = log.read("texts", numbers=True)
    stats = texts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return recall.top(recall.bm25_postings(log.read("postings", numbers=True), texts, stats, QUERY_A), 20, "id")


def _listed(spark, sf, probes: int | None = None) -> DataFrame:
    """The 20 nearest vectors of every stated query from an index of lists, by that many probes or by as many as fit."""
    vectors = _t(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 100 = 0")
    centers = vector_lists.centroids(vectors)
    listed = vector_lists.write_lists(vectors, centers, scratch(spark, "lists"))
    return vector_lists.search(listed, centers, vectors, asked, 20, probes or vector_lists.fitted_probes(listed, centers, vectors, 20))


@query(SQL["vector_topk_cosine"])
def vector_lists_all(spark, sf):
    """Every list is probed, so the answer is the exact one."""
    return _listed(spark, sf, vector_lists.Settings().max_lists)


@query("SELECT count(*) AS queries, TRUE AS recalled FROM embeddings WHERE vec_id % 100 = 0")
def vector_lists_recall(spark, sf):
    """Whether a search of the lists finds 0.9 of what the exact one does, over all stated queries."""
    vectors = _t(spark, sf, "embeddings")
    exact = recall.neighbours(vectors, vectors.where("vec_id % 100 = 0"), 20).select("query_id", "vec_id")
    found = _listed(spark, sf).select("query_id", "vec_id", F.lit(1).alias("found"))
    share = F.count("found") >= 0.9 * F.count("*")
    return exact.join(found, ["query_id", "vec_id"], "left").agg(F.count_distinct("query_id").alias("queries"), share.alias("recalled"))


@query(f"WITH {_vector_sql('s', where='v.label IN (1, 2, 3)')}, {_top_sql('r', 's', 'vec_id', 20)} SELECT vec_id, score, rank FROM r")
def vector_filtered(spark, sf):
    return recall.top(_vectors(spark, sf, where=F.col("label").isin(1, 2, 3)), 20, "vec_id")


# Fusion

ROUTES = ["fts", "vector"]


def _hits(spark, sf, depth=200):
    fts = recall.route(recall.bm25(documents(spark, sf), QUERY_A), "fts", "fts", "doc_id", depth)
    return fts.unionByName(recall.route(_vectors(spark, sf), "vector", "vector", "vec_id", depth))


_HITS = (
    f"{FILES}, {_bm25_sql('a', QUERY_A)}, {_vector_sql('v')}, {_top_sql('ra', 'a', 'doc_id', 200)}, {_top_sql('rv', 'v', 'vec_id', 200)}, "
    "hits AS (SELECT 'fts' AS route, doc_id AS id, rank FROM ra UNION ALL SELECT 'vector', vec_id, rank FROM rv), "
    "best AS (SELECT id, min(rank) FILTER (route = 'fts') AS r0, min(rank) FILTER (route = 'vector') AS r1 FROM hits GROUP BY id), "
    "fused AS (SELECT id, round(coalesce(1.0::DOUBLE / (60 + r0), 0) + coalesce(1.0::DOUBLE / (60 + r1), 0), 9) AS score, "
    "CASE WHEN r0 IS NOT NULL AND r1 IS NOT NULL THEN 'fts+vector' WHEN r0 IS NOT NULL THEN 'fts' ELSE 'vector' END AS matched_by FROM best), "
    "ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM fused)"
)


@query(f"WITH {_HITS} SELECT id, score, matched_by, rank FROM ranked WHERE rank <= 7")
def hybrid_rrf(spark, sf):
    return fusion.ranked(fusion.fuse(_hits(spark, sf), ROUTES), 7)


@query(f"WITH {_HITS} SELECT matched_by, count(*) AS n, max(score) AS best FROM fused GROUP BY matched_by")
def hybrid_matched_by(spark, sf):
    return fusion.fuse(_hits(spark, sf), ROUTES).groupBy("matched_by").agg(F.count("*").alias("n"), F.max("score").alias("best"))


TRACKED = 77


@query(
    f"WITH {_HITS.replace('best AS (', f'forced AS (SELECT * FROM hits UNION ALL SELECT r, {TRACKED}, 201 FROM (VALUES (' + chr(39) + 'fts' + chr(39) + '), (' + chr(39) + 'vector' + chr(39) + ')) x(r) WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.id = {TRACKED} AND h.route = x.r)), best AS (', 1).replace('FROM hits GROUP BY id', 'FROM forced GROUP BY id')} "
    f"SELECT id, score, matched_by, rank FROM ranked WHERE rank <= 7 OR id = {TRACKED}"
)
def hybrid_tracked(spark, sf):
    hits = fusion.force(_hits(spark, sf), [("fts", "fts"), ("vector", "vector")], TRACKED, 200)
    return fusion.ranked(fusion.fuse(hits, ROUTES), 7, tracked=TRACKED)


SQL["hybrid_tracked"] = SQL["hybrid_tracked"].replace("{TRACKED}", str(TRACKED))


@query(
    f"WITH {FILES}, {_bm25_sql('a', QUERY_A)}, {_vector_sql('v')}, {_top_sql('ra', 'a', 'doc_id', 2000)}, {_top_sql('rv', 'v', 'vec_id', 2000)}, "
    "hits AS (SELECT 'fts' AS route, doc_id AS id, rank FROM ra UNION ALL SELECT 'vector', vec_id, rank FROM rv), "
    "firsts AS (SELECT id, min(rank) AS rank FROM hits GROUP BY id), longest AS (SELECT max(n) AS n FROM (SELECT max(rank) AS n FROM hits GROUP BY route)), "
    "steps AS (SELECT d, (SELECT count(*) FROM firsts WHERE rank <= d) AS c FROM (VALUES (200), (400), (800), (1600), (2000)) s(d)) "
    "SELECT CAST(d AS INTEGER) AS depth, CAST(c AS BIGINT) AS candidates FROM steps, longest WHERE c >= 50 OR longest.n < d OR d = 2000 ORDER BY d LIMIT 1"
)
def adaptive_depth(spark, sf):
    return recall.adaptive_depth(_hits(spark, sf, recall.LAST_DEPTH), 10)


def _turns(spark, sf) -> DataFrame:
    """Conversations as groups of fragments: the first turn is the major member."""
    t = _t(spark, sf, "conversations")
    one = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"))
    return t.select(F.concat(one, F.col("turn").cast("string")).alias("id"), F.concat(one, F.lit("0")).alias("group"), "text")


_TURNS = "files AS (SELECT 'c' || conv_id || '/' || turn AS doc_id, 'c' || conv_id || '/0' AS grp, text FROM conversations)"
_COLLAPSED = (
    f"{_TURNS}, {_bm25_sql('a', QUERY_A)}, {_top_sql('ra', 'a', 'doc_id', 200)}, "
    "col AS (SELECT ra.doc_id AS id, ra.rank, ra.score, coalesce(f.grp, f.doc_id) AS public_id FROM ra JOIN files f ON f.doc_id = ra.doc_id "
    "WHERE EXISTS (SELECT 1 FROM files m WHERE m.doc_id = coalesce(f.grp, f.doc_id) AND (m.grp IS NULL OR m.grp = m.doc_id)))"
)


def _collapsed(spark, sf):
    turns = _turns(spark, sf)
    hits = recall.route(recall.bm25(turns, QUERY_A, "id"), "fts", "fts", "id", 200)
    return recall.collapse(hits, turns)


@query(f"WITH {_COLLAPSED} SELECT public_id, CAST(min(rank) AS INTEGER) AS rank, count(*) AS members FROM col GROUP BY public_id")
def group_collapse(spark, sf):
    return _collapsed(spark, sf).groupBy("public_id").agg(F.min("rank").alias("rank"), F.count("*").alias("members"))


_CHAINS = """
WITH RECURSIVE links AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 50 = 7 THEN doc_id + 1 WHEN doc_id % 50 = 8 THEN doc_id - 1 WHEN doc_id % 25 = 0 THEN NULL ELSE doc_id - 1 END AS "group" FROM documents
), up AS (
  SELECT id, id AS major FROM links WHERE "group" IS NULL OR "group" = id
  UNION ALL
  SELECT l.id, u.major FROM links l JOIN up u ON l."group" = u.id AND l."group" <> l.id
)
SELECT id, major FROM up
"""


@query(_CHAINS)
def group_chains(spark, sf):
    """Documents in chains of up to 25 members, some of which end in a cycle and have no major member."""
    i = F.col("doc_id")
    group = F.when(i % 50 == 7, i + 1).when(i % 50 == 8, i - 1).when(i % 25 != 0, i - 1)
    return recall.majors(_t(spark, sf, "documents").select(i.alias("id"), group.alias("group")))


@query(f"WITH {_COLLAPSED} SELECT public_id, string_agg(rank || ':fts:' || id, ',' ORDER BY rank, id) AS evidence FROM col GROUP BY public_id")
def evidence_list(spark, sf):
    listed = fusion.evidence(_collapsed(spark, sf))
    return listed.select("public_id", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["rank"].cast("string"), e["path"], e["id"])), ",").alias("evidence"))


@query(
    f"WITH {FILES.replace('files AS', 'f0 AS')}, files AS (SELECT * FROM f0), {_bm25_sql('a', 'thanedble')} SELECT doc_id, score FROM a WHERE FALSE"
)
def empty_filter(spark, sf):
    """A filter that nothing passes gives an empty result and not everything."""
    docs = documents(spark, sf)
    return recall.bm25(docs.where(X.matches_path(F.col("path"), "no/such/folder")), "thanedble", corpus=docs)


# Groups of a context request

GROUPS = {1: QUERY_A, 2: QUERY_B, 3: "heit der und"}


def _items(spark, sf):
    docs, limit, out = documents(spark, sf), fusion.group_limit(None, len(GROUPS)), None
    for n, q in GROUPS.items():
        one = recall.top(recall.bm25(docs, q), limit, "doc_id").select(F.lit(n).alias("group_no"), F.col("doc_id").alias("key"), "rank")
        out = one if out is None else out.unionByName(one)
    return out


_ITEMS = FILES + "".join(f", {_bm25_sql(f's{n}', q)}, {_top_sql(f'r{n}', f's{n}', 'doc_id', 10)}" for n, q in GROUPS.items()) + (
    ", items AS (" + " UNION ALL ".join(f"SELECT {n} AS group_no, doc_id AS key, rank FROM r{n}" for n in GROUPS) + "), "
    "merged AS (SELECT key, round(list_sum(list(1.0::DOUBLE / (60 + rank) ORDER BY group_no)), 9) AS score, min(rank) AS best_rank, min(group_no) AS first_group, "
    "string_agg('Q' || group_no, ',' ORDER BY group_no) AS groups FROM items GROUP BY key), "
    "placed AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, best_rank, first_group, CAST(key AS VARCHAR)) AS INTEGER) AS place FROM merged)"
)


@query(f"WITH {_ITEMS} SELECT key, score, CAST(best_rank AS INTEGER) AS best_rank, CAST(first_group AS INTEGER) AS first_group, groups, place FROM placed")
def context_groups(spark, sf):
    return fusion.merge_groups(_items(spark, sf)).select("key", "score", "best_rank", "first_group", "groups", "place")


@query(
    f"WITH {FILES}" + "".join(f", {_bm25_sql(f's{n}', q)}, {_top_sql(f'r{n}', f's{n}', 'doc_id', 200)}" for n, q in GROUPS.items())
    + ", best AS (SELECT id, min(rank) FILTER (r = 1) AS a, min(rank) FILTER (r = 2) AS b, min(rank) FILTER (r = 3) AS c FROM ("
    + " UNION ALL ".join(f"SELECT {n} AS r, doc_id AS id, rank FROM r{n}" for n in GROUPS)
    + ") GROUP BY id), fused AS (SELECT id, round(coalesce(1.0::DOUBLE / (60 + a), 0) + coalesce(1.0::DOUBLE / (60 + b), 0) + coalesce(1.0::DOUBLE / (60 + c), 0), 9) AS score FROM best) "
    "SELECT id, score, 'fts' AS matched_by, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM fused ORDER BY score DESC, id LIMIT 10"
)
def context_fused(spark, sf):
    """All groups' routes in one plan."""
    docs, hits, names = documents(spark, sf), None, []
    for n, q in GROUPS.items():
        names.append("fts" if n == 1 else f"fts-{n}")
        one = recall.route(recall.bm25(docs, q), names[-1], "fts", "doc_id", 200)
        hits = one if hits is None else hits.unionByName(one)
    return fusion.ranked(fusion.fuse(hits, names), 10)


_PICK = (
    ", p1 AS (SELECT key FROM items WHERE group_no = 1 ORDER BY rank LIMIT 1), p2 AS (SELECT key FROM items WHERE group_no = 2 AND key NOT IN (SELECT key FROM p1) ORDER BY rank LIMIT 1), "
    "p3 AS (SELECT key FROM items WHERE group_no = 3 AND key NOT IN (SELECT key FROM p1 UNION ALL SELECT key FROM p2) ORDER BY rank LIMIT 1), "
    "picks AS (SELECT key, 1 AS o FROM p1 UNION ALL SELECT key, 2 FROM p2 UNION ALL SELECT key, 3 FROM p3), "
    "fin AS (SELECT m.key, m.score, p.o, row_number() OVER (ORDER BY coalesce(p.o, 9), m.place) AS final FROM placed m LEFT JOIN picks p USING (key)) "
)


@query(
    f"WITH {_ITEMS}{_PICK} SELECT key, score, CAST(final AS INTEGER) AS final, CASE WHEN o IS NOT NULL THEN 'coverage' WHEN final <= 6 THEN 'global' ELSE 'tail' END AS reason FROM fin"
)
def context_coverage(spark, sf):
    items = _items(spark, sf)
    return fusion.coverage(fusion.merge_groups(items), items, sorted(GROUPS))


# Filters


@query(
    f"WITH {FILES} SELECT path FROM files WHERE regexp_full_match(path, 'src[12]/[^/]*/[^/]*\\.md') OR path LIKE 'src3/en/%' OR regexp_full_match(path, '(?:.*/)?1[^/]\\.(?:txt|py)')"
)
def glob_filter(spark, sf):
    p = F.col("path")
    return documents(spark, sf).where(X.matches_path(p, "src[12]/*/*.md") | X.matches_path(p, "src3/en") | X.matches_path(p, "1?.{txt,py}")).select("path")


@query(f"WITH {FILES} SELECT path FROM files WHERE regexp_full_match(path, 'src4/.*') AND (NOT regexp_full_match(path, '.*\\.txt') OR regexp_full_match(path, '(?:.*/)?[0-9]4\\.txt'))")
def ordered_globs(spark, sf):
    return documents(spark, sf).where(X.matches_ordered(F.col("path"), ["src4/**", "!*.txt", "[0-9]4.txt"]) & X.matches_path(F.col("path"), "src4")).select("path")


@query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00'")
def mtime_filter(spark, sf):
    return _t(spark, sf, "events").where(F.col("ts").between(F.lit("2024-01-05 00:00:00").cast("timestamp"), F.lit("2024-01-06 12:00:00").cast("timestamp"))).select("event_id")


@query(f"WITH {FILES} SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'markdown' END AS format FROM files WHERE path LIKE '%.py' OR path LIKE '%.md'")
def type_filter(spark, sf):
    docs = documents(spark, sf).withColumn("format", S.file_type(F.col("path"))[1])
    return docs.where(F.col("format").isin("python", "markdown")).select("path", "format")


@query(f"WITH {FILES} SELECT f.doc_id FROM files f JOIN labels l ON l.doc_id = f.doc_id AND l.quality = 1 WHERE f.path LIKE 'src1/%'")
def semi_join_filter(spark, sf):
    good = _t(spark, sf, "labels").where("quality = 1")
    return documents(spark, sf).where(X.matches_path(F.col("path"), "src1")).join(good, "doc_id", "left_semi").select("doc_id")


PLAN = search.SearchPlan(
    routes=[search.Route("fts", QUERY_A)], include_paths=["src1*/**", "src2"], exclude_paths=["src2/de"], globs=["!*7.*"], insensitive_globs=["*.MD", "*.Py"],
    file_types=["py", "md"], excluded_file_types=["rust"], modified_after=BASE_MS + 5_000, modified_before=BASE_MS + 700_000,
)
_PLAN = (
    "(regexp_full_match(path, 'src1[^/]*/.*') OR path LIKE 'src2/%') AND path NOT LIKE 'src2/de/%' AND NOT regexp_full_match(path, '(?:.*/)?[^/]*7\\.[^/]*') "
    f"AND (path LIKE '%.md' OR path LIKE '%.py') AND last_modified BETWEEN {BASE_MS + 5_000} AND {BASE_MS + 700_000}"
)


def _planned(docs: DataFrame, plan: search.SearchPlan) -> DataFrame:
    return docs.where(search.file_filter(plan, F.col("path"), F.col("last_modified"), S.file_type(F.col("path"))[1]))


@query(f"WITH {FILES} SELECT doc_id, path FROM files WHERE {_PLAN}")
def plan_filters(spark, sf):
    """All filters that a plan has for files."""
    return _planned(documents(spark, sf), search.resolve(PLAN)).select("doc_id", "path")


@query(f"WITH {FILES}, {_bm25_sql('s', QUERY_A, _PLAN)}, {_top_sql('r', 's', 'doc_id', search.LIMIT)} SELECT doc_id, score, rank FROM r")
def plan_search(spark, sf):
    """A plan's full-text route over the files that its filters leave."""
    plan, docs = search.resolve(PLAN), documents(spark, sf)
    return recall.top(recall.bm25(_planned(docs, plan), plan.routes[0].query, corpus=docs), plan.limit, "doc_id")


SYMBOL_QUERY = "find class Owner::sym3 thanedble attion erster"


@query(
    f"WITH {FILES}, {_bm25_sql('a', SYMBOL_QUERY)}, {_bm25_sql('b', SYMBOL_QUERY, 'doc_id % 5 = 3 AND doc_id % 2 = 1')}, {_top_sql('ra', 'a', 'doc_id', 200)}, {_top_sql('rb', 'b', 'doc_id', 200)}, "
    "best AS (SELECT id, min(rank) FILTER (r = 1) AS r0, min(rank) FILTER (r = 2) AS r1 FROM (SELECT 1 AS r, doc_id AS id, rank FROM ra UNION ALL SELECT 2, doc_id, rank FROM rb) GROUP BY id), "
    "fused AS (SELECT id, round(coalesce(1.0::DOUBLE / (60 + r0), 0) + coalesce(1.0::DOUBLE / (60 + r1), 0), 9) AS score FROM best) "
    "SELECT id, score, 'fts' AS matched_by, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM fused ORDER BY score DESC, id LIMIT 7"
)
def prefer_symbol(spark, sf):
    """A full-text route and one of the symbols that the query names, here ``Owner::sym3``."""
    docs, i = documents(spark, sf), F.col("doc_id")
    named = docs.withColumn("symbol_name", F.concat(F.lit("sym"), (i % 5).cast("string"))).withColumn("scope", F.when(i % 2 == 1, "pkg.Owner").otherwise("pkg.other"))
    mine = named.where(search.meant(F.col("symbol_name"), F.col("scope"), search.symbol_names(SYMBOL_QUERY)))
    hits = recall.route(recall.bm25(docs, SYMBOL_QUERY), "fts", "fts", "doc_id", 200)
    hits = hits.unionByName(recall.route(recall.bm25(mine, SYMBOL_QUERY, corpus=docs), "fts.prefer-symbol", "fts", "doc_id", 200))
    return fusion.ranked(fusion.fuse(hits, ["fts", "fts.prefer-symbol"]), 7)


# Line search

_LINES = (
    f"{FILES}, split AS (SELECT path, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS content, "
    "generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) AS line FROM files WHERE length(text) > 0)"
)


def _grep_sql(regex: str, tail: str = "") -> str:
    return (
        f"WITH {_LINES} SELECT path, CAST(line AS INTEGER) AS line, content FROM split WHERE regexp_matches(content, '{regex}'){tail}"
    )


def _grep(name: str, options: dict, patterns: list[str], sql_regex: str) -> None:
    def run(spark, sf):
        return lexical.grep(documents(spark, sf), X.line_regex(patterns, **options)).select("path", "line", "content")

    QUERIES[name], SQL[name] = run, _grep_sql(sql_regex)


_grep("grep_lines", {}, ["thanedble", "[Oo]uenti"], "thanedble|[Oo]uenti")
_grep("grep_fixed", {"fixed": True}, ["a.", "!!"], "a\\.|!!")
_grep("grep_icase", {"ignore_case": True}, ["THANEDBLE"], "(?i)thanedble")
_grep("grep_smart_case", {"smart_case": True}, ["apache license"], "(?i)apache license")
_grep("grep_line_regexp", {"whole_line": True}, ["[A-Z][a-z]+\\."], "^(?:[A-Z][a-z]+\\.)$")
_grep("grep_word", {"word": True}, ["license", "Apache"], "\\b(?:license|Apache)\\b")


@query(
    f"WITH {_LINES}, hit AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS n FROM split WHERE regexp_matches(content, 'the ')) "
    "SELECT path, CAST(line AS INTEGER) AS line FROM hit WHERE n <= 2"
)
def grep_max_count(spark, sf):
    return lexical.grep(documents(spark, sf), "the ", max_count=2).select("path", "line")


@query(
    f"WITH {_LINES}, hit AS (SELECT *, row_number() OVER (ORDER BY path, line) AS rank FROM split WHERE regexp_matches(content, 'license')) "
    "SELECT path, CAST(line AS INTEGER) AS line, CAST(rank AS INTEGER) AS rank, (SELECT count(*) FROM hit) > 5 AS truncated FROM hit WHERE rank <= 5"
)
def grep_limit_truncated(spark, sf):
    return lexical.limited(lexical.grep(documents(spark, sf), "license"), 5).select("path", "line", "rank", "truncated")


@query(
    f"WITH {_LINES}, hit AS (SELECT path, line FROM split WHERE regexp_matches(content, 'license')) "
    "SELECT h.path, CAST(h.line AS INTEGER) AS line, CAST(min(s.line) AS INTEGER) AS first_line, CAST(max(s.line) AS INTEGER) AS last_line, "
    "string_agg(s.content, chr(10) ORDER BY s.line) AS context FROM hit h JOIN split s ON s.path = h.path AND s.line BETWEEN h.line - 1 AND h.line + 2 GROUP BY h.path, h.line"
)
def grep_context(spark, sf):
    return lexical.grep_context(documents(spark, sf), "license", 1, 2).select("path", "line", "first_line", "last_line", "context")


@query(_grep_sql("^$"))
def grep_empty_lines(spark, sf):
    """Lines without a sign; of several line ends at a text's end only the last one closes a line."""
    docs = documents(spark, sf).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 2 == 0, "\n\n").otherwise("")))
    return lexical.grep(docs, "^$").select("path", "line", "content")


SQL["grep_empty_lines"] = _grep_sql("^$").replace("FROM files WHERE length(text) > 0", "FROM (SELECT path, text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) ELSE '' END AS text FROM files) WHERE length(text) > 0")


@query(
    f"WITH {_LINES} SELECT path, CAST(line AS INTEGER) AS line, CAST(length(b) + len(regexp_extract_all(b, '[\\x{{10000}}-\\x{{10FFFF}}]')) AS BIGINT) AS start_column, "
    "CAST(length(b) + len(regexp_extract_all(b, '[\\x{10000}-\\x{10FFFF}]')) + 7 AS BIGINT) AS end_column "
    "FROM (SELECT *, regexp_extract(content, '^(.*?)license', 1) AS b FROM split WHERE regexp_matches(content, 'license'))"
)
def utf16_columns(spark, sf):
    return lexical.grep(documents(spark, sf), "license").select("path", "line", "start_column", "end_column")


@query(
    f"WITH {_LINES}, hit AS (SELECT path, line FROM split WHERE regexp_matches(content, 'license')), "
    "span AS (SELECT path, w AS id, w * 4 + 1 AS a, w * 4 + 8 AS b FROM files, (SELECT unnest(range(6)) AS w) UNION ALL SELECT path, 100, 1, 1000000 FROM files), "
    "best AS (SELECT h.path, h.line, s.id, s.b - s.a AS span, row_number() OVER (PARTITION BY h.path, h.line ORDER BY s.b - s.a, -s.id) AS n FROM hit h JOIN span s ON s.path = h.path AND s.a <= h.line AND s.b >= h.line) "
    "SELECT path, CAST(line AS INTEGER) AS line, CAST(id AS BIGINT) AS container, CAST(span AS BIGINT) AS span FROM best WHERE n = 1"
)
def container_range_join(spark, sf):
    docs = documents(spark, sf)
    w = F.col("w")
    windows = docs.select("path", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("w")).select("path", w.cast("long").alias("id"), (w * 4 + 1).cast("long").alias("start_line"), (w * 4 + 8).cast("long").alias("end_line"))
    whole = docs.select("path", F.lit(100).cast("long").alias("id"), F.lit(1).cast("long").alias("start_line"), F.lit(1000000).cast("long").alias("end_line"))
    ranges = windows.unionByName(whole).withColumn("specificity", F.col("id"))
    return lexical.containers(lexical.grep(docs, "license").select("path", "line"), ranges)


# Identity and the index


@query(f"WITH {FILES} SELECT doc_id, sha256('ws' || chr(0) || path) AS file_id, sha256(sha256('ws' || chr(0) || path) || chr(0) || '0') AS entity_id FROM files")
def entity_ids(spark, sf):
    docs = documents(spark, sf).withColumn("file_id", X.hash_id("ws", F.col("path")))
    return docs.select("doc_id", "file_id", index.entity_id(F.col("file_id"), F.lit(0)).alias("entity_id"))


@query("SELECT doc_id, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents")
def content_hash(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"))


def _states(spark, sf):
    """Two states of the files: in the stored one some lack, some differ, and some were never indexed."""
    docs = documents(spark, sf).select(X.hash_id("ws", F.col("path")).alias("file_id"), "doc_id", "path", F.col("n_chars").alias("size_bytes"), "last_modified", F.sha2("text", 256).alias("content_hash"))
    i = F.col("doc_id")
    stored = docs.where(i % 11 != 0).withColumn("size_bytes", F.col("size_bytes") + F.when(i % 13 == 0, 1).otherwise(0)).withColumn("last_modified", F.col("last_modified") - F.when(i % 5 == 0, 1).otherwise(0))
    stored = stored.withColumn("indexed_time", F.when(i % 17 != 0, F.lit(1).cast("long")))
    return docs.where(i % 19 != 0), stored


_STATES = (
    f"{FILES}, base AS (SELECT sha256('ws' || chr(0) || path) AS file_id, doc_id, path, n_chars AS size_bytes, last_modified, sha256(text) AS content_hash FROM files), "
    "scanned AS (SELECT * FROM base WHERE doc_id % 19 <> 0), stored AS (SELECT file_id, path, size_bytes + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS size_bytes, "
    "last_modified - CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS last_modified, content_hash, CASE WHEN doc_id % 17 <> 0 THEN 1 END AS indexed_time FROM base WHERE doc_id % 11 <> 0), "
    "d AS (SELECT coalesce(s.file_id, t.file_id) AS file_id, coalesce(s.path, t.path) AS path, CASE WHEN s.path IS NULL THEN {} WHEN t.path IS NULL THEN 'added' WHEN indexed_time IS NULL THEN 'pending' "
    "WHEN s.size_bytes = t.size_bytes AND (s.last_modified = t.last_modified OR s.content_hash = t.content_hash) THEN 'unchanged' ELSE 'modified' END AS state "
    "FROM scanned s FULL JOIN stored t ON s.file_id = t.file_id)"
)


@query("WITH " + _STATES.replace("{}", "'deleted'") + " SELECT file_id, path, state FROM d")
def diff_files(spark, sf):
    return index.diff(*_states(spark, sf))


@query("WITH " + _STATES.replace("{}", "CASE WHEN t.path LIKE 'src2/%' THEN 'kept' ELSE 'deleted' END") + " SELECT state, count(*) AS n FROM d GROUP BY state")
def deleted_protected(spark, sf):
    return index.diff(*_states(spark, sf), protected=["src2"]).groupBy("state").agg(F.count("*").alias("n"))


@query(
    f"WITH {FILES} SELECT count(*) AS total, sum(CAST(doc_id % 17 <> 0 AND doc_id % 23 <> 0 AS BIGINT))::BIGINT AS indexed, sum(CAST(doc_id % 17 = 0 AS BIGINT))::BIGINT AS pending, "
    "sum(CAST(doc_id % 23 = 0 AS BIGINT))::BIGINT AS failed, sum(n_chars // 100)::BIGINT AS entities FROM files"
)
def index_status(spark, sf):
    i = F.col("doc_id")
    docs = documents(spark, sf).select(F.when(i % 17 != 0, i).alias("indexed_time"), F.when(i % 23 == 0, "failed").alias("error"), F.floor(F.col("n_chars") / 100).cast("long").alias("entity_count"))
    return index.status(docs)


@query("SELECT 'c' || conv_id AS file_id, CAST(sum(CAST(turn = 0 AS BIGINT)) AS BIGINT) AS entities, sum(CAST(turn = 0 AS BIGINT)) = 1 AS valid FROM conversations GROUP BY conv_id")
def public_entities(spark, sf):
    turns = _turns(spark, sf).withColumn("file_id", F.regexp_extract("id", "^([^/]*)", 1))
    return index.public_entities(turns)


@query(
    f"WITH {FILES} SELECT path, 'old' AS version FROM files WHERE doc_id % 9 <> 0 UNION ALL SELECT path, 'new' FROM files WHERE doc_id % 9 = 0 AND doc_id % 2 = 0"
)
def snapshot_replace(spark, sf):
    docs = documents(spark, sf).select(X.hash_id("ws", F.col("path")).alias("file_id"), "path", "doc_id")
    changed = docs.where("doc_id % 9 = 0")
    new = changed.where("doc_id % 2 = 0").withColumn("version", F.lit("new"))
    return index.replaced(docs.withColumn("version", F.lit("old")), new, changed).select("path", "version")


@query(f"WITH {FILES} SELECT path, n_chars FROM files ORDER BY path LIMIT 30 OFFSET 20")
def listing_page(spark, sf):
    """A page of the listing of files by path."""
    return documents(spark, sf).orderBy("path").offset(20).limit(30).select("path", "n_chars")


@query(
    f"WITH {FILES} SELECT sha256('ws' || chr(0) || path) AS file_id, CASE WHEN doc_id % 8 <> 0 OR doc_id % 16 = 0 THEN sha256(text) END AS content_hash, "
    "CASE WHEN doc_id % 8 = 0 THEN 'unreadable' END AS error, CASE WHEN doc_id % 8 = 0 THEN 0 ELSE n_chars // 100 END AS entity_count FROM files"
)
def failed_files(spark, sf):
    """Files that failed lose their entities, and their hash too unless size and time are those of the failure."""
    i = F.col("doc_id")
    docs = documents(spark, sf).select(X.hash_id("ws", F.col("path")).alias("file_id"), "doc_id", F.col("n_chars").alias("size_bytes"), "last_modified", F.sha2("text", 256).alias("content_hash"))
    known = docs.withColumn("error", F.lit(None).cast("string")).withColumn("entity_count", F.floor(F.col("size_bytes") / 100).cast("long"))
    failed = docs.where(i % 8 == 0).withColumn("failure", F.lit("unreadable")).withColumn("size_bytes", F.col("size_bytes") + F.when(i % 16 == 0, 0).otherwise(1))
    return index.mark_failed(known, failed).select("file_id", "content_hash", "error", "entity_count")


# Files


def _pages(spark, sf):
    """Pages as files: url paths by their number's kind of name."""
    i = F.col("page_id")
    name = F.when(i % 6 == 0, "png").when(i % 6 == 1, "zip").when(i % 6 == 2, "ts").when(i % 6 == 3, "csv").when(i % 6 == 4, "md").otherwise("weird")
    size = F.when(i % 10 == 0, F.lit(0)).otherwise(F.octet_length("html") * F.when(i % 4 == 0, 1000).otherwise(1)).cast("long")
    rows = _t(spark, sf, "pages").select(F.concat(F.lit("site/"), i.cast("string"), F.lit("."), name).alias("path"), size.alias("size_bytes"), (i % 15 == 2).alias("binary"))
    kind, format_ = S.file_type(F.col("path"))
    rows = rows.withColumn("kind", kind).withColumn("format", format_)
    return rows.withColumn("reason", S.skip_reason(F.col("kind"), F.col("size_bytes"), F.col("binary")))


_PAGES = (
    "page_files AS (SELECT 'site/' || page_id || '.' || ['png', 'zip', 'ts', 'csv', 'md', 'weird'][page_id % 6 + 1] AS path, "
    "CAST(CASE WHEN page_id % 10 = 0 THEN 0 ELSE strlen(html) * CASE WHEN page_id % 4 = 0 THEN 1000 ELSE 1 END END AS BIGINT) AS size_bytes, page_id % 15 = 2 AS is_binary, "
    "['image', NULL, 'code', 'data', 'text', 'text'][page_id % 6 + 1] AS kind, ['png', NULL, 'typescript', 'csv', 'markdown', 'weird'][page_id % 6 + 1] AS format FROM pages), "
    "judged AS (SELECT *, CASE WHEN size_bytes = 0 THEN 'empty' WHEN kind IS NULL THEN 'unsupported' WHEN size_bytes > CASE kind WHEN 'code' THEN 1048576 WHEN 'text' THEN 268435456 "
    "WHEN 'data' THEN 16777216 ELSE 10485760 END THEN 'too_large' WHEN is_binary AND kind <> 'image' THEN 'binary' END AS reason FROM page_files)"
)


#: Names by which pages are files: all that has a type of its own, and what doesn't, with what they are in SQL.
_TYPED = [("x." + k, kind, v) for kind, names in (("code", S.CODE), ("data", S.DATA), ("text", S.TEXT), ("image", S.IMAGE)) for k, v in names.items()]
_TYPED += [(k, "code", v) for k, v in S.NAMED.items()] + [("x." + k, None, None) for k in S.BINARY]
_TYPED += [("UP.Ts", "code", "typescript"), ("a.tar.GZ", None, None), ("noext", "text", "text"), (".gitignore", "text", "text"), ("end.", "text", "text"), ("makefile", "text", "text"), (".env.toml", "data", "toml"), ("notes.log", "text", "log"), ("a.tsv", "text", "tsv"), ("a b.é", "text", "é")]
_NAMES = ", ".join(f"({i}, '{n}', {f"'{k}'" if k else 'NULL'}, {f"'{v}'" if v else 'NULL'})" for i, (n, k, v) in enumerate(_TYPED))


@query(f"SELECT 'site/v1.0/' || page_id || '/' || name AS path, kind, format FROM pages JOIN (VALUES {_NAMES}) AS names(i, name, kind, format) ON i = page_id % {len(_TYPED)}")
def file_type_detect(spark, sf):
    """The types of pages by names that go through every extension."""
    name = F.element_at(F.array(*[F.lit(n) for n, _, _ in _TYPED]), (F.col("page_id") % len(_TYPED) + 1).cast("int"))
    paths = _t(spark, sf, "pages").select(F.concat(F.lit("site/v1.0/"), F.col("page_id").cast("string"), F.lit("/"), name).alias("path"))
    kind, format_ = S.file_type(F.col("path"))
    return paths.select("path", kind.alias("kind"), format_.alias("format"))


@query(f"WITH {_PAGES} SELECT path, size_bytes, reason FROM judged")
def size_policy(spark, sf):
    return _pages(spark, sf).select("path", "size_bytes", "reason")


@query(f"WITH {_PAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY path) AS k FROM judged WHERE reason IS NOT NULL) SELECT reason, count(*) AS skipped, string_agg(path, ',' ORDER BY path) FILTER (k <= 20) AS samples FROM n GROUP BY reason")
def skip_diagnostics(spark, sf):
    return S.skip_report(_pages(spark, sf)).withColumn("samples", F.array_join("samples", ","))


IGNORE = [("", "*.md\n!keep.md\n/src1/\n"), ("src2", "de/\n!/de/\n"), ("src3", "en/1*.txt\n")]


@query(f"WITH {FILES} SELECT path FROM files WHERE NOT (path LIKE '%.md' OR path LIKE 'src1/%' OR regexp_full_match(path, 'src3/en/1[^/]*\\.txt'))")
def ignore_rules(spark, sf):
    docs = documents(spark, sf).select("path")
    return docs.join(S.ignored(docs, S.rule_table(spark.createDataFrame(IGNORE, "folder string, content string"))), "path", "left_anti")


def _tree(spark, sf) -> DataFrame:
    """Documents as files of a tree with hidden, generated and deep folders."""
    i = F.col("doc_id")
    top = F.when(i % 11 == 0, ".hidden/").when(i % 7 == 0, "build/").when(i % 5 == 0, "src/a/b/").when(i % 3 == 0, "src/").otherwise("")
    name = F.when(i % 13 == 0, ".env").when(i % 4 == 0, F.concat(i.cast("string"), F.lit(".min.js"))).otherwise(F.concat(F.lit("f"), i.cast("string"), F.lit(".txt")))
    return _t(spark, sf, "documents").select("doc_id", F.concat(top, name).alias("path"), "text")


_TREE = (
    "tree AS (SELECT doc_id, text, CASE WHEN doc_id % 11 = 0 THEN '.hidden/' WHEN doc_id % 7 = 0 THEN 'build/' WHEN doc_id % 5 = 0 THEN 'src/a/b/' WHEN doc_id % 3 = 0 THEN 'src/' ELSE '' END "
    "|| CASE WHEN doc_id % 13 = 0 THEN '.env' WHEN doc_id % 4 = 0 THEN doc_id || '.min.js' ELSE 'f' || doc_id || '.txt' END AS path FROM documents)"
)


@query(f"WITH {_TREE} SELECT doc_id, path FROM tree WHERE len(string_split(path, '/')) <= 2")
def depth_rule(spark, sf):
    return _tree(spark, sf).where(S.depth_allowed(F.col("path"), 2)).select("doc_id", "path")


@query(f"WITH {_TREE} SELECT doc_id, path FROM tree WHERE doc_id % 11 = 0 OR doc_id % 13 = 0")
def hidden_policy(spark, sf):
    return _tree(spark, sf).where(S.hidden(F.col("path"))).select("doc_id", "path")


@query(f"WITH {_TREE} SELECT doc_id, path FROM tree WHERE path LIKE 'build/%' OR path LIKE '%.min.js'")
def default_ignores(spark, sf):
    """Files of folders and names that are left out by default."""
    return _tree(spark, sf).where(S.default_ignored(F.col("path"))).select("doc_id", "path")


@query(f"WITH {_TREE} SELECT doc_id, path FROM tree WHERE path NOT LIKE '%.txt' OR path LIKE 'src/%'")
def include_override(spark, sf):
    """What an include pattern names is kept although an ignore rule leaves it out."""
    tree = _tree(spark, sf)
    rules = S.rule_table(spark.createDataFrame([("", "*.txt\n")], "folder string, content string"))
    gone = S.ignored(tree.where(~X.matches_path(F.col("path"), "src")), rules)
    return tree.join(gone, "path", "left_anti").select("doc_id", "path")


@query("SELECT page_id, page_id % 9 = 0 OR page_id % 10 = 0 AS looks_binary FROM pages")
def binary_sniff(spark, sf):
    """Page bytes, every ninth with a zero early on, every tenth with many control bytes, every eighth with a zero too far
    behind to be seen."""
    i, body = F.col("page_id"), F.rpad(F.substring("html", 1, 9000), 9000, "x").cast("binary")
    zero, bells = F.lit(bytearray(b"\0")), F.lit(bytearray(b"\1" * 4000))
    content = F.when(i % 9 == 0, F.concat(F.lit("ab").cast("binary"), zero, body)).when(i % 10 == 0, F.concat(bells, body)).when(i % 8 == 0, F.concat(body, zero)).otherwise(body)
    return _t(spark, sf, "pages").select("page_id", S.looks_binary(content).alias("looks_binary"))


# Chunks


@query()
def text_chunks(spark, sf):
    cut = lambda t: [[i, a, b, c] for i, (a, b, c) in enumerate(chunking.text_chunks(t))]
    return chunking.chunk_texts(_t(spark, sf, "documents"), cut, "chunk int, start_line int, end_line int, content string")


@query()
def markdown_sections(spark, sf):
    """Documents with a heading before every fourth line."""
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda line, i: F.when(i % 4 == 0, F.concat(F.repeat(F.lit("#"), (F.floor(i / 4) % 3 + 1).cast("int")), F.lit(" H"), i.cast("string"), F.lit("\n"), line)).otherwise(line)), "\n")
    docs = _t(spark, sf, "documents").select("doc_id", marked.alias("text"))
    cut = lambda t: [[s["index"], s["group"], s["heading"], s["level"], s["scope"], s["content"]] for s in chunking.markdown_chunks(t)]
    return chunking.chunk_texts(docs, cut, "index int, group int, heading string, level int, scope string, content string")


@query(
    f"WITH {FILES} SELECT doc_id, substr(CASE WHEN length(path) > 25 THEN substr(path, 1, 22) || '...' ELSE path END || chr(10) || text, 1, 100) AS vector_text FROM files"
)
def vector_text(spark, sf):
    return documents(spark, sf).select("doc_id", chunking.vector_text(F.col("path"), F.col("text"), 100).alias("vector_text"))


@query(
    "SELECT doc_id, length(h) > 0 AND length(regexp_replace(h, '[\\p{L}\\s]', '', 'g')) >= 0.3 * length(h) AS dense, "
    "CAST(floor(256 * CASE WHEN length(h) > 0 AND length(regexp_replace(h, '[\\p{L}\\s]', '', 'g')) >= 0.3 * length(h) THEN 1.0 ELSE 1.85 END) AS BIGINT) AS budget FROM (SELECT doc_id, substr(text, 1, 16384) AS h FROM documents)"
)
def token_dense(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", chunking.token_dense(F.col("text")).alias("dense"), chunking.chunk_budget(F.col("text"), 256).alias("budget"))


@query()
def code_entities(spark, sf):
    """Documents as the bodies of Python functions, cut by definitions."""
    i = F.col("doc_id").cast("string")
    body = F.concat(F.lit("class C"), i, F.lit(":\n    def m"), i, F.lit('(self):\n        """'), F.regexp_replace("text", r'["\\]', " "), F.lit('"""\n        return 1\n'))
    docs = _t(spark, sf, "documents").select(i.alias("file_id"), F.lit("code").alias("kind"), F.lit("python").alias("format"), body.alias("text"))
    return chunking.entities(docs).select("file_id", "index", "group", "symbol_type", "symbol_name", "scope", "start_line", "end_line")


_MARKED = "doc_id % 3 = 0 AND doc_id % 7 <> 0"


@query(
    f"SELECT doc_id, TRUE AS equal, CAST(CASE WHEN {_MARKED} THEN strlen(text) - strlen(ltrim(text, chr(10))) ELSE 0 END AS BIGINT) AS first_byte, "
    f"CAST(CASE WHEN {_MARKED} THEN strlen(rtrim(text, chr(10))) ELSE strlen(text) END AS BIGINT) AS last_byte FROM documents WHERE regexp_matches(text, '\\S')"
)
def entity_offsets(spark, sf):
    """Documents as files of text, Markdown and code: whether every entity is what its bytes say, and that they reach from the
    first byte to the last."""
    docs = documents(spark, sf).withColumn("file_id", F.col("doc_id").cast("string"))
    kind, format_ = S.file_type(F.col("path"))
    made = chunking.entities(docs.withColumn("kind", kind).withColumn("format", format_)).where("start_byte IS NOT NULL")
    # An outline is made, and stands for what its members say.
    mine = made.where(F.col("group").isNull() | (F.col("group") != F.col("index"))).select("file_id", "content", "start_byte", "end_byte")
    bytes_ = F.encode("text", "UTF-8").substr(F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte"))
    same = mine.join(docs.select("file_id", "doc_id", "text"), "file_id").withColumn("same", bytes_ == F.encode("content", "UTF-8"))
    return same.groupBy("doc_id").agg(F.min(F.col("same").cast("int")).cast("boolean").alias("equal"), F.min("start_byte").cast("long").alias("first_byte"), F.max("end_byte").cast("long").alias("last_byte"))


_STUB = ", ".join(f"round(CAST('0x' || substr(h, {2 * i + 1}, 2) AS INTEGER) / 255.0 - 0.5, 6) AS e{i}" for i in (0, 1, 31, 32, 63))


@query(
    f"SELECT item_id, 64 AS dimensions, {_STUB} FROM (SELECT item_id, sha256(encode(text) || '\\x00\\x00\\x00\\x00\\x00\\x00\\x00\\x00'::BLOB) "
    "|| sha256(encode(text) || '\\x01\\x00\\x00\\x00\\x00\\x00\\x00\\x00'::BLOB) AS h FROM benchmark)"
)
def stub_embeddings(spark, sf):
    """Vectors by the model without weights: their length and some of their numbers."""
    made = embed.embed(_t(spark, sf, "benchmark").select("item_id", "text"), "text", embed.stub_vector, 64)
    return made.select("item_id", F.size("embedding").alias("dimensions"), *[F.round(F.col("embedding")[i].cast("double"), 6).alias(f"e{i}") for i in (0, 1, 31, 32, 63)])


@query("SELECT label, " + ", ".join(f"round(avg(CAST(embedding[{i + 1}] AS DOUBLE)), 6) AS m{i}" for i in range(3)) + " FROM embeddings GROUP BY label")
def mean_pooling(spark, sf):
    from ..functions.vectors import mean_vector

    pooled = mean_vector(_t(spark, sf, "embeddings"), ["label"], "embedding", 64)
    return pooled.select("label", *[F.round(F.col("embedding")[i], 6).alias(f"m{i}") for i in range(3)])


# Changes

_KINDS = {"signup": "created", "purchase": "deleted", "click": "changed", "view": "changed", "error": "changed"}


def _events(spark, sf) -> DataFrame:
    return _changed(_t(spark, sf, "events"))


def _changed(events: DataFrame) -> DataFrame:
    kind: Column = F.lit("changed")
    for k, v in _KINDS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    path = F.concat(F.lit("d"), (F.col("event_id") % 7).cast("string"), F.lit("/f"), (F.col("event_id") % 29).cast("string"))
    return events.select("event_id", "ts", F.col("user_id").alias("root"), path.alias("path"), kind.alias("kind"))


_EVENTS = "ev AS (SELECT event_id, ts, user_id AS root, 'd' || event_id % 7 || '/f' || event_id % 29 AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'deleted' ELSE 'changed' END AS kind FROM events)"
_FOLD = (
    "CASE WHEN acc IS NULL THEN x WHEN acc = x THEN acc WHEN acc = 'created' AND x = 'deleted' THEN 'deleted' "
    "WHEN acc = 'created' AND x = 'changed' THEN 'created' ELSE 'changed' END"
)


@query(f"WITH {_EVENTS}, k AS (SELECT root, path, list(kind ORDER BY ts, event_id) AS kinds FROM ev GROUP BY root, path) SELECT root, path, list_reduce(kinds, lambda acc, x: {_FOLD}) AS kind, CAST(len(kinds) AS BIGINT) AS events FROM k")
def changeset_coalesce(spark, sf):
    return changes.coalesce_changes(_events(spark, sf), ["root", "path"])


@query(
    f"WITH {_EVENTS}, g AS (SELECT root, ts, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY root ORDER BY ts) >= INTERVAL 6 HOUR, TRUE) AS INTEGER) AS new FROM ev), "
    'b AS (SELECT root, ts, sum(new) OVER (PARTITION BY root ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM g) SELECT root, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS events FROM b GROUP BY root, n'
)
def debounce_sessions(spark, sf):
    return changes.debounce(_events(spark, sf), ["root"], "6 hours")


_BURSTS = """
WITH RECURSIVE EVENTS, g AS (
  SELECT root, ts, event_id, path, kind, sum(new) OVER (PARTITION BY root ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n
  FROM (SELECT *, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY root ORDER BY ts) >= INTERVAL 6 HOUR, TRUE) AS INTEGER) AS new FROM ev)
), starts AS (  -- within a quiet time's bounds, the first change that has waited a day ends a burst
  SELECT root, n, min(ts) AS start FROM g GROUP BY root, n
  UNION ALL
  SELECT s.root, s.n, min(g.ts) FROM starts s JOIN g ON g.root = s.root AND g.n = s.n AND g.ts >= s.start + INTERVAL 24 HOUR GROUP BY s.root, s.n, s.start
), held AS (
  SELECT g.*, s.start FROM g ASOF JOIN starts s ON g.root = s.root AND g.n = s.n AND g.ts >= s.start
), ended AS (
  SELECT root, start, least(max(ts) + INTERVAL 6 HOUR, start + INTERVAL 24 HOUR) AS "end", count(DISTINCT path) AS paths, count(*) AS events FROM held GROUP BY root, start
), k AS (
  SELECT root, start, path, list(kind ORDER BY ts, event_id) AS kinds FROM held GROUP BY root, start, path
)
SELECT CAST(e.root AS VARCHAR) AS root, start, e."end", path, list_reduce(kinds, lambda acc, x: FOLD) AS kind, CAST(len(kinds) AS BIGINT) AS events
FROM ended e JOIN k USING (root, start) WHERE paths <= 10 AND e."end" <= (SELECT max(ts) - INTERVAL 1 DAY FROM ev)
UNION ALL
SELECT CAST(root AS VARCHAR), start, "end", '', 'reconcile', events FROM ended WHERE paths > 10 AND "end" <= (SELECT max(ts) - INTERVAL 1 DAY FROM ev)
"""


@query(_BURSTS.replace("EVENTS", _EVENTS).replace("FOLD", _FOLD))
def flushed_bursts(spark, sf):
    """A stream over all events with state by root: quiet for 6 hours or waiting for a day, and more than 10 paths are a
    comparison of the whole root; what the watermark has passed at the end."""
    schema = _t(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/[e]vents.parquet")  # a pattern, as a stream reads no single file
    where = scratch(spark, "bursts")
    waits = bursts.Waits(6 * 3_600_000, 24 * 3_600_000, 10)
    with bursts.stateful(spark):
        out = bursts.bursts(_changed(stream).withColumn("ts", F.col("ts").cast("timestamp")), "1 day", waits).writeStream.format("parquet")
        out.option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(bursts.OUT).parquet(f"{where}/rows")


@query(f"WITH {FILES}, p AS (SELECT DISTINCT unnest([path, CASE WHEN doc_id % 3 = 0 THEN source || '/' || lang ELSE path END, CASE WHEN doc_id % 50 = 0 THEN source ELSE path END]) AS path FROM files) SELECT path FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE starts_with(a.path, b.path || '/'))")
def prefix_cover(spark, sf):
    i, p = F.col("doc_id"), F.col("path")
    all_ = F.array(p, F.when(i % 3 == 0, F.concat_ws("/", "source", "lang")).otherwise(p), F.when(i % 50 == 0, F.col("source")).otherwise(p))
    return changes.minimal_cover(documents(spark, sf).select(F.explode(all_).alias("path")))


@query(f"WITH {_EVENTS}, n AS (SELECT root, count(DISTINCT path) AS n FROM ev GROUP BY root) SELECT DISTINCT ev.root, CASE WHEN n.n > 12 THEN regexp_replace(path, '(^|/)[^/]*$', '') ELSE path END AS path, n.n > 12 AS rescan FROM ev JOIN n ON n.root = ev.root")
def widen_changes(spark, sf):
    return changes.widen(_events(spark, sf), budget=12)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
