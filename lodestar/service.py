"""A workspace: a folder of files, the index of their entities, and the searches over both."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions.parse import LineSearch, line_search
from .functions.text import hash_id, line_regex, matches_ordered, matches_path, valid_utf8
from .operators import chunking, embed, fusion, index, lexical, recall, segments
from .plans.search import PlanError, Route, SearchPlan, file_filter, meant, resolve, symbol_names
from .sources import files, watch
from .streaming import bursts, changes

#: Folders that can't be read, at most, for an update to go on.
PROTECTED = 1000
#: What is known of a file; texts and terms are its entities and their tokens, which the statistics of a search add up.
FILES = ["file_id", "path", "kind", "format", "size_bytes", "last_modified", "content_hash", "indexed_time", "error", "entity_count", "texts", "terms"]
#: The tables of an index and their order.  Noting a file anew leaves its entities and postings as they are.
TABLES = {"files": segments.Order(("path",)), "entities": segments.Order(), "postings": segments.POSTED}
DERIVED = {"postings": ("entities", recall.postings)}


class Workspace:
    """Index and search of the files below root.

    The index is a log of three tables, files, entities and postings, below folder, which all executors have to reach.  An
    update lists the tree, cuts and embeds only files that are new or differ, and writes their rows alone as one segment
    more; readers keep the snapshot they began with.  The model is a function from text to a vector; an index is refused to another model.
    """

    def __init__(
        self, spark: SparkSession, root: str, folder: str, name: str = "workspace", model: Callable[[str], np.ndarray] = embed.stub_vector,
        dimensions: int = 64, metric: str = "cosine", model_name: str = "stub", size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, tokens: int | None = None, **scan_options,
    ):
        self.spark, self.root, self.name = spark, root, name
        self.model, self.dimensions, self.metric = model, dimensions, metric
        self.size, self.overlap, self.scan_options = size, overlap, scan_options
        #: Tokens that the model takes, which bound every file's chunks by how dense its text is.
        self.tokens = tokens
        self.fingerprint = {"model": model_name, "dimension": dimensions, "metric": metric, "tokenizer": "words"}
        self.snapshots = index.Snapshots(spark, folder, TABLES, whole=("files",), derived=DERIVED)

    # Index

    def _options(self, **options) -> dict:
        """Options of a scan; the index's own folder is never a part of the tree."""
        root, folder = self.root.rstrip("/"), self.snapshots.folder
        inside = [folder[len(root) + 1 :]] if folder.startswith(root + "/") else []
        return {**self.scan_options, **options, "hard": inside}

    def _scanned(self, **options) -> DataFrame:
        found = files.scan(self.spark, self.root, self.name, **self._options(**options)).where("reason is null and content is not null")
        return found.withColumn("path", F.col("relative_path"))

    def index(self, rebuild: bool = False, paths: Sequence[str] | None = None) -> dict[str, int]:
        """Bring the index up to date; the number of files by what became of them.

        Size and time tell which files may differ; only these are read, cut and embedded, each once: every step's table is
        written before the next reads it.  A file that can't be cut, or that the model fails on, is kept as failed and
        doesn't stop the others; what lies below a folder that can't be read stays as it is.  With paths, relative to
        root, only these files and what is below these folders is listed and compared; the rest stays.
        """
        spark, fresh = self.spark, rebuild or self.snapshots.manifest is None
        some = None if fresh or paths is None else [p.strip("/") for p in paths]
        inside = F.lit(True)
        if some is not None:
            inside = F.col("path").isin(some)
            for p in some:
                inside = inside | F.col("path").startswith(p + "/")
        none = "file_id string, path string, kind string, format string, size_bytes long, last_modified long, content_hash string, indexed_time long, error string, entity_count long, texts long, terms long"
        with self.snapshots.writing(self.fingerprint, rebuild) as put:
            if fresh:
                put.log = put.log.emptied()
            listed = files.listed_files(spark, self.root, self.name, paths=some, **self._options())
            listed = put("listed", listed.withColumn("full_path", F.col("path")).withColumn("path", F.col("relative_path")).drop("relative_path"), scratch=True)
            protected = [r["path"] for r in listed.where("unreadable").select("path").distinct().limit(PROTECTED + 1).collect()]
            if len(protected) > PROTECTED:
                raise ValueError(f"more than {PROTECTED} folders can't be read")
            stored = (spark.createDataFrame([], none) if fresh else put.log.read("files")).where(inside)
            rows = listed.where("reason is null").where(inside)
            before = stored.select("file_id", F.col("size_bytes").alias("_s"), F.col("last_modified").alias("_t"), F.col("content_hash").alias("_h"), F.col("indexed_time").alias("_i"))
            same = (F.col("size_bytes") == F.col("_s")) & (F.col("last_modified") == F.col("_t")) & F.col("_h").isNotNull() & F.col("_i").isNotNull()
            rows = rows.join(before, "file_id", "left").withColumn("same", F.coalesce(same, F.lit(False)))
            read = files.with_contents(rows.where("not same").select("file_id", F.col("full_path").alias("path"), F.col("path").alias("at"), "kind", "format", "size_bytes", "last_modified", "reason"), self.root)
            read = read.where("reason is null and content is not null").withColumn("content_hash", F.sha2("content", 256))
            kept = rows.where("same").select("file_id", "path", "kind", "format", "size_bytes", "last_modified", F.col("_h").alias("content_hash"))
            read = put("read", read.select("file_id", F.col("at").alias("path"), "kind", "format", "size_bytes", "last_modified", "content_hash", valid_utf8(F.col("content")).alias("text")), scratch=True)
            states = put("states", index.diff(read.drop("text").unionByName(kept), stored, protected))
            texts = read.join(states.where("state in ('added', 'modified', 'pending')").select("file_id"), "file_id", "left_semi")
            made = put("made", self._entities(texts), scratch=True)
            failed = made.where("failure is not null").groupBy("file_id").agg(F.min("failure").alias("failure"))
            good = made.join(failed, "file_id", "left_anti").drop("failure").withColumn("dl", recall.text_length(F.col("text")))
            major = F.col("group").isNull() | (F.col("group") == F.col("id"))
            sizes = good.groupBy("file_id").agg(F.sum(major.cast("long")).alias("entity_count"), F.count("*").alias("texts"), F.sum("dl").cast("long").alias("terms"))
            new = texts.drop("text").join(failed, "file_id", "left").join(sizes, "file_id", "left").withColumn("indexed_time", F.unix_millis(F.current_timestamp())).withColumn("error", F.col("failure"))
            # Files of the same content under another time are noted anew; what was made of them stays.
            said = stored.select("file_id", "indexed_time", "error", "entity_count", "texts", "terms")
            noted = read.drop("text").join(states.where("state = 'unchanged'").select("file_id"), "file_id", "left_semi").join(said, "file_id")
            new = new.select(*FILES).unionByName(noted.select(*FILES))
            new = put("noted", new.fillna(0, ["entity_count", "texts", "terms"]), scratch=True)
            gone = states.where("state in ('modified', 'pending', 'deleted')").select("file_id", F.lit(True).alias("whole"))
            gone = put("gone", gone.unionByName(noted.select("file_id", F.lit(False).alias("whole"))), scratch=True)
            tally = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}  # a row for each state
            errors = failed.count()
            if not new.isEmpty() or not gone.isEmpty() or fresh:
                sums = lambda df: df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("texts", "terms")]).first().asDict()
                come, went = sums(new), sums(stored.join(gone.select("file_id"), "file_id", "left_semi"))
                delta = {c: come[c] - went[c] for c in come}
                put.log = put.log.append({"files": new, "entities": good}, gone, delta).merged()
        return {s: tally.get(s, 0) for s in ("added", "modified", "pending", "deleted", "unchanged")} | ({"failed": errors} if errors else {})

    def follow(self, stream: DataFrame, checkpoint: str, available_now: bool = True, every: str = changes.QUIET) -> StreamingQuery:
        """Apply a stream of changed paths, relative to root in the column path, micro-batch by micro-batch.

        A batch of more than ``changes.BUDGET`` paths is widened to their folders, and to the whole tree if there are
        still more, so that no change is lost and what comes to the driver is bounded.  An update may run twice.
        """

        def apply(batch: DataFrame, _: int) -> None:
            scopes = changes.widen(batch.select(F.lit(self.name).alias("root"), "path"))
            cover = changes.minimal_cover(scopes.select("path").distinct())
            paths = [r["path"] for r in cover.limit(changes.BUDGET + 1).collect()]
            if paths:
                self.index(paths=None if "" in paths or len(paths) > changes.BUDGET else paths)

        return changes.apply_changes(stream, apply, checkpoint, available_now, every)

    def watch(self, checkpoint: str, waits: bursts.Waits = bursts.Waits(), every: str = "500 milliseconds") -> StreamingQuery:
        """Keep the index up to date: the tree is listed time and again, and what has changed is applied once it has been quiet
        for a while, or its first change has waited the longest.  One path of a root is enough to wake its update; a burst of
        too many is a comparison of the whole tree."""
        changed = watch.changed_files(self.spark, self.root, f"{checkpoint}/listings").withColumn("root", F.lit(self.name))
        with bursts.stateful(self.spark):
            return self.follow(bursts.bursts(changed, None, waits), checkpoint, available_now=False, every=every)

    def _entities(self, texts: DataFrame) -> DataFrame:
        if self.tokens is not None:
            texts = texts.withColumn("budget", chunking.chunk_budget(F.col("text"), self.tokens))
        cut = chunking.entities(texts, self.size, self.overlap).withColumnRenamed("content", "text")
        cut = cut.withColumn("id", index.entity_id(F.col("file_id"), F.col("index")))
        cut = cut.withColumn("group", F.when(F.col("group").isNotNull(), hash_id(F.col("file_id"), F.col("group").cast("string"))))
        header = F.concat_ws(" ", "symbol_type", "scope", "symbol_name", "heading")
        cut = cut.withColumn("_embedded", F.when(F.col("text").isNotNull(), chunking.vector_text(header, F.col("text"), self.size)))
        return embed.embed(cut, "_embedded", self.model, self.dimensions, failure_col="failure").drop("_embedded")

    def status(self) -> dict[str, int] | None:
        """Counters of the index, or None without one."""
        return index.status(self.snapshots.read("files")).first().asDict() if self.snapshots.manifest else None

    def files(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        """Indexed files in the order of their paths."""
        rows = self.snapshots.read("files").orderBy("path").offset(offset)
        return rows if limit is None else rows.limit(limit)

    def drop(self) -> bool:
        """Remove the index; whether there was one."""
        return self.snapshots.drop()

    # Search

    def hits(self, plan: SearchPlan) -> tuple[DataFrame, list[str]]:
        """The ranked hits (route, path, id, rank, score) of a resolved plan by entity that is ranked, and its routes."""
        entities, known = self.snapshots.read("entities"), self.snapshots.read("files")
        kept = known.where(file_filter(plan, F.col("path"), F.col("last_modified"), F.col("format"))).select("file_id")
        pool = entities.join(kept, "file_id", "left_semi")
        if plan.symbol_types:
            pool = pool.where(F.col("symbol_type").isin(list(plan.symbol_types)))
        if plan.symbols:
            pool = pool.where(F.col("symbol_name").isin(list(plan.symbols)))
        # Postings answer what no filter narrows to a few; statistics are those of all entities.
        posted = self._posted()
        out, names = None, []
        for route in plan.routes:
            branches = []
            if route.mode == "fts":
                branches.append((route.id, recall.bm25_postings(*posted, route.query, pool)))
                if plan.prefer_symbol and (named := symbol_names(route.query)):
                    mine = pool.where(meant(F.col("symbol_name"), F.col("scope"), named))
                    branches.append((route.id + ".prefer-symbol", recall.bm25_postings(*posted, route.query, mine)))
            else:
                query = self.spark.createDataFrame([([float(x) for x in self.model(route.query)],)], "embedding array<float>")
                branches.append((route.id, recall.vector_scores(pool, query, self.metric, "id")))
            for name, scored in branches:
                one = recall.route(scored, name, route.mode, "id")
                names.append(name)
                out = one if out is None else out.unionByName(one)
        hits = recall.collapse(out, entities).withColumn("member", F.col("id")).withColumn("id", F.col("public_id"))
        depth = recall.adaptive_depth(hits, plan.limit).select("depth")
        return hits.crossJoin(F.broadcast(depth)).where(F.col("rank") <= F.col("depth")).drop("depth"), names  # a single row

    def search(self, plan: SearchPlan) -> DataFrame:
        """(id, score, matched_by, rank, path, start_line, end_line, text, symbol_type, symbol_name, evidence): the best
        entities of a plan, and the tracked one with its own rank."""
        plan = resolve(plan)
        hits, names = self.hits(plan)
        found = hits.select("route", "path", "id", "rank", "score")
        if plan.tracked is not None:
            sides = [(n, "vector" if n.startswith("vector") else "fts") for n in names]
            found = fusion.force(found, sides, plan.tracked, recall.LAST_DEPTH, self._matches(plan)).drop("forced")
        best = fusion.ranked(fusion.fuse(found, names), plan.limit, tracked=plan.tracked)
        evidence = fusion.evidence(hits.select("public_id", "rank", "path", F.col("member").alias("id"))).withColumnRenamed("public_id", "id")
        return self._shown(best).join(evidence, "id", "left")

    def _posted(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Postings, the texts they speak of and (n, avgdl) of these, one row."""
        log = self.snapshots.log(self.snapshots.manifest)
        n, terms = (log.state.sums.get(c, 0) for c in ("texts", "terms"))
        stats = self.spark.createDataFrame([(n, terms / n if n else None)], "n long, avgdl double")
        return log.read("postings", numbers=True), log.read("entities", numbers=True), stats

    def _matches(self, plan: SearchPlan) -> DataFrame:
        """(route, score) of the routes that the tracked entity matches when they are run on it alone."""
        pool = self.snapshots.read("entities").where(F.col("id") == plan.tracked)
        posted, out = self._posted(), None
        for route in plan.routes:
            if route.mode == "fts":
                scored = recall.bm25_postings(*posted, route.query, pool)
            else:
                query = self.spark.createDataFrame([([float(x) for x in self.model(route.query)],)], "embedding array<float>")
                scored = recall.vector_scores(pool, query, self.metric, "id")
            one = scored.select(F.lit(route.id).alias("route"), "score")
            out = one if out is None else out.unionByName(one)
        return out

    def diagnose(self, plan: SearchPlan, entity: str) -> DataFrame:
        """(route, depth_reached, rank, score, reason) for each route of a plan: where an entity stands in it, or why it
        doesn't: it isn't indexed, a filter leaves it out, the route doesn't match it, or it comes behind the last depth."""
        plan = resolve(plan)
        entities, known = self.snapshots.read("entities"), self.snapshots.read("files")
        there = entities.where(F.col("id") == entity).select("file_id", "symbol_type")
        passed = there.join(known.where(file_filter(plan, F.col("path"), F.col("last_modified"), F.col("format"))), "file_id", "left_semi")
        if plan.symbol_types:
            passed = passed.where(F.col("symbol_type").isin(list(plan.symbol_types)))
        if plan.symbols:
            passed = passed.join(entities.where((F.col("id") == entity) & F.col("symbol_name").isin(list(plan.symbols))).select("file_id").distinct(), "file_id", "left_semi")
        hits, names = self.hits(plan)
        mine = hits.where(F.col("id") == entity).groupBy("route").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
        reached = hits.groupBy("route").agg(F.max("rank").alias("depth_reached"))
        routes = self.spark.createDataFrame([(n, i) for i, n in enumerate(names)], "route string, n int")
        facts = there.agg((F.count("*") > 0).alias("indexed")).crossJoin(passed.agg((F.count("*") > 0).alias("passed")))  # a row each
        rows = routes.join(reached, "route", "left").join(mine, "route", "left").crossJoin(F.broadcast(facts))
        depth = F.coalesce("depth_reached", F.lit(0))
        reason = (
            F.when(~F.col("indexed"), "not indexed").when(~F.col("passed"), "left out by a filter").when(F.col("rank").isNotNull(), "found")
            .when(depth >= recall.FIRST_DEPTH, "behind the depth or no match").otherwise("no match")
        )
        return rows.orderBy("n").select("route", depth.alias("depth_reached"), "rank", "score", reason.alias("reason"))

    def context(
        self, queries: Sequence[str], extra: Sequence[Route] = (), fuse: bool = False, limit: int | None = None, **filters
    ) -> DataFrame:
        """The best entities of several queries in their final order.

        Each query is a group of a full-text and a vector route, each extra route a group of its own; the groups' ranks
        are fused, and every query's best entity comes first.  With fuse, all routes are one group.
        """
        groups = [[Route("fts", q), Route("vector", q)] for q in queries] + [[r] for r in extra]
        if not groups:
            raise PlanError("EMPTY_ROUTES", "a context needs a query")
        if fuse:
            groups = [[r for g in groups for r in g]]
        most, items = fusion.group_limit(limit, len(groups)), None
        for n, routes in enumerate(groups, 1):
            hits, names = self.hits(resolve(SearchPlan(routes=routes, limit=most, **filters)))
            best = fusion.ranked(fusion.fuse(hits.select("route", "path", "id", "rank", "score"), names), most)
            one = best.select(F.lit(n).alias("group_no"), F.col("id").alias("key"), "rank")
            items = one if items is None else items.unionByName(one)
        merged = fusion.merge_groups(items)
        primary = [1] if fuse else list(range(1, len(queries) + 1))
        final = fusion.coverage(merged, items, primary).select("key", "final", "reason")
        final = final if limit is None else final.where(F.col("final") <= limit)
        rows = merged.select(F.col("key").alias("id"), "score", "groups").join(final.withColumnRenamed("key", "id"), "id")
        return self._shown(rows)

    def _shown(self, rows: DataFrame) -> DataFrame:
        what = self.snapshots.read("entities").select("id", "file_id", "start_line", "end_line", "text", "symbol_type", "symbol_name")
        where = self.snapshots.read("files").select("file_id", "path")
        return rows.join(what, "id").join(where, "file_id").drop("file_id")

    def enriched(self, found: DataFrame) -> DataFrame:
        """Lines that were found with the smallest definition or section of the index that holds each: its id, symbol_type,
        symbol_name, heading and lines, nulls for what stands in none or in a file that isn't indexed."""
        files_ = self.snapshots.read("files").select("file_id", "path")
        parts = self.snapshots.read("entities").where("symbol_name IS NOT NULL OR heading IS NOT NULL").join(files_, "file_id")
        ranges = parts.select("path", "id", "start_line", "end_line", F.col("symbol_name").isNotNull().cast("int").alias("specificity"))
        about = parts.select(F.col("id").alias("container"), "symbol_type", "symbol_name", "heading", F.col("start_line").alias("container_start"), F.col("end_line").alias("container_end"))
        inside = lexical.containers(found, ranges).drop("span").join(about, "container", "left")
        return found.join(inside, ["path", "line"], "left")

    def lines(self, what: LineSearch | str, enrich: bool = False) -> DataFrame:
        """(path, line, content, start_column, end_column, ...) of lines of the files as they are now, by path and line.

        With context, first_line, last_line and context; with a limit, rank and whether there are more; with enrich, what
        ``enriched`` says.
        """
        ask = line_search(what) if isinstance(what, str) else replace(what)
        for path in ask.paths or []:
            if not any(c in path for c in "*?[{") and not files.exists(self.spark, f"{self.root.rstrip('/')}/{path}"):
                raise PlanError("SEARCH_PATH", f"there is no {path!r} below the root")
        for name in ask.pattern_files:
            if not files.exists(self.spark, f"{self.root.rstrip('/')}/{name}"):
                raise PlanError("PATTERN_FILE", f"there is no {name!r} below the root")
            ask.patterns = [*ask.patterns, *files.pattern_lines(self.spark, f"{self.root.rstrip('/')}/{name}")]
        rows = self._scanned(show_hidden=ask.hidden, no_ignore=ask.no_ignore)
        if ask.paths:
            below = F.lit(False)
            for path in ask.paths:
                below = below | (F.lit(True) if path in (".", "./") else matches_path(F.col("path"), path))
            rows = rows.where(below)
        if ask.globs:
            rows = rows.where(matches_ordered(F.col("path"), ask.globs))
        rows = rows.where(file_filter(SearchPlan(file_types=ask.types), F.col("path"), F.col("last_modified"), F.col("format")))
        texts = rows.where("kind <> 'image'").select("path", valid_utf8(F.col("content")).alias("text"))
        regex = line_regex(ask.patterns, **ask.options)
        if ask.before or ask.after:
            found = lexical.first_of_each(lexical.grep_context(texts, regex, ask.before, ask.after), ask.max_count)
        else:
            found = lexical.grep(texts, regex, max_count=ask.max_count)
        if ask.limit is not None:
            found = lexical.limited(found, ask.limit)
        return (self.enriched(found) if enrich else found).orderBy("path", "line")

    @staticmethod
    def enrichment(found: DataFrame) -> DataFrame:
        """One row of counters of enriched lines: lines and files, and how many of them stand in something."""
        inside = F.col("container").isNotNull()
        return found.agg(
            F.count("*").alias("lines"), F.count_distinct("path").alias("files"), F.count(F.when(inside, 1)).alias("enriched_lines"),
            F.count_distinct(F.when(inside, F.col("path"))).alias("enriched_files"),
        )
