"""Files as rows: scanning a tree, telling their types, and the rules that leave some out."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import glob_regex, hash_id, matches_ordered, matches_path, normal_path, valid_utf8
from .scratch import written

# Formats by extension or file name, and the kinds they belong to.
NAMED = {"Dockerfile": "dockerfile", "Makefile": "makefile"}
CODE = {
    "c": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp", "go": "go", "java": "java", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "py": "python", "rs": "rust", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "kts": "kotlin",
    "cs": "csharp", "scala": "scala", "sh": "bash", "bash": "bash", "zsh": "bash", "sql": "sql", "css": "css", "scss": "scss", "less": "less", "vue": "vue", "svelte": "svelte", "vb": "vb",
}
DATA = {"csv": "csv", "json": "json", "jsonc": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml"}
TEXT = {"md": "markdown", "mdx": "markdown", "rst": "rst", "txt": "text", "html": "html", "htm": "html", "xml": "xml"}
IMAGE = {"gif": "gif", "jpeg": "jpeg", "jpg": "jpeg", "png": "png", "webp": "webp"}
BINARY = "zip tar gz bz2 xz 7z rar exe dll dylib so a o obj wasm class jar pdf doc docx ppt pptx xls xlsx mp3 mp4 mov avi mkv db sqlite".split()
HARD = [".git"]
# Folders and files that are left out unless they are asked for.
IGNORED_FOLDERS = (
    "node_modules vendor thirdparty third_party external deps dist build out target coverage generated __pycache__ venv .venv env .tox .eggs Pods .next .nuxt "
    ".svelte-kit .turbo .vite .parcel-cache .cache .gradle .pytest_cache .mypy_cache .ruff_cache tmp temp logs locale locales translations"
).split()
IGNORED_FILES = (
    "*.lock *.lockb *-lock.json *-lock.yaml npm-shrinkwrap.json go.sum *.resolved *.po *.pot *.map *.min.* *.bundle.* *.generated.* *.gen.* *.designer.* *.pb.* "
    "*_pb2.* *.g.* *.gif *.jpeg *.jpg *.png *.webp"
).split()
#: Largest sizes by kind, and the most that an override may allow.
SIZES = {"code": 1 << 20, "text": 256 << 20, "data": 16 << 20, "image": 10 << 20}
MOST = 512 << 20
SNIFFED = 8192


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_type(path: Column) -> tuple[Column, Column]:
    """(kind, format) by a path's name: named files, then code, data, text and image extensions; a binary extension has
    no kind, an unknown one is a text of that format, and none at all a plain text.  A dot at a name's start begins no
    extension."""
    name = base_name(path)
    plain = F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    extension = F.regexp_extract(plain, r"^.+\.([^.]*)$", 1)
    table = {k: ("", "") for k in BINARY} | {"": ("text", "text")}
    for kind, names in (("image", IMAGE), ("text", TEXT), ("data", DATA), ("code", CODE)):
        table |= {k: (kind, v) for k, v in names.items()}
    named = {k: ("code", v) for k, v in NAMED.items()}

    def look(place: int, otherwise: Column) -> Column:
        found = [F.create_map(*chain.from_iterable((F.lit(k), F.lit(v[place])) for k, v in t.items())) for t in (named, table)]
        value = F.coalesce(F.element_at(found[0], name), F.element_at(found[1], extension), otherwise)
        return F.nullif(value, F.lit(""))

    return look(0, F.lit("text")), look(1, extension)


def size_limit(kind: Column, override: int | None = None) -> Column:
    """The largest size of a kind of file; an override holds for all, up to MOST."""
    if override is not None:
        if override <= 0:
            raise ValueError("a file size limit is at least 1")
        return F.lit(min(override, MOST)).cast("long")
    limit: Column = F.lit(None).cast("long")
    for k, n in SIZES.items():
        limit = F.when(kind == k, F.lit(n).cast("long")).otherwise(limit)
    return limit


def looks_binary(content: Column) -> Column:
    """Whether the first bytes hold a zero or over 30 % of control bytes."""
    head = F.hex(F.substring(content, 1, SNIFFED))
    n = F.char_length(head) / 2
    bytes_ = F.regexp_replace(head, "(..)", "$1 ")
    control = F.regexp_count(bytes_, F.lit(r"(?:0[0-6]|0B|0E|0F|1[0-9AC-F]) "))
    return F.coalesce(bytes_.rlike("(^| )00 ") | (control > 0.3 * n), F.lit(False))


def depth_allowed(relative: Column, most: int | None) -> Column:
    return F.lit(True) if most is None else F.size(F.split(relative, "/")) <= most


def hidden(relative: Column) -> Column:
    return relative.rlike(r"(^|/)\.[^/.]")


def default_ignored(relative: Column) -> Column:
    parts = F.split(relative, "/")
    folders = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(IGNORED_FOLDERS))
    names = F.lit(False)
    for glob in IGNORED_FILES:
        names = names | relative.rlike(glob_regex(glob))
    return folders | names


def ignore_rules(folder: str, content: str) -> Iterator[tuple[str, bool, bool, str | None]]:
    """(regular expression, negated, folders only, name) of the lines of a folder's ignore file, in order.  A pattern whose
    last part is a plain name, or a star and one ending, has that as its name, by which paths can be looked up."""
    base = re.escape(folder.strip("/") + "/") if folder.strip("/") else ""
    for line in content.splitlines():
        line = line.rstrip() if not line.endswith("\\ ") else line
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated or line[:2] in ("\\#", "\\!") else line
        only_folders, line = line.endswith("/"), line.rstrip("/")
        if not line:
            continue
        anchored = "/" in line
        # A slash in front keeps a pattern from being taken for a name at any depth.
        body = glob_regex("/" + line.lstrip("/"))[1:-1].replace("/", "", 1)
        name = line.rpartition("/")[2]
        plain = re.fullmatch(r"(?:\*\.)?[^*?\[\]{}\\.][^*?\[\]{}\\]*|\.[^*?\[\]{}\\]*", name) and not (name.startswith("*") and name.count(".") > 1)
        yield f"^{base}{'' if anchored else '(?:.*/)?'}{body}$", negated, only_folders, name if plain else None


RULES = "folder string, place long, regex string, negated boolean, only_folders boolean, name string"


def rule_table(ignore_files_: DataFrame) -> DataFrame:
    """RULES: the rules of all ignore files (folder, content), parsed where they are read."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]
        for batch in batches:
            for folder, content in zip(*[c.to_pylist() for c in batch.columns]):
                found = [(folder.strip("/"), i, *rule) for i, rule in enumerate(ignore_rules(folder, content))]
                for at in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found[at : at + 10_000]), kinds)], [c.split()[0] for c in RULES.split(", ")])

    return ignore_files_.select("folder", "content").mapInArrow(parsed, RULES)


def _above(parts: Column, count: Column) -> Column:
    """The first 0, 1 .. count parts of a path, each as a path."""
    return F.transform(F.sequence(F.lit(0), count), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def ignored(paths: DataFrame, rules: DataFrame, path_col: str = "path") -> DataFrame:
    """The paths, each once, that the rules ignore: themselves or a folder above them.

    Rules are rows.  A folder is judged once however many files are below it.  Files and folders meet the rules of the
    folders above them by equality, on that folder and on the name where a rule has one, so that only patterns with signs in
    their last part are tried on all that is below; of the rules that match the deepest folder's last one decides.
    """
    each, parts = paths.select(F.col(path_col).alias("path")).distinct(), F.split("path", "/")
    below = each.select("path", F.explode(F.filter(_above(parts, F.size(parts) - 1), lambda a: a != "")).alias("entry"))
    entries = each.select(F.col("path").alias("entry"), F.lit(False).alias("is_folder")).unionByName(below.select("entry", F.lit(True).alias("is_folder")).distinct())
    steps = F.split("entry", "/")
    base = F.element_at(steps, -1)
    homes = entries.select("entry", "is_folder", base.alias("base"), F.explode(_above(steps, F.size(steps) - 1)).alias("home"))
    ending = F.concat(F.lit("*."), F.element_at(F.split("base", r"\."), -1))
    keyed = homes.withColumn("key", F.explode(F.array_distinct(F.array("base", ending))))
    fits = (F.col("is_folder") | ~F.col("only_folders")) & F.expr("entry RLIKE regex")
    named = keyed.join(rules.where("name IS NOT NULL"), (F.col("home") == F.col("folder")) & (F.col("key") == F.col("name")))
    other = homes.join(rules.where("name IS NULL"), F.col("home") == F.col("folder"))
    columns = ["entry", "is_folder", "home", "place", "negated"]
    met = named.where(fits).select(*columns).unionByName(other.where(fits).select(*columns))
    last = F.max_by("negated", F.struct(F.char_length("home"), "place"))  # of folders above a path the longer is the deeper
    left_out = met.groupBy("entry", "is_folder").agg(last.alias("negated")).where("not negated")
    own = left_out.where("not is_folder").select(F.col("entry").alias("path"))
    inside = below.join(left_out.where("is_folder").select("entry"), "entry", "left_semi").select("path")
    return own.unionByName(inside).distinct().withColumnRenamed("path", path_col)


def skip_reason(kind: Column, size: Column, binary: Column, override: int | None = None) -> Column:
    """Why a file isn't indexed: empty, unsupported, too_large or binary; null if it is."""
    limit = size_limit(kind, override)
    return (
        F.when(size == 0, "empty").when(kind.isNull(), "unsupported").when(size > limit, "too_large").when(binary & (kind != "image"), "binary")
    )


def skip_report(files: DataFrame, samples: int = 20) -> DataFrame:
    """(reason, skipped, samples): counts by reason and the first paths of each.  Samples are a bounded report: paths are
    cut to the first ones within each reason and hash bucket before the reasons meet."""
    skipped = files.where(F.col("reason").isNotNull()).withColumn("_b", F.pmod(F.xxhash64("path"), F.lit(64)))
    first = Window.partitionBy("reason", "_b").orderBy("path")
    some = skipped.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= samples)
    listed = some.groupBy("reason").agg(F.slice(F.array_sort(F.collect_list("path")), 1, samples).alias("samples"))
    return skipped.groupBy("reason").agg(F.count("*").alias("skipped")).join(listed, "reason")


#: Folders that are looked into for more of them before the tree is dealt out, and the most that come to the driver.
WIDE, MOST_FOLDERS, LEVELS = 256, 10_000, 4
LISTED = "path string, relative_path string, size_bytes long, last_modified long, unreadable boolean"


def _system(root: str):
    """(file system, root's path in it, prefix of its uris) on the machine that asks."""
    from pyarrow import fs

    scheme = root.partition("://")[0] + "://" + root.partition("://")[2].partition("/")[0] if "://" in root else ""
    system, base = fs.FileSystem.from_uri(root if scheme else "file://" + quote(os.path.abspath(root)))
    return system, base.rstrip("/"), scheme


def _children(system, folder: str) -> tuple[list, list]:
    """(files, folders) in a folder; links to folders are left out, so that no walk runs in a circle."""
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(folder, recursive=False))
    local = isinstance(system, fs.LocalFileSystem)
    folders = [f for f in found if f.type == fs.FileType.Directory and not (local and os.path.islink(f.path))]
    return [f for f in found if f.type == fs.FileType.File], folders


def listing(spark: SparkSession, root: str, paths: Sequence[str] | None = None) -> DataFrame:
    """LISTED rows of all files below root, or below and of some paths relative to it, hidden and empty ones too.

    Executors list: the first levels are gone through until there are enough folders to deal out, of which the driver
    learns the names of MOST_FOLDERS at most, and each task walks the trees of its folders.  A folder that can't be read is
    a row of its own, unreadable, and ignore files above the paths are listed along.
    """

    def walk(recursive: bool, only_folders: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            system, base, _ = _system(root)
            names = ["path", "relative_path", "size_bytes", "last_modified", "unreadable"]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]

            def record(info) -> tuple:
                size = None if info.type == fs.FileType.Directory else info.size
                return info.path, info.path[len(base) + 1 :], size, (info.mtime_ns or 0) // 1_000_000, False

            for batch in batches:
                out: list[tuple] = []
                for start in batch.column(0).to_pylist():
                    todo = [f"{base}/{start}".rstrip("/")]
                    while todo:
                        folder = todo.pop()
                        try:
                            info = system.get_file_info(folder)
                            if info.type == fs.FileType.NotFound:
                                continue
                            files, folders = ([info], []) if info.type == fs.FileType.File else _children(system, folder)
                        except OSError:
                            out.append((folder, folder[len(base) + 1 :], None, 0, True))
                            continue
                        out += [record(f) for f in (folders if only_folders else files)]
                        if recursive:
                            todo += [f.path for f in folders]
                        if len(out) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        return rows

    def dealt(folders: list[str], recursive: bool, only_folders: bool = False) -> DataFrame:
        table = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(max(1, min(len(folders), 1024)), "folder")
        return table.mapInArrow(walk(recursive, only_folders), LISTED)

    if paths is not None:
        above = {"/".join(p.split("/")[:n]) for p in paths for n in range(len(p.split("/")))}
        found = dealt(sorted(set(paths)), True)
        rules = dealt(sorted(f"{a}/.gitignore".lstrip("/") for a in above), False)
        return found.unionByName(rules).dropDuplicates(["path"])
    flat, frontier = [], [""]
    for _ in range(LEVELS):
        if len(frontier) >= WIDE:
            break
        below = [r[0] for r in dealt(frontier, False, True).where("not unreadable").select("relative_path").limit(MOST_FOLDERS + 1).collect()]
        if len(below) > MOST_FOLDERS:
            break
        flat, frontier = flat + frontier, below
        if not below:
            break
    shallow = dealt(flat, False) if flat else None
    deep = dealt(frontier, True) if frontier else None
    return shallow.unionByName(deep) if shallow is not None and deep is not None else shallow if deep is None else deep


def ignore_files(listed: DataFrame, root: str) -> DataFrame:
    """(folder, content) of the ignore files among listed ones, read on the executors."""
    found = contents(listed.where(F.col("relative_path").rlike(r"(^|/)\.gitignore$") & ~F.col("unreadable")), root)
    relative = F.substring("path", len(_system(root)[1]) + 2, 1 << 30)
    return found.select(F.regexp_replace(relative, r"/?[^/]*$", "").alias("folder"), valid_utf8(F.col("content")).alias("content"))


def listed_files(
    spark: SparkSession, root: str, workspace: str, include: Sequence[str] = (), exclude: Sequence[str] = (), globs: Sequence[str] = (),
    show_hidden: bool = False, no_ignore: bool = False, max_depth: int | None = None, max_size: int | None = None, nested_git: bool = False,
    paths: Sequence[str] | None = None, hard: Sequence[str] = (),
) -> DataFrame:
    """The files below root with identity, type, time and size, by their metadata alone; what rules leave out is no row,
    and folders that can't be read are rows of their own.  hard names further folders, relative to root, that are never
    looked at, as that of an index within the tree."""
    whole = written(listing(spark, root, paths), "listing")  # which several steps read
    rows, unreadable = whole.where("not unreadable"), whole.where("unreadable")
    relative = F.col("relative_path")
    parts = F.split(relative, "/")
    git = rows.where(relative.rlike(r"/\.git/")).select(F.regexp_extract(relative, r"^(.*?)/\.git/", 1).alias("nested")).distinct()
    rows = rows.where(~F.exists(parts, lambda p: p.isin(HARD)) & ~relative.rlike(r"(^|/)\.gitignore$") & ~_any(relative, hard))
    if not nested_git:  # folders above a file meet the nested roots by equality
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        inside = rows.select("path", F.explode(above).alias("nested")).join(git, "nested", "left_semi").select("path").distinct()
        rows = rows.join(inside, "path", "left_anti")
    named = _any(relative, [p for p in include if "." in p])
    if not show_hidden:
        rows = rows.where(~hidden(relative) | named)
    if not no_ignore:
        spared = _any(relative, include)
        gone = ignored(rows.where(~spared), rule_table(ignore_files(whole, root)), "relative_path")
        rows = rows.where(~default_ignored(relative) | spared).join(gone, "relative_path", "left_anti").select(*rows.columns)
    rows = rows.where(depth_allowed(relative, max_depth) & ~_any(relative, exclude))
    if include:
        rows = rows.where(_any(relative, include))
    if globs:
        rows = rows.where(matches_ordered(relative, list(globs)))
    rows = rows.unionByName(unreadable)
    kind, format_ = file_type(F.col("path"))
    rows = rows.withColumn("kind", kind).withColumn("format", format_).withColumn("file_id", hash_id(workspace, normal_path(F.col("path"))))
    reason = F.when(F.col("unreadable"), "unreadable").otherwise(skip_reason(F.col("kind"), F.col("size_bytes"), F.lit(False), max_size))
    return rows.withColumn("reason", reason)


def with_contents(rows: DataFrame, root: str) -> DataFrame:
    """rows of listed files with their content, read on the executors, and the reason if it looks binary; a file that is
    gone by now has none."""
    read = contents(rows.where("reason is null"), root)
    rows = rows.join(read, "path", "left")
    binary = F.when(F.col("kind") != "image", F.when(looks_binary(F.col("content")), "binary"))
    return rows.withColumn("reason", F.coalesce("reason", binary))


def scan(spark: SparkSession, root: str, workspace: str, **options) -> DataFrame:
    """The files below root with identity, type, time, size, content and skip reason; see ``listed_files``."""
    return with_contents(listed_files(spark, root, workspace, **options), root)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def pattern_lines(spark: SparkSession, path: str) -> list[str]:
    """The patterns of a small file: its lines without line ends, and none that is empty, which would match every line."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    stream.close()
    lines = [line.removesuffix("\r") for line in data.decode("utf-8", "replace").split("\n")]
    return [line for line in lines if line]


def formats() -> set[str]:
    """All formats that names of files stand for."""
    return {f for table in (NAMED, CODE, DATA, TEXT, IMAGE) for f in table.values()}


def overlapping(roots: Sequence[str]) -> list[tuple[str, str]]:
    """Pairs of roots of which the second lies in the first, or is it."""
    clean = [r.rstrip("/") for r in roots]
    return [(a, b) for i, a in enumerate(clean) for j, b in enumerate(clean) if i != j and (b.startswith(a + "/") or a == b and i < j)]


def contents(paths: DataFrame, root: str) -> DataFrame:
    """(path, content) of files of root's file system, each opened on an executor; a file that is gone has no row."""
    scheme = root.partition("://")[0] + "://" + root.partition("://")[2].partition("/")[0] if "://" in root else ""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(scheme + path if scheme else "file://" + quote(path))
                try:
                    with system.open_input_stream(name) as file:
                        data = file.read()
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([data], pa.binary())], ["path", "content"])

    return paths.select("path").mapInArrow(read, "path string, content binary")


def _any(path: Column, patterns: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | matches_path(path, p)
    return found
