"""The `files(repo, path, content)` source and discovery predicates.

Discovery is a set of path predicates evaluated before `content` is touched,
so Catalyst prunes the content column for path-only consumers (A5) and the
filters reach the parquet scan when `repo`/`path` are plain columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.scalars import file_extension, is_binary, language
from ..session import materialize

FILES_A_TASK = 8192  # files that one task of read_tree opens


def _alt(items: list[str]) -> str:
    return "|".join(x.replace(".", r"\.") for x in items)


# Glob semantics of the default include list: `**` and `*` never match a path
# segment that starts with '.', so dot-directories and dot-files are not
# reached except through the literal `.ssh/config` pattern.
_DOT_SEGMENT = r"(^|/)\."
_EXT_RE = r"(^|/)[^/.][^/]*\.(" + "|".join(C.SOURCE_EXTENSIONS) + r")$"
_NAME_RE = (r"(^|/)(" + "|".join(
    n.replace(".", r"\.").replace(r"\*", "[^/]*").replace("*", "[^/]*")
    for n in C.CONFIG_FILE_NAMES if not n.startswith(".")) + r")$")
_SSH_CONFIG_RE = r"^([^./][^/]*/)*\.ssh/config$"
_EXCLUDE_RE = ("(^|/)(" + _alt(C.DEFAULT_EXCLUDE_DIRS) + ")/"
               + "|(" + _alt(C.DEFAULT_EXCLUDE_SUFFIXES) + ")$"
               + "|(^|/)(" + _alt(C.DEFAULT_EXCLUDE_NAMES) + ")$")


def default_include(path: Column) -> Column:
    plain = ~path.rlike(_DOT_SEGMENT) & (path.rlike(_EXT_RE) | path.rlike(_NAME_RE))
    return plain | path.rlike(_SSH_CONFIG_RE)


def default_exclude(path: Column) -> Column:
    return path.rlike(_EXCLUDE_RE)


def discover(files: DataFrame, include: list[str] | None = None,
             exclude: list[str] | None = None, distinct_paths: bool = False) -> DataFrame:
    """Keep discovered files.  `include` (regexes on the relative
    path) replaces the defaults; `exclude` regexes are added to them.
    One OR-ed predicate replaces the per-pattern union, so S4 is implied;
    `distinct_paths=True` additionally de-duplicates an input table that holds
    the same (repo, path) twice (a shuffle of the content — off by default)."""
    path = F.col("path")
    inc = default_include(path) if include is None else _any(path, include)
    exc = default_exclude(path)
    if exclude:
        exc = exc | _any(path, exclude)
    out = files.where(inc & ~exc)
    if distinct_paths:
        out = out.dropDuplicates(["repo", "path"])
    return out


def _any(path: Column, regexes: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{r})" for r in regexes))


def with_file_meta(files: DataFrame) -> DataFrame:
    """file_meta: language (P1), is_binary (S5), n_chars."""
    return files.select("*", language("path").alias("language"),
                        is_binary("path").alias("is_binary"),
                        F.length("content").cast("long").alias("n_chars"))


def readable(files: DataFrame) -> DataFrame:
    """Binary files and unreadable (null-content) files yield no findings."""
    return files.where(~is_binary("path") & F.col("content").isNotNull())


def ensure_parallelism(df: DataFrame, key: str | None = None,
                       min_partitions: int | None = None) -> DataFrame:
    """Spread a *scan* that yields fewer splits than the cluster has cores (a
    single-row-group file, say) by hashing its key (no sort, unlike a
    round-robin repartition).  Large inputs already have one split per
    ~128 MB and pass through untouched (no shuffle).  `getNumPartitions` on a
    file scan only plans splits; it runs no job."""
    try:
        sc = df.sparkSession.sparkContext
        cores = sc.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # no RDD API (e.g. a remote session): leave the plan as is
        return df
    want = min_partitions or 2 * cores
    if n >= cores:
        return df
    return df.repartition(want, key) if key else df.repartition(want)


def write_files_table(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a `files` table partitioned by derived language, so the usage
    branch (JavaScript/TypeScript only) prunes to its partitions instead of
    reading every file's content a second time."""
    lang = F.coalesce(language("path"), F.lit("none"))
    files.withColumn("lang_part", lang).write.mode(mode).partitionBy("lang_part").parquet(path)


def _lister(root: str, most_rows: int = 1 << 16):
    """A `mapInArrow` function: folders (rel) → their direct entries (rel,
    is_folder), in batches of bounded size."""
    def entries(batches):
        import pyarrow as pa
        from pyarrow import fs as pfs
        files, base = pfs.FileSystem.from_uri(root)
        base = base.rstrip("/")
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = files.get_file_info(pfs.FileSelector(f"{base}/{folder}".rstrip("/") or "/"))
                for i in range(0, len(found), most_rows):
                    some = [f for f in found[i:i + most_rows] if f.is_file or f.type == pfs.FileType.Directory]
                    yield pa.RecordBatch.from_arrays([pa.array([f.path[len(base) + 1:] for f in some], pa.string()),
                                                      pa.array([not f.is_file for f in some], pa.bool_())], ["rel", "is_folder"])
    return entries


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """The paths (rel) of all files below `root`, level by level: the folders
    of each level are dealt out by hash to all tasks again, however the tree
    branches, so one top-level folder with most of the tree is listed by many
    tasks.  Each level is checkpointed; the driver learns only whether folders
    are left.  A job per level; the direct entries of one folder are one
    listing call of one task.  A folder that cannot be listed fails the job."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    folders, levels = spark.createDataFrame([("",)], "rel string"), []
    while not levels or not folders.isEmpty():
        level = materialize(folders.repartition(tasks, "rel").mapInArrow(_lister(root), "rel string, is_folder boolean"))
        levels.append(level.where("not is_folder").select("rel"))
        folders = level.where("is_folder").select("rel")
    return reduce(DataFrame.unionAll, levels)


def _reader(root: str, most_bytes: int = 32 << 20):
    """A `mapInArrow` function: rel → (rel, content), in batches of bounded
    size.  A file that cannot be read has a null content (S6)."""
    def read(batches):
        import pyarrow as pa
        from pyarrow import fs as pfs
        files, base = pfs.FileSystem.from_uri(root)
        base = base.rstrip("/")

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["rel", "content"])

        rows, size = [], 0
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                try:
                    with files.open_input_stream(f"{base}/{rel}") as f:
                        content = f.read().decode("utf-8", "replace")
                except OSError:
                    content = None
                rows.append((rel, content))
                size += len(content or "")
                if size >= most_bytes:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)
    return read


def read_tree(spark: SparkSession, root: str, repo: str | None = None) -> DataFrame:
    """Every regular file below `root`, a path or URI, as (repo, path,
    content).

    With `repo=None` the first directory level below `root` is the repository
    (a checkout per directory).  Undecodable bytes become U+FFFD as in a
    UTF-8 text read; unreadable files have a null content (S6).

    Spark's file sources skip names that start with `_` or `.`, which are
    ordinary in source trees (`__init__.py`, `_app.tsx`, `.ssh/config`), so
    tasks list the tree (`list_tree`, when this is called), and the paths,
    hashed so that a repository with a large share of all files is spread, are
    read by tasks of at most about FILES_A_TASK files."""
    listed = list_tree(spark, root)
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-listed.count() // FILES_A_TASK))
    raw = listed.repartition(tasks, "rel").mapInArrow(_reader(root), "rel string, content string")
    if repo is None:
        return raw.select(F.substring_index("rel", "/", 1).alias("repo"),
                          F.expr("substring(rel, length(substring_index(rel, '/', 1)) + 2)").alias("path"),
                          "content")
    return raw.select(F.lit(repo).alias("repo"), F.col("rel").alias("path"), "content")


__all__ = ["ensure_parallelism", "write_files_table", "discover", "with_file_meta", "readable", "list_tree", "read_tree", "default_include",
           "default_exclude", "file_extension", "language", "is_binary"]
