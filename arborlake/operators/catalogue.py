"""Files of a catalogue: formats, eligibility, identity, breakdowns, set questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import basename, glob, suffix

#: Folders that a listing leaves out, and those of virtual environments.
EXCLUDED = ("node_modules", ".git", "__pycache__", "build", "dist")
VENVS = (".venv", "venv")
#: The folders, logs and other files that a scan leaves out.
SKIPPED_FOLDERS = (".git", ".venv", "venv", "site-packages", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "node_modules", "dist", "build", "logs")
LOG_FILES = ("*.log", "*.out", "*.err", "*.pid")
SKIPPED_FILES = ("*.sqlite", "*.sqlite3", "*.db", "*.db-wal", "*.db-shm", "*.pyc", "*.pyo", "*.so", "*.dll", "*.dylib", "*.zip", "*.tar", "*.gz", "*.xz", "*.7z", "*.bin")


def derived_paths(docs: DataFrame) -> DataFrame:
    """(doc_id, project_id, path) of documents by their source, language and id; every 11th lies in node_modules."""
    exts = F.array(*[F.lit(x) for x in ("py", "json", "yaml", "md", "txt", "log", "pyc", "unknown")])
    ext = F.element_at(exts, (F.col("doc_id") % 8 + 1).cast("int"))
    inner = F.when(F.col("doc_id") % 11 == 0, "node_modules/").otherwise("")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), inner, F.col("doc_id").cast("string"), F.lit("."), ext)
    return docs.select("doc_id", F.col("source").alias("project_id"), path.alias("path"))


def extension_conflicts(table: DataFrame) -> DataFrame:
    """Extensions (lower-cased) that more than one format claims."""
    return table.withColumn("extension", F.lower("extension")).groupBy("extension").agg(F.count_distinct("format_id").alias("n")).where("n > 1").select("extension", F.lit("FORMAT_EXTENSION_CONFLICT").alias("code"))


def resolve_format(files: DataFrame, table: DataFrame, explicit: str = "format_id") -> DataFrame:
    """An explicit format wins, then the path's extension; else the error FORMAT_UNKNOWN_EXTENSION."""
    known = table.select(F.lower("extension").alias("_ext"), F.col("format_id").alias("_f")).dropDuplicates(["_ext"])
    rows = files.withColumn("_ext", suffix(F.col("path"))).join(known, "_ext", "left")
    found = F.coalesce(explicit, "_f")
    return rows.withColumn("resolved", found).withColumn("error", F.when(found.isNull(), "FORMAT_UNKNOWN_EXTENSION")).drop("_ext", "_f")


def eligible(path: Column, scan_all: bool = False, include_logs: bool = False) -> Column:
    """Whether a path is scanned: none of its folders excluded, no log, no compiled file. include_logs needs scan_all."""
    if include_logs and not scan_all:
        raise ValueError("include_logs without scan_all")
    binary, log = glob(basename(path), *SKIPPED_FILES), glob(basename(path), *LOG_FILES)
    if scan_all:
        return ~binary if include_logs else ~log & ~binary
    folder = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_FOLDERS)))
    return ~folder & ~log & ~binary


def listed(path: Column, show_hidden: bool = False, include_venv: bool = False) -> Column:
    """Whether a default listing shows a path."""
    parts = F.split(path, "/")
    hidden = F.lit(False) if show_hidden else F.exists(parts, lambda s: s.startswith(".") & ~s.isin(".", "..", *VENVS))
    venv = F.lit(False) if include_venv else F.arrays_overlap(parts, F.array(*map(F.lit, VENVS)))
    return ~hidden & ~venv & ~F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED))) & ~glob(basename(path), "*.pyc", "*~", "*.swp")


def breakdown(files: DataFrame, deleted: Column, patterns: dict[str, Column]) -> DataFrame:
    """One row: total, deleted, active, files of each pattern and of none, in one pass."""
    none = F.lit(True)
    for p in patterns.values():
        none = none & ~p
    return files.agg(F.count("*").alias("total"), F.count_if(deleted).alias("deleted"), F.count_if(~F.coalesce(deleted, F.lit(False))).alias("active"), *[F.count_if(c).alias(k) for k, c in patterns.items()], F.count_if(none).alias("other"))


def top_parents(parents: DataFrame, files: DataFrame, key: str, parent_key: str, n: int = 20) -> DataFrame:
    """The parents with most files; one without files counts 0."""
    each = files.groupBy(F.col(key).alias(parent_key)).agg(F.count("*").alias("n"))
    return parents.select(parent_key).join(each, parent_key, "left").select(parent_key, F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), parent_key).limit(n)


def duplicate_groups(rows: DataFrame, *key: str) -> DataFrame:
    """One row: groups of equal keys, rows in them, rows that could go."""
    g = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return g.agg(F.count("*").alias("groups"), zero(F.sum("n")).alias("rows_in_groups"), zero(F.sum(F.col("n") - 1)).alias("removable"))


def coverage(files: DataFrame, chunks: DataFrame, key: str, vector: Column) -> DataFrame:
    """One row: files, those with and without chunks, chunks, share of chunks with a vector in percent (0 of none)."""
    has = files.join(chunks.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("indexed"))
    total = files.agg(F.count("*").alias("total"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count_if(vector).alias("vectors"))
    pct = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.round(100.0 * F.col(a) / F.col(b), 2))
    one = total.join(has, how="cross").join(c, how="cross")  # three rows of aggregates
    return one.select("total", "indexed", (F.col("total") - F.col("indexed")).alias("needing"), pct("indexed", "total").alias("indexed_pct"), "chunks", "vectors", pct("vectors", "chunks").alias("vector_pct"))


def identity_classes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of files of (id, project_id, abs_path, rel_path): same_file, other_project_same_path, same_relative; unrelated pairs are left out."""
    l, r = a.select([F.col(c).alias(f"a_{c}") for c in a.columns]), b.select([F.col(c).alias(f"b_{c}") for c in b.columns])
    full = l.join(r, F.col("a_abs_path") == F.col("b_abs_path")).withColumn("case", F.when(F.col("a_project_id") == F.col("b_project_id"), "same_file").otherwise("other_project_same_path"))
    rel = l.join(r, (F.col("a_rel_path") == F.col("b_rel_path")) & (F.col("a_abs_path") != F.col("b_abs_path")) & (F.col("a_project_id") != F.col("b_project_id"))).withColumn("case", F.lit("same_relative"))
    return full.unionByName(rel).select("a_id", "b_id", "case")


def nearest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Of each path the longest root that encloses it at a folder's end; null if none."""
    n = F.size(F.split("path", "/"))
    up = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))).alias("root"))
    hit = up.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(hit, "path", "left")


def nested_roots(roots: DataFrame) -> DataFrame:
    """Roots that lie in another one."""
    inner = nearest_root(roots.select(F.regexp_replace("root", "/[^/]*$", "").alias("path"), F.col("root").alias("inner")), roots)
    return inner.where("root is not null and inner <> root").select("inner", F.col("root").alias("outer"))


def path_report(files: DataFrame, storage: DataFrame, roots: DataFrame) -> DataFrame:
    """Per file (path, project_root) whether it is correct: stored, in its project's root, spelled normally; else why not and its right root."""
    normal = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), "/\\./|//+", "/")
    rows = files.withColumn("normalized", normal)
    found = nearest_root(rows.select(F.col("normalized").alias("path")).distinct(), roots).withColumnRenamed("path", "normalized")
    rows = rows.join(found, "normalized", "left").join(storage.select(F.col("path").alias("normalized"), F.lit(True).alias("stored")).distinct(), "normalized", "left")
    error = F.when(F.col("stored").isNull(), "MISSING_FILE").when(~F.col("root").eqNullSafe(F.col("project_root")), "OUTSIDE_PROJECT").when(F.col("normalized") != F.col("path"), "NEEDS_NORMALISATION")
    return rows.select("path", "normalized", "root", error.isNull().alias("is_correct"), error.alias("error"))


def ordered_union(*lists: DataFrame) -> DataFrame:
    """Ids (id, seq) of the lists in turn, each where it comes first: (id, position)."""
    rows = None
    for i, l in enumerate(lists):
        part = l.select("id", F.lit(i).alias("list"), "seq")
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy("id").agg(F.min(F.struct("list", "seq")).alias("at"))
    return first.select("id", F.col("at.list").alias("list"), F.col("at.seq").alias("seq"))


def trash_names(rows: DataFrame) -> DataFrame:
    """Folder names of deleted projects (name, deleted_at, id): sanitised, with the time, made unique."""
    base = F.concat(F.regexp_replace(F.trim("name"), "[^A-Za-z0-9._-]+", "_"), F.lit("_"), F.date_format("deleted_at", "yyyyMMdd'T'HHmmss"), F.lit("Z"))
    rows = rows.withColumn("_b", base).withColumn("_k", F.row_number().over(W.partitionBy("_b").orderBy("id")))
    return rows.select("id", F.when(F.col("_k") == 1, F.col("_b")).otherwise(F.concat("_b", F.lit("_"), F.col("_k").cast("string"))).alias("folder"))
