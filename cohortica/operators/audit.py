"""Audits of files, packages and bundles; every rule is a query that returns what breaks it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortica.functions.scalars import holds_bytes, is_image


def manifest_mismatches(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """name, path, problem of each entry (name, path, sha256) whose file (path, sha256) is missing or differs, in order."""
    rows = manifest.join(files.select("path", F.col("sha256").alias("found")), "path", "left")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "differs")
    return rows.withColumn("problem", problem).where(F.col("problem").isNotNull()).orderBy("name", "path").select("name", "path", "problem")


def mismatch_list(mismatches: DataFrame) -> DataFrame:
    """One row a name: its bad paths in order."""
    return mismatches.groupBy("name").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def size_rollup(files: DataFrame, inside: str = "Contents/Resources", deep: int = 4, flat: int = 2) -> DataFrame:
    """Bytes by the first parts of a path, more of them below ``inside``, and their total, in one rollup; largest first, the total on top."""
    parts = F.split("path", "/")
    below = F.col("path").startswith(f"{inside}/")
    group = F.array_join(F.slice(parts, 1, F.when(below, deep).otherwise(flat)), "/")
    sums = files.select(group.alias("group"), "size").rollup("group").agg(F.sum("size").alias("bytes"), F.grouping("group").alias("whole"))
    return sums.select(F.when(F.col("whole") == 1, "total").otherwise(F.col("group")).alias("group"), "bytes", F.col("whole").cast("int").alias("is_total")).orderBy(F.col("is_total").desc(), F.col("bytes").desc(), "group")


def size_report(sums: DataFrame) -> DataFrame:
    """Lines of a report over :func:`size_rollup`."""
    line = F.when(F.col("is_total") == 1, F.format_string("%8.2f GB  %s", F.col("bytes") / 1e9, "group")).otherwise(F.format_string("%8.1f MB  %s", F.col("bytes") / 1e6, "group"))
    return sums.select("group", "bytes", line.alias("line"))


def dependencies(asked: DataFrame, steps: DataFrame) -> DataFrame:
    """pos, model: what a selection (pos, model) needs, dependencies first, each once.  ``steps``: model, step_pos, step; none means itself."""
    rows = asked.join(steps, "model", "left").select("pos", F.coalesce("step_pos", F.lit(0)).alias("step_pos"), F.coalesce("step", "model").alias("step"))
    first = rows.groupBy("step").agg(F.min(F.struct("pos", "step_pos")).alias("at"))
    order = Window.orderBy("at")  # a row per distinct model of a selection
    return first.select(F.row_number().over(order).alias("pos"), F.col("step").alias("model"))


def category_users(imports: DataFrame, symbols: DataFrame, declared: DataFrame) -> DataFrame:
    """category, files, example, declared: files whose imports (path, symbol) touch a category (category, symbol)."""
    used = imports.join(F.broadcast(symbols), "symbol").groupBy("category").agg(F.count_distinct("path").alias("files"), F.min("path").alias("example"))
    return used.join(declared.select("category").distinct().withColumn("declared", F.lit(True)), "category", "left").select(
        "category", "files", "example", F.coalesce("declared", F.lit(False)).alias("declared")
    ).orderBy("category")


def first_packages(packages: DataFrame) -> DataFrame:
    """The first row (by pos) of each package name, whatever its case."""
    rank = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("pos"))
    return packages.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def unapproved(packages: DataFrame, approvals: DataFrame) -> DataFrame:
    return packages.join(approvals.select(F.lower("name").alias("_name")), F.lower(packages["name"]) == F.col("_name"), "left_anti")


def notices(packages: DataFrame, texts: DataFrame) -> DataFrame:
    """pos, line of a notices file: a table of packages, then each text under its package and file name."""
    head = packages.select(F.struct(F.lit(0), F.lower("name"), F.lit("")).alias("at"), F.concat_ws(" | ", "name", "version", "licence").alias("line"))
    body = texts.select(F.struct(F.lit(1), F.lower("name"), F.col("file")).alias("at"), F.concat(F.col("name"), F.lit(": "), F.col("file"), F.lit("\n\n"), F.col("text")).alias("line"))
    return head.unionByName(body).orderBy("at").select("line")


def lock_check(wanted: DataFrame, lock: DataFrame) -> DataFrame:
    """model, problem: models whose url or digest is not what the lock has, or that it does not know."""
    rows = wanted.join(lock.select("model", F.col("url").alias("_url"), F.col("sha256").alias("_sha")), "model", "left")
    problem = F.when(F.col("_url").isNull() & F.col("_sha").isNull(), "unknown").when(~F.col("url").eqNullSafe(F.col("_url")), "url").when(~F.col("sha256").eqNullSafe(F.col("_sha")), "digest")
    return rows.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("model", "problem")


def model_folders(models: DataFrame, versions: DataFrame) -> DataFrame:
    """model, problem: folders that are missing, have no version file or name another url."""
    rows = models.join(versions.select("folder", F.col("url").alias("recorded"), F.lit(True).alias("there")), "folder", "left")
    problem = F.when(F.col("there").isNull(), "not found").when(F.col("recorded").isNull(), "version missing").when(F.col("recorded") != F.col("url"), "other version")
    return rows.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("model", "problem")


def bundle_violations(files: DataFrame, forbidden: list[bytes], model_root: str = "models/") -> DataFrame:
    """rule, path: files that hold a forbidden string, and images among the models.  ``files``: path, content."""
    rules: list[tuple[str, Column]] = [("image among models", F.col("path").contains(model_root) & is_image(F.col("path")))]
    rules += [(f"holds {p.decode('ascii', 'replace')}", holds_bytes(F.col("content"), p)) for p in forbidden]
    parts = [F.when(test, F.lit(name)) for name, test in rules]
    return files.select("path", F.explode(F.array_compact(F.array(*parts))).alias("rule")).select("rule", "path")


def invert_labels(labels: Column) -> Column:
    """{name: id} to {id: name} without id 0."""
    pairs = F.transform(F.map_entries(labels), lambda e: F.struct(e["value"].cast("int").alias("key"), e["key"].alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda e: e["key"] != 0))


def union_rules(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)
