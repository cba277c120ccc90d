"""Reading of source trees, repository lists and stored tables; keyed writing."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T


def repository_urls(spark: SparkSession, path: str) -> DataFrame:
    """url, name of each line of a list; blank lines, and those that begin with #, are left out."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(T.clone_url(F.col("value")).alias("url"), T.repo_name(T.clone_url(F.col("value"))).alias("name"))


def source_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, content (bytes), length, modificationTime of the files under a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(root)


def indexable(path: Column, length: Column, include: list[str], exclude: list[str], max_bytes: int = 1 << 20) -> Column:
    """Whether a file is small enough, has a wanted extension and matches no exclusion (a part of the path, or a glob)."""
    wanted = T.extension(path).isin(include) if include else F.lit(True)
    out = F.lit(False)
    for rule in exclude:
        out = out | (path.rlike(fnmatch.translate(rule)) if any(c in rule for c in "*?[") else F.contains(path, F.lit(rule)))
    return (length <= max_bytes) & wanted & ~out


def decoded(files: DataFrame) -> DataFrame:
    """path, content as text, bytes that are no UTF-8 replaced."""
    return files.withColumn("content", F.decode("content", "utf-8")) if dict(files.dtypes)["content"] == "binary" else files


def file_records(files: DataFrame) -> DataFrame:
    """path, content_hash, language, file_type, n_chars, n_lines, has_docstring of rows with path and content."""
    c = F.col("content")
    return files.select(
        "path", F.sha2(c.cast("binary"), 256).alias("content_hash"), T.language(F.col("path"), fold=True).alias("language"), T.file_type(F.col("path")).alias("file_type"),
        F.length(c).cast("long").alias("n_chars"), F.size(F.split(c, "\n")).cast("long").alias("n_lines"), (F.contains(c, F.lit('"""')) | F.contains(c, F.lit("'''"))).alias("has_docstring"),
    )


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that several rows have, with their number: empty if the keys are unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def save(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace a stored table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def load(spark: SparkSession, path: str, order: list[Column] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.orderBy(*order) if order else df


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def flattened(df: DataFrame) -> DataFrame:
    """Structs, maps and arrays of structs as JSON text; arrays of plain values stay."""
    plain = lambda kind: not kind.startswith(("struct", "map", "array<struct", "array<map", "array<array"))
    return df.select(*[F.col(c) if plain(kind) else F.to_json(c).alias(c) for c, kind in df.dtypes])


def markdown(df: DataFrame, title: str, limit: int = 100) -> str:
    """A table in Markdown of the first rows, at most `limit`."""
    rows = df.limit(limit).collect()
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def complete_functions(spark: SparkSession, path: str, suffix: str = "_complete") -> DataFrame:
    """repository, and the fields of each function, of JSON files that each hold one repository's {"functions": [...]}.

    The repository is the file's name without its extension, and without what follows the suffix.
    """
    rows = spark.read.option("multiLine", "true").json(path).withColumn("file_", T.basename(F.input_file_name()))
    name = F.regexp_replace(F.col("file_"), rf"({suffix}.*)?\.json$", "")
    if "functions" not in rows.columns:
        return rows.select(name.alias("repository")).limit(0)
    return rows.select(name.alias("repository"), F.explode("functions").alias("function_")).select("repository", "function_.*")


def changed_since(files: DataFrame, since: Column, include: list[str], exclude: list[str]) -> DataFrame:
    """Files that were modified after a time and are to be indexed."""
    return files.filter((F.col("modificationTime") > since) & indexable(F.col("path"), F.col("length"), include, exclude))


def index_entries(files: DataFrame, indexed_at: Column) -> DataFrame:
    """The rows of a file index: those of file_records, with the time at which they were indexed."""
    return file_records(files).withColumn("indexed_at", indexed_at)


def indexed_files(index: DataFrame, limit: int | None = None) -> DataFrame:
    """The entries of a file index, the latest first."""
    rows = index.orderBy(F.desc("indexed_at"), "path")
    return rows if limit is None else rows.limit(limit)


def clear(spark: SparkSession, path: str) -> None:
    """Delete a stored table or a folder of them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
