"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.python_text import decode_file, encode_file

#: File names that mark a project's main file, best first; fixed values.
MAIN_NAMES = ["main.tex", "book.tex", "thesis.tex"]

GOLD_SCHEMA = "name STRING, sample STRING, pack STRING, mode STRING, compile BOOLEAN, labels ARRAY<STRUCT<needle: STRING, kind: STRING, env: STRING, line: INT>>"
PRICE_SCHEMA = "model STRING, max_input_tokens BIGINT, input_per_million DOUBLE, output_per_million DOUBLE, cached_per_million DOUBLE"


def read_text_files(spark: SparkSession, path: str, pattern: str = "*.tex") -> DataFrame:
    """path, content, text, encoding, bom, newline of every file, decoded by mark, declared encoding, UTF-8, GBK and Latin-1 in this order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content", decode_file("content").alias("d")).select("path", "content", "d.*")


def encoded(files: DataFrame) -> DataFrame:
    """path and content of texts as their files (``content``) had them: unchanged texts give the same bytes."""
    return files.select("path", encode_file("text", "content").alias("content"))


def main_file(files: DataFrame) -> DataFrame:
    """The main file: a known name, else the first that declares a document class, else the first; by depth and path."""
    name = F.substring_index("path", "/", -1)
    rank = F.coalesce(*[F.when(name == n, k) for k, n in enumerate(MAIN_NAMES)], F.when(F.col("text").contains(r"\documentclass"), len(MAIN_NAMES)), F.lit(len(MAIN_NAMES) + 1))
    first = F.struct(rank.alias("rank"), F.size(F.split("path", "/")).alias("depth"), F.col("path"))
    return files.agg(F.min_by("path", first).alias("path"))


def read_gold(spark: SparkSession, path: str, samples: DataFrame | None = None) -> DataFrame:
    """One row for each label of the gold files. With ``samples`` (sample, text) also the text's line that holds the label: the given line, which
    must contain the needle, or the first that does; null where none does."""
    rows = spark.read.schema(GOLD_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = rows.select("name", "sample", F.posexplode_outer("labels").alias("n", "label")).select("name", "sample", "n", "label.*")
    if samples is None:
        return rows
    lines = samples.select("sample", F.posexplode(F.split("text", "\n")).alias("at", "own")).select("sample", (F.col("at") + 1).alias("at"), "own")
    fits = F.col("own").contains(F.col("needle")) & (F.col("line").isNull() | (F.col("line") == F.col("at")))
    found = rows.join(lines, "sample").filter(fits).groupBy("name", "n").agg(F.min("at").alias("found_line"))
    return rows.join(found, ["name", "n"], "left")


#: Columns of an issue table, in order.
ISSUE_COLUMNS = ["id", "severity", "category", "file", "line", "title", "detail", "suggestion"]


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Issue rows as CSV with a header and LF newlines, columns in a fixed order; missing ones are empty."""
    columns = ISSUE_COLUMNS if columns is None else columns
    have = [F.col(c) if c in rows.columns else F.lit("") for c in columns]
    rows.select(*[c.cast("string").alias(n) for c, n in zip(have, columns)]).write.option("header", True).option("lineSep", "\n").option("emptyValue", "").csv(path)


def canonical_json(rows: DataFrame) -> DataFrame:
    """Each row as JSON with sorted keys."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def store_blobs(rows: DataFrame, content: str, path: str) -> DataFrame:
    """Write each distinct content that the store doesn't have, under its SHA-256, and return the rows with that key instead. A repeated
    call writes nothing."""
    spark = rows.sparkSession
    keyed = rows.withColumn("sha256", F.sha2(F.col(content), 256))
    new = keyed.select("sha256", F.col(content).alias("content")).dropDuplicates(["sha256"])
    if _there(spark, path):
        new = new.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    new.write.mode("append").parquet(path)
    return keyed.drop(content)


def quarantine(rows: DataFrame, ok: str, path: str) -> DataFrame:
    """Write rows that failed, with a digest of their draft, and return the others. A draft that is there already isn't written again."""
    spark = rows.sparkSession
    failed = rows.filter(f"NOT coalesce({ok}, false)").withColumn("draft_sha256", F.sha2("text", 256)).dropDuplicates(["draft_sha256"])
    if _there(spark, path):
        failed = failed.join(spark.read.parquet(path).select("draft_sha256"), "draft_sha256", "left_anti")
    failed.write.mode("append").parquet(path)
    return rows.filter(ok)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Failed rows whose draft still has its digest."""
    return spark.read.parquet(path).filter(F.sha2("text", 256) == F.col("draft_sha256"))


def read_zip(spark: SparkSession, path: str, most_ratio: float = 100.0, most_bytes: int = 1 << 30, most_files: int = 10_000) -> DataFrame:
    """archive, path and content of the members of every zip file under ``path``. An archive that would unpack to more bytes or files, or
    more than ``most_ratio`` times its size, that names an unsafe path, or a path twice, is an error and gives nothing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)

    def run(batches):
        import io
        import posixpath
        import zipfile

        import pandas as pd

        for rows in batches:
            for archive, content in zip(rows["path"], rows["content"]):
                out = []
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    members = [m for m in z.infolist() if not m.is_dir()]
                    if len(members) > most_files or sum(m.file_size for m in members) > min(most_bytes, most_ratio * max(1, len(content))):
                        raise ValueError(f"{archive} unpacks to too much")
                    seen = set()
                    for m in members:
                        name = posixpath.normpath(m.filename.replace("\\", "/"))
                        if name.startswith(("/", "..")) or ":" in name or "\0" in name or name.casefold() in seen:
                            raise ValueError(f"{archive} holds an unsafe path")
                        seen.add(name.casefold())
                        out.append((archive, name, z.read(m)))
                yield pd.DataFrame(out, columns=["archive", "path", "content"])

    return files.select("path", "content").mapInPandas(run, "archive string, path string, content binary")


def pack_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of the rule packs under ``path``: stems of the JSON files, sorted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("name")).orderBy("name")


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose content is new or differs."""
    key = lambda d: d.select("path", F.sha2("text", 256).alias("sha"))
    return after.join(key(before).join(key(after), ["path", "sha"]).select("path"), "path", "left_anti")


def newest_first(meta: DataFrame) -> DataFrame:
    return meta.orderBy(F.desc("created"), F.desc("id"))


#: Parts of a result that are committed together.
RESULT_PARTS = ["result", "report", "decisions", "verification"]


def commit_results(parts: dict[str, DataFrame], path: str) -> str:
    """Write all parts of a result as a new version, then the marker that makes it the current one. Whatever fails before the marker leaves the
    version before in place. Returns the version."""
    import time
    import uuid

    if sorted(parts) != sorted(RESULT_PARTS):
        raise ValueError(f"a result has the parts {RESULT_PARTS}")
    spark, version = next(iter(parts.values())).sparkSession, f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    for name in RESULT_PARTS:
        parts[name].write.parquet(f"{path}/versions/{version}/{name}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{path}/current")
    return version


def read_results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of the last version that was committed."""
    version = spark.read.parquet(f"{path}/current").agg(F.max("version").alias("v")).first()["v"]
    return {name: spark.read.parquet(f"{path}/versions/{version}/{name}") for name in RESULT_PARTS}


MANIFEST_SCHEMA = "id STRING, source_sha256 STRING, threshold DOUBLE, page_offset INT, chapters ARRAY<STRUCT<number: INT, title: STRING, start_page: INT>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation manifests with ``errors``: a digest of 64 hex digits, a threshold from 0 to 1, chapters numbered 1..N with growing pages. A file that
    doesn't parse fails the job."""
    rows = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    digest, c = F.lower(F.trim("source_sha256")), F.col("chapters")
    fits = lambda cond: F.coalesce(cond, F.lit(False))
    numbers = F.transform(c, lambda x: x["number"]) == F.when(F.size(c) > 0, F.sequence(F.lit(1), F.size(c)))
    pages = F.transform(c, lambda x: x["start_page"])
    grows = F.forall(F.sequence(F.lit(1), F.size(c)), lambda i: (i == F.size(c)) | (F.get(pages, i - 1) < F.get(pages, i)))
    checks = {"id": F.trim("id") != "", "source_sha256": digest.rlike("^[0-9a-f]{64}$"), "threshold": F.col("threshold").between(0.0, 1.0) & ~F.isnan("threshold"), "chapters": numbers & F.when(F.size(c) > 0, grows)}
    errors = F.array_compact(F.array(*[F.when(~fits(ok), F.lit(name)) for name, ok in checks.items()]))
    return rows.withColumns({"source_sha256": digest, "errors": errors})


def read_folder(spark: SparkSession, path: str, most_files: int = 10_000, most_bytes: int = 1 << 30) -> DataFrame:
    """path (relative to the folder) and content of every file. Paths that aren't safe, differ in case alone, or together hold too much, are an error."""
    from ..functions.text import safe_path

    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select(F.regexp_replace("path", rf"^.*?{root}/", "").alias("path"), "content", "length")
    seen = rows.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.count_distinct(F.lower("path")).alias("u"), F.bool_and(safe_path(F.col("path"))).alias("safe")).first()
    if seen["n"] and (seen["n"] > most_files or seen["bytes"] > most_bytes or seen["u"] < seen["n"] or not seen["safe"]):
        raise ValueError(f"the folder holds too much, or unsafe paths: {seen.asDict()}")
    return rows.drop("length")
