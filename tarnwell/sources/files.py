"""JSON lines with error rows, snapshots, run tracking and document replacement on files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON-lines file; a line that doesn't parse has its text in ``_corrupt_record`` and nulls elsewhere."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def pages_of(texts: DataFrame) -> DataFrame:
    """doc_id, page, text of ``texts(doc_id, text)`` whose pages are parted by form feeds, numbered from 1."""
    return texts.select("doc_id", F.posexplode(F.split("text", "\f")).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("page"), "text")


def index_batch(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vectors by position; unequal numbers raise. A missing chunk_id becomes ``chunk-N``."""
    n, m = chunks.count(), vectors.count()
    if n != m:
        raise ValueError(f"{n} chunks but {m} vectors")
    return chunks.join(vectors, "position").withColumn("chunk_id", F.coalesce("chunk_id", F.concat(F.lit("chunk-"), F.col("position").cast("string"))))


def record_run(runs: DataFrame, metrics: DataFrame, slices: DataFrame, folder: str) -> None:
    """Append one run and its metric and slice rows; the run row is written last and makes the rest count."""
    metrics.write.mode("append").parquet(f"{folder}/eval_run_metrics")
    slices.write.mode("append").parquet(f"{folder}/eval_run_slices")
    runs.write.mode("append").parquet(f"{folder}/eval_runs")


def recorded(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Rows of ``eval_run_metrics`` or ``eval_run_slices`` that belong to a recorded run."""
    return spark.read.parquet(f"{folder}/{kind}").join(spark.read.parquet(f"{folder}/eval_runs").select("run_id"), "run_id", "left_semi")


def json_cases(spark: SparkSession, path: str, schema: T.StructType, default: list | None = None) -> DataFrame:
    """Rows of a file that is one JSON array or JSON lines; without a path the ``default`` rows."""
    if path is None:
        return spark.createDataFrame(default or [], schema)
    lines = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("t"))
    array = F.from_json(F.when(F.startswith("t", F.lit("[")), F.col("t")), T.ArrayType(schema))
    single = F.transform(F.filter(F.split("t", r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, schema))
    return lines.select(F.inline(F.coalesce(array, single)))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """label, query, embedding of a file ``{label: [{query, embedding}]}``; entries without an embedding are left out."""
    kind = "map<string, array<struct<query: string, embedding: array<double>>>>"
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    return m.select(F.explode("m").alias("label", "s")).select("label", F.inline("s")).where(F.size("embedding") > 0)


def chunk_fixture(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Chunks of a JSON-lines file; a section that is missing falls back to that of the metadata, the last line of an id counts."""
    rows = json_lines(spark, path, schema).where("_corrupt_record is null").drop("_corrupt_record")
    meta = schema["metadata"].dataType if "metadata" in schema.fieldNames() else None
    if meta is not None and "section" in meta.fieldNames():
        rows = rows.withColumn("section", F.coalesce("section", "metadata.section"))
    if "page" in schema.fieldNames():
        rows = rows.withColumn("page", F.col("page").cast("int"))
    from tarnwell.operators.search import topk

    return topk(rows.withColumn("_line", F.monotonically_increasing_id()), "chunk_id", 1, F.desc("_line")).drop("_line", "rank")


def save_snapshot(report: DataFrame, folder: str, name: str, mode: str | None = None) -> None:
    report.write.mode("overwrite").json(f"{folder}/{mode}/{name}" if mode else f"{folder}/{name}")


def load_snapshot(spark: SparkSession, folder: str, name: str, mode: str | None = None) -> DataFrame | None:
    """A snapshot from the folder of its mode, else from the flat one; None if there is none."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in ([f"{folder}/{mode}/{name}"] if mode else []) + [f"{folder}/{name}"]:
        p = fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return spark.read.json(path)
    return None


def file_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, digest: SHA-256 of the bytes of each file, ``missing`` for one that isn't there."""
    wanted = spark.createDataFrame([(p,) for p in paths], "path string")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if (q := fs.Path(p)).getFileSystem(conf).exists(q)]
    if not there:
        return wanted.withColumn("digest", F.lit("missing"))
    read = spark.read.format("binaryFile").load(there).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.sha2("content", 256).alias("digest"))
    return wanted.join(read, "path", "left").withColumn("digest", F.coalesce("digest", F.lit("missing")))


def api_texts(replies: DataFrame, n: int, chars: int = 2_000) -> DataFrame:
    """id, place, text: the first n parts between blank lines of ``replies(id, text)``, each cut to ``chars`` characters."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")
    return replies.where("text is not null").select("id", F.posexplode(F.slice(parts, 1, n)).alias("pos", "part")).select("id", (F.col("pos") + 1).alias("place"), F.substring("part", 1, chars).alias("text"))


def authoring_index(windows: DataFrame, aligned: DataFrame, path: str) -> None:
    """Write one JSON line for each window with the start of its body and its chunks by rank."""
    a = aligned.groupBy("doc_id", "window").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    rows = windows.join(a, ["doc_id", "window"], "left").select("doc_id", "title", "page_start", "page_end", *(["headings"] if "headings" in windows.columns else []), F.substring("body", 1, 400).alias("body_preview"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))
    rows.write.mode("overwrite").json(path)
