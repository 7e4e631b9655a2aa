"""Readers of the file formats: JSON lines logs, golden sets, reports, statute text and snapshots of folders."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.monitor import LOCAL, parsed_time
from ..schemas import AUDIT_EVENT, GOLDEN, PROBE
from ..streaming.fold import in_order


def typed(v: Column, kind: T.DataType) -> Column:
    """A VARIANT as a value of its own type, and null where it has another one.

    Integers are JSON integers, and true and false count as 1 and 0; 12.0 is none. Any number is a double. A text is a JSON
    string, or else the JSON of what stands there.
    """
    shape = F.schema_of_variant(v)
    take = lambda as_type: F.try_variant_get(v, "$", as_type)
    if isinstance(kind, T.StringType):
        return F.when(shape == "STRING", take("string")).when(shape != "VOID", F.to_json(v))
    if isinstance(kind, T.LongType):
        return F.when(shape.isin("BIGINT", "BOOLEAN"), take("bigint"))
    if isinstance(kind, T.DoubleType):
        return F.when(shape.isin("BIGINT", "DOUBLE") | shape.startswith("DECIMAL"), take("double"))
    if isinstance(kind, T.BooleanType):
        return F.when(shape == "BOOLEAN", take("boolean"))
    if isinstance(kind, T.ArrayType):
        return F.when(shape.startswith("ARRAY"), F.transform(take("array<variant>"), lambda x: typed(x, kind.elementType)))
    if isinstance(kind, T.MapType):
        return F.when(shape.startswith("OBJECT"), F.transform_values(take("map<string,variant>"), lambda _, x: typed(x, kind.valueType)))
    if isinstance(kind, T.StructType):
        inner = [typed(F.try_variant_get(v, f"$.{f.name}", "variant"), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(shape.startswith("OBJECT"), F.struct(*inner))
    raise TypeError(f"no JSON type for {kind}")


def parsed_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """lines (value, and what else) as events: a row for each line that is one JSON object, with the fields of the schema in place
    of value. A field of another type is null, and nothing else of its line; absent fields are null; of equal keys the last
    counts. Blank lines, other JSON values and malformed lines are left out, and so is an object that repeats a key within a
    value of its own.
    """
    loose = T.StructType([T.StructField(f.name, T.VariantType()) for f in schema.fields]).add("_bad", "string")
    parsed = F.from_json("value", loose, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"})
    # from_json reads the first value of a line only; numbers that are none are no JSON, but are written by many loggers
    alone = (F.json_array_length(F.concat(F.lit("["), "value", F.lit("]"))) == 1) | F.col("value").rlike("NaN|Infinity")
    rows = lines.where(F.col("value").rlike(r"^\s*\{")).withColumn("_line", parsed).where(alone & F.col("_line").isNotNull() & F.col("_line._bad").isNull())
    return rows.select(*[typed(F.col("_line")[f.name], f.dataType).alias(f.name) for f in schema.fields], *[c for c in lines.columns if c != "value"])


def read_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType, glob: str | None = None) -> DataFrame:
    """parsed_lines of files, with log_file."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return parsed_lines(reader.text(path).select("value", F.col("_metadata.file_name").alias("log_file")), schema)


def read_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The audit log: audit_*.jsonl, a file for each day."""
    return read_json_lines(spark, folder, AUDIT_EVENT, "audit_*.jsonl").withColumn("log_date", log_date("log_file"))


def log_date(column: str):
    return F.try_to_date(F.regexp_extract(column, r"audit_(\d{4}-\d{2}-\d{2})\.jsonl", 1), "yyyy-MM-dd")


def read_audit_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(log_file, line_no, value): each line with its number in its file, from 1, blank ones counted.

    A file is read in splits by several tasks: lines are numbered within their split first, and then by the number of
    lines in the splits before it.
    """
    lines = spark.read.option("pathGlobFilter", "audit_*.jsonl").text(folder).select(
        F.col("_metadata.file_name").alias("log_file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value"
    )
    splits = lines.groupBy("log_file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("log_file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.withColumn("before", before).drop("n")
    return lines.join(splits, ["log_file", "split"]).select("log_file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "value")


def within_days(audit: DataFrame, now: str, days: int) -> DataFrame:
    """Files whose day started at most `days` days before now; 0 or less keeps all. Prunes by log_date."""
    if days <= 0:
        return audit
    return audit.where(F.col("log_date").cast("timestamp") >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))


def read_probes(spark: SparkSession, paths: list[str]) -> DataFrame:
    probes = read_json_lines(spark, paths, PROBE)
    return probes.withColumn("at", F.try_to_timestamp("timestamp")).where("at is not null")


def recent_events(audit: DataFrame, now: str, minutes: int) -> DataFrame:
    """Events of the last minutes: only the files of today and yesterday are read, in local time."""
    at = parsed_time(F.lit(now))
    today = F.to_date(F.from_utc_timestamp(at, LOCAL))
    rows = audit.where(F.col("log_date").between(F.date_sub(today, 1), today))
    return rows.where(parsed_time(F.col("timestamp")) >= at - F.make_interval(mins=F.lit(minutes)))


def recent_probes(spark: SparkSession, folder: str, stem: str, now: str, hours: int = 24) -> DataFrame:
    """The probes of the last hours, from stem.jsonl and the archives stem_*.jsonl beside it."""
    probes = read_json_lines(spark, folder, PROBE, f"{stem}{{,_*}}.jsonl").withColumn("at", parsed_time(F.col("timestamp")))
    return probes.where(F.col("at") >= parsed_time(F.lit(now)) - F.make_interval(hours=F.lit(hours)))


def first_with(spark: SparkSession, folders: list[str], glob: str) -> str | None:
    """The first of some folders that has a file of the pattern: settings come before own files, own before older ones."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{glob}")
        if path.getFileSystem(conf).globStatus(path):
            return folder
    return None


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """The golden set; older files call the query a question."""
    rows = spark.read.option("multiLine", True).schema(GOLDEN).json(path)
    return rows.withColumn("query", F.coalesce("query", "question")).where(F.trim(F.coalesce("query", F.lit(""))) != "")


def latest_report(spark: SparkSession, folder: str, glob: str, gate: str | None = None) -> DataFrame:
    """The report with the last file name; `gate` names a field that a valid report must have."""
    rows = spark.read.option("multiLine", True).option("pathGlobFilter", glob).json(folder).withColumn("file", F.col("_metadata.file_name"))
    if gate:
        rows = rows.where(F.col(gate).isNotNull()) if gate in rows.columns else rows.limit(0)
    last = rows.agg(F.max("file").alias("file"))
    return rows.join(F.broadcast(last), "file", "left_semi")


ARTICLE = r"^\s*(第\s*[0-9一二三四五六七八九十百零兩]+\s*條)\s*$"


def statute_articles(texts: DataFrame, law: str = "law", text: str = "text") -> DataFrame:
    """(law, article, content) of statute texts: the lines after each header line; the last of equal headers wins."""
    lines = texts.select(F.col(law).alias("law"), F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))
    head = F.regexp_replace(F.regexp_extract("line", ARTICLE, 1), r"\s", "")
    along = Window.partitionBy("law").orderBy("n")
    lines = lines.withColumn("at", F.when(head != "", F.col("n"))).withColumn("head", F.when(head != "", head))
    lines = lines.withColumn("section", F.last("at", True).over(along)).withColumn("article", F.last("head", True).over(along))
    body = lines.where("head is null and section is not null").groupBy("law", "article", "section").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("content")
    )
    return body.groupBy("law", "article").agg(F.regexp_replace(F.max_by("content", "section"), r"^\s+|\s+$", "").alias("content"))


# What a project's snapshot holds, by the end or the whole of a name, and folders that it leaves out.
TRACKED = (".py", ".md", ".json", ".yaml", ".yml", ".txt", ".sh", ".toml", ".cfg", ".ini", ".env.example", ".html", ".css", ".js")
TRACKED_NAMES = ("Dockerfile", "Dockerfile.api", ".gitignore", ".env.example")
SKIPPED = ("__pycache__", ".git", ".ipynb_checkpoints", "node_modules", ".pytest_cache", "venv", ".venv", ".mypy_cache")
SKIPPED_DATA = ("audit_logs", "reports", "versions", "output", "processed")


def folder_snapshot(
    spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".txt", ".md", ".py", ".json"), names: tuple[str, ...] = (),
    skipped: tuple[str, ...] = (), skipped_data: tuple[str, ...] = (),
) -> DataFrame:
    """(path, sha256, size, modified) of the files of a folder and those below it that end in a suffix or have a name.

    Files below a skipped folder, or below one that is skipped in `data`, are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    inside = F.substring_index("path", folder.rstrip("/").rpartition("/")[2] + "/", -1)
    parts = F.split(inside, "/")
    wanted = F.greatest(F.lit(False), *[F.col("path").endswith(s) for s in suffixes], F.element_at(parts, -1).isin(*names) if names else F.lit(False))
    left = ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in skipped])) if skipped else F.lit(True)
    if skipped_data:
        left = left & ~((F.get(parts, F.lit(0)) == "data") & F.coalesce(F.get(parts, F.lit(1)).isin(*skipped_data), F.lit(False)))
    return files.where(wanted & left).select(
        "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    )


def project_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return folder_snapshot(spark, folder, TRACKED, TRACKED_NAMES, SKIPPED, SKIPPED_DATA)


def read_directory(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".txt", ".md", ".py", ".json")) -> DataFrame:
    """(source, text, indexed) of the text files of a folder: indexed is false where a file is not UTF-8."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    match = "|".join(s.replace(".", r"\.") for s in suffixes)
    rows = files.where(F.lower("path").rlike(f"({match})$")).select(name.alias("source"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return rows.withColumn("indexed", F.col("text").isNotNull())


def directory_digest(files: DataFrame) -> DataFrame:
    """(folder, files, bytes, digest) of files (folder, path, content): SHA-256 over each path, a zero byte and the bytes, by path.

    The files of a folder are read in order by one task, which holds one of them and the state of the hash.
    """

    def step(state, row):
        n, size, digest = state or (0, 0, hashlib.sha256())
        digest.update(row.path.encode() + b"\0" + bytes(row.content))
        state = (n + 1, size + len(row.content), digest)
        return state, [(row.folder, row.path, *state[:2], digest.hexdigest())]

    rows = in_order(files.select("folder", "path", "content"), "folder", "path", step, "folder string, path string, files long, bytes long, digest string")
    last = rows.groupBy("folder").agg(F.max_by(F.struct("files", "bytes", "digest"), "files").alias("x"))
    return last.select("folder", "x.*")


def newest_documents(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", "modified").orderBy(F.desc("modified"), "name")


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """(file, kind, generated_at, hit_rate, n) of the JSON reports of a folder, the newest first; unreadable ones are left out."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), "value")
    field = lambda name: F.get_json_object("value", f"$.{name}")
    kind = F.when(F.col("file").startswith("vv_report"), "vv").when(F.col("file").contains("ragas"), "ragas").otherwise("other")
    n = F.nullif(F.json_array_length(field("per_query")), F.lit(0))
    rows = files.where(F.try_parse_json("value").isNotNull()).select(
        "file", kind.alias("kind"), F.coalesce(field("generated_at"), F.lit("")).alias("generated_at"), field("hit_rate").try_cast("double").alias("hit_rate"), n.alias("n")
    )
    return rows.orderBy(F.desc("generated_at"), "file")
