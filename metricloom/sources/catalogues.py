"""Catalogue documents: reading, discovery, writing, reports."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.json_text import ENCODED_FIELDS, field_kind
from metricloom.functions.text import db_stem, strip_semicolons
from metricloom.operators.skew import keep_first
from metricloom.schemas import CATALOGUE
from metricloom.session import pin

# Fixed value: how the name of a catalogue's file gives its run.
INDEX_IN_NAME = r"_catalogue(?:_(\d+))?\.json$"


def find_catalogues(spark: SparkSession, sources: list[str]) -> list[str]:
    """Catalogue files named by ``sources``: explicit ``.json`` files, and in a folder
    every ``*_catalogue*.json`` directly inside or one level deeper."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found: list[str] = []
    for source in sources:
        path = jvm.org.apache.hadoop.fs.Path(source)
        system = path.getFileSystem(conf)
        if system.exists(path) and system.getFileStatus(path).isDirectory():
            for depth in ("", "*/"):
                glob = jvm.org.apache.hadoop.fs.Path(f"{source.rstrip('/')}/{depth}*_catalogue*.json")
                found += sorted(s.getPath().toString() for s in system.globStatus(glob) or [])
        elif source.endswith(".json"):
            found.append(source)
    return found


def read_documents(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Catalogue documents with their identity, and those that could not be read.

    Fields that hold their JSON encoded once more as a text are decoded. A document that is
    cut off or no object, whose lists hold something else, or without a connection comes
    back in the second frame as (path, reason, content) and not in the first. Each file is
    one document, opened once and parsed once as a variant for its shape and once for its
    fields. Folders are listed by as many tasks as run at once, not one for each of them.
    """
    if not paths:
        none = spark.createDataFrame([], T.StructType(CATALOGUE.fields).add("path", T.StringType()))
        return _identified(none), spark.createDataFrame([], "path string, reason string, content string")
    # Read as texts, a plain list keeps its JSON and an encoded one loses its quotes.
    loose = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name in ENCODED_FIELDS else f.dataType) for f in CATALOGUE.fields]
    )
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(listing)
    spark.conf.set(listing, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        read = spark.read.text(paths, wholetext=True).select(
            F.col("value").alias("content"), F.col("_metadata.file_path").alias("path")
        )
    finally:
        spark.conf.set(listing, before)
    parsed = read.withColumn("doc", F.try_parse_json("content")).withColumn(
        "kind", F.coalesce(F.schema_of_variant("doc"), F.lit(""))
    )
    odd = [
        F.when(~field_kind(F.col("doc"), f).isin(kind, "absent", "null"), f)
        for f, kind in ENCODED_FIELDS.items()
    ]
    typed = parsed.withColumn("fields", F.from_json("content", loose)).select(
        "path", "content", "kind", F.array_join(F.array_compact(F.array(*odd)), ",").alias("odd"), "fields"
    )
    reason = (
        F.when(F.col("kind") == "", "no JSON")
        .when(~F.col("kind").startswith("OBJECT"), "no object")
        .when(F.col("odd") != "", F.concat(F.lit("other content: "), "odd"))
        .when(F.coalesce("fields.connection", F.lit("")) == "", "no connection")
    )
    judged = pin(typed.withColumn("reason", reason))
    whole = judged.where("reason IS NULL").select(
        *[
            F.from_json(f"fields.{f.name}", f.dataType).alias(f.name)
            if f.name in ENCODED_FIELDS
            else F.col(f"fields.{f.name}").alias(f.name)
            for f in CATALOGUE.fields
        ],
        "path",
    )
    return _identified(whole), judged.where("reason IS NOT NULL").select("path", "reason", "content")


def _identified(docs: DataFrame) -> DataFrame:
    index = F.regexp_extract("path", INDEX_IN_NAME, 1)
    return (
        docs.withColumn("catalogue_id", F.col("path"))
        .withColumn("label", F.get(F.split("path", "/"), F.size(F.split("path", "/")) - 2))
        .withColumn("run_index", F.when(index == "", 1).otherwise(index.try_cast("int")))
        .withColumn("db_stem", db_stem(F.col("connection")))
    )


def read_catalogues(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One nested row per document, with its identity; see :func:`read_documents` for those
    that cannot be read."""
    return read_documents(spark, paths)[0]


def catalogue_index(catalogues: DataFrame) -> DataFrame:
    """Identity rows: which catalogue belongs to which database."""
    return catalogues.select("catalogue_id", "label", "run_index", "path", "db_stem")


def _items(catalogues: DataFrame, field: str) -> DataFrame:
    rows = catalogues.select("catalogue_id", F.posexplode(F.col(field)).alias("pos", "item"))
    rows = rows.select("catalogue_id", F.col("pos").cast("bigint").alias("pos"), "item.*")
    if "sql" in rows.columns:
        rows = rows.withColumn("sql", strip_semicolons(F.coalesce("sql", F.lit(""))))
    return rows


def metric_rows(catalogues: DataFrame) -> DataFrame:
    return _items(catalogues, "measurable_metrics")


def fact_rows(catalogues: DataFrame) -> DataFrame:
    return _items(catalogues, "queryable_facts")


def table_rows(catalogues: DataFrame) -> DataFrame:
    return _items(catalogues, "tables")


def by_name(entries: DataFrame) -> DataFrame:
    """Entries keyed by name: the last of a repeated name wins."""
    return keep_first(entries, ["catalogue_id", "name"], [F.desc("pos")])


def write_catalogues(catalogues: DataFrame, folder: str, run_id: str) -> None:
    """Append catalogues as JSON under a partition of their own, so runs never collide."""
    (
        catalogues.withColumn("run_id", F.lit(run_id))
        .withColumn("model_dir", F.col("model"))
        .withColumn("stem_dir", db_stem(F.col("connection")))
        .write.mode("append")
        .partitionBy("model_dir", "stem_dir", "run_id")
        .json(folder)
    )


def read_written(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogues written by :func:`write_catalogues`. A run's catalogue is one of its own,
    also where another run analysed the same database at the same time."""
    docs = spark.read.schema(CATALOGUE).option("recursiveFileLookup", True).json(folder)
    parent = F.regexp_replace("_metadata.file_path", "/[^/]*$", "")
    return docs.withColumn(
        "catalogue_id", F.sha2(F.to_json(F.struct(parent.alias("run"), "model", "connection", "analysed_at")), 256)
    )


def write_files(catalogues: DataFrame, folder: str) -> None:
    """Catalogues as files ``<model>/<database>_catalogue_<run_index>.json``, which
    :func:`find_catalogues` finds. Their texts are written by the executors; the driver only
    gives the files their names.
    """
    spark = catalogues.sparkSession
    name = F.concat(
        db_stem(F.col("connection")), F.lit("_catalogue_"), F.coalesce("run_index", F.lit(1)).cast("string"), F.lit(".json")
    )
    staged = f"{folder.rstrip('/')}/_staged"
    keys = ["model_dir", "file_dir"]
    text = F.to_json(F.struct(*[F.col(f.name) for f in CATALOGUE.fields if f.name in catalogues.columns]))
    (
        catalogues.select(F.col("model").alias("model_dir"), name.alias("file_dir"), text.alias("value"))
        .repartition(*keys)
        .write.partitionBy(*keys)
        .option("lineSep", "\n")
        .text(staged)
    )
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    system = path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in system.globStatus(path(f"{staged}/*/*/part-*")) or []:
        part = status.getPath()
        model, file = (unquote(p.getName().split("=", 1)[1]) for p in (part.getParent().getParent(), part.getParent()))
        system.mkdirs(path(path(folder), model))
        if not system.rename(part, path(path(path(folder), model), file)):
            raise OSError(f"{file} of {model} could not be put in its place")
    system.delete(path(staged), True)


def evaluation_report(metric_results: DataFrame, fact_results: DataFrame, uncovered: DataFrame) -> DataFrame:
    """Evaluation report per catalogue: summary counts as columns."""

    def counts(results: DataFrame, kind: str) -> DataFrame:
        return results.groupBy("catalogue_id").agg(
            F.count(F.lit(1)).alias(f"{kind}_total"),
            *[
                F.count_if(F.col("status") == s).alias(f"{kind}_{s.lower()}")
                for s in ("PASS", "WARN", "FAIL")
            ],
        )

    missing = uncovered.groupBy("catalogue_id").agg(
        F.array_join(F.array_sort(F.collect_set("table_name")), ",").alias("uncovered_tables")
    )
    joined = (
        counts(metric_results, "metrics")
        .join(counts(fact_results, "facts"), "catalogue_id", "full")
        .join(missing, "catalogue_id", "left")
    )
    numbers = [c for c in joined.columns if c.startswith(("metrics_", "facts_"))]
    return joined.fillna(0, numbers).fillna("", ["uncovered_tables"])


def report_items(metric_results: DataFrame) -> DataFrame:
    """Metric rows of the report as JSON text, null rate rounded to four places."""
    fields = [
        "name", "status", "confidence", "granularity", "unit", "n_rows", "null_rate", "value_min",
        "value_max", "declared_start", "declared_end", "actual_start", "actual_end",
        "date_range_ok", "date_col_ok", "duplicate_of", "error",
    ]
    rounded = metric_results.withColumn("null_rate", F.round("null_rate", 4))
    return rounded.select(
        "catalogue_id",
        "pos",
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("item"),
    )


def write_scores(scores: DataFrame, folder: str) -> None:
    """Comparison report as JSON, one partition per database. Only the databases at hand are
    replaced, reports of others stay."""
    (
        scores.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("db_stem")
        .json(folder)
    )


def read_scores(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Reports of all databases that :func:`write_scores` has left in ``folder``."""
    return spark.read.schema(schema).json(folder)
