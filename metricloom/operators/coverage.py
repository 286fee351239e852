"""Coverage of tables and foreign keys by a catalogue's entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.text import pair_key, tables_referenced

# Fixed value: rejections after which a foreign key pair is waived.
REJECTION_CAP = 2


def ghost_tables(entries: DataFrame) -> DataFrame:
    """Declared tables that the statement never reads, per entry."""
    declared = F.transform(F.coalesce("tables_used", F.array().cast("array<string>")), F.lower)
    ghosts = F.array_sort(F.array_except(declared, tables_referenced(F.coalesce("sql", F.lit("")))))
    return entries.withColumn("ghosts", ghosts).where("size(ghosts) > 0")


def table_mentions(metrics: DataFrame, facts: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Distinct tables each catalogue mentions, case kept."""

    def used(entries: DataFrame) -> DataFrame:
        return entries.select("catalogue_id", F.explode("tables_used").alias("table_name"))

    mentions = used(metrics).unionByName(used(facts))
    if tables is not None:
        mentions = mentions.unionByName(
            tables.select("catalogue_id", F.col("name").alias("table_name"))
        )
    return mentions.distinct()


def uncovered_tables(catalogues: DataFrame, db_tables: DataFrame, mentions: DataFrame) -> DataFrame:
    """Database tables a catalogue never mentions. ``db_tables`` lists one database's
    tables, so pairing it with the catalogues stays as small as its table list."""
    wanted = catalogues.select("catalogue_id").distinct().withColumn(
        "table_name", F.explode(_as_array(db_tables, "table_name"))
    )
    return wanted.join(mentions, ["catalogue_id", "table_name"], "left_anti")


def _as_array(df: DataFrame, column: str) -> Column:
    """Values of a schema-sized table as one array literal."""
    values = sorted(r[0] for r in df.select(column).distinct().collect())
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def covered_count(db_tables: DataFrame, mentions: DataFrame) -> DataFrame:
    """Number of database tables each catalogue mentions."""
    hits = mentions.join(F.broadcast(db_tables.select("table_name").distinct()), "table_name", "left_semi")
    return hits.groupBy("catalogue_id").agg(F.count(F.lit(1)).alias("n_covered_tables"))


def required_uncovered(
    catalogues: DataFrame, required: DataFrame, metrics: DataFrame
) -> DataFrame:
    """Required temporal tables missing from every metric, compared in lower case."""
    names = required.select(F.lower("table_name").alias("table_name"))
    wanted = catalogues.select("catalogue_id").distinct().withColumn(
        "table_name", F.explode(_as_array(names, "table_name"))
    )
    used = metrics.select(
        "catalogue_id", F.explode(F.transform("tables_used", F.lower)).alias("table_name")
    ).distinct()
    return wanted.join(used, ["catalogue_id", "table_name"], "left_anti")


def foreign_key_pairs(
    foreign_keys: DataFrame, exempt: DataFrame | None = None, waived: DataFrame | None = None
) -> DataFrame:
    """Table pairs to cover, without exempt lookup tables and waived pairs."""
    pairs = foreign_keys.select(
        F.lower("from_table").alias("from_table"), F.lower("to_table").alias("to_table")
    ).distinct()
    if exempt is not None:
        names = exempt.select(F.lower("table_name").alias("t"))
        for side in ("from_table", "to_table"):
            pairs = pairs.join(names, F.col(side) == F.col("t"), "left_anti")
    pairs = pairs.withColumn("pair", pair_key(F.col("from_table"), F.col("to_table")))
    if waived is not None:
        pairs = pairs.join(waived.select("pair"), "pair", "left_anti")
    return pairs


def uncovered_pairs(
    catalogues: DataFrame, metrics: DataFrame, pairs: DataFrame, tables: str | None = None
) -> DataFrame:
    """Pairs without a metric whose statement reads both tables; facts do not count.

    Statements are first reduced to their distinct table sets per catalogue, then met
    with the pairs by table name. ``tables`` names a column with the set of each metric,
    where that is known already.
    """
    known = F.col(tables) if tables else tables_referenced(F.coalesce("sql", F.lit("")))
    sets = metrics.select("catalogue_id", known.alias("tables")).distinct()
    read = sets.select("catalogue_id", "tables", F.explode("tables").alias("from_table"))
    covered = (
        read.join(F.broadcast(pairs), "from_table")
        .where(F.array_contains("tables", F.col("to_table")))
        .select("catalogue_id", "pair")
        .distinct()
    )
    listed = pairs.collect()  # one row per declared foreign key
    choices = F.array(
        *[
            F.struct(
                F.lit(r["from_table"]).alias("from_table"),
                F.lit(r["to_table"]).alias("to_table"),
                F.array(*[F.lit(t) for t in r["pair"]]).alias("pair"),
            )
            for r in listed
        ]
    ).cast("array<struct<from_table:string,to_table:string,pair:array<string>>>")
    wanted = catalogues.select("catalogue_id").distinct().select("catalogue_id", F.inline(choices))
    return wanted.join(covered, ["catalogue_id", "pair"], "left_anti").select(
        "catalogue_id", "from_table", "to_table"
    )


def waived_pairs(rejections: DataFrame, cap: int = REJECTION_CAP) -> DataFrame:
    """Rejections per undirected table pair, and whether the pair is waived."""
    counted = rejections.groupBy(pair_key(F.col("table_a"), F.col("table_b")).alias("pair")).agg(
        F.count(F.lit(1)).alias("n_rejections")
    )
    return counted.withColumn("waived", F.col("n_rejections") >= cap)
