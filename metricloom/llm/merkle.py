"""A Merkle manifest of a dataset: trees of hashes, and a recursive climb from each leaf."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricloom.llm.common import stash
from metricloom.session import pin

FAN = 3
#: Levels between a node row and its descendants: a row holds up to FAN ** STEP hashes below.
STEP = 6
TOP = -1


@dataclass
class Manifest:
    """What ``build`` leaves: the leaves in order, parent-linked node rows, and the root."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None


def entry_hash(columns: list[Column]) -> Column:
    """Hash of values that cannot run into each other: each its UTF-8 length and text."""
    texts = [c.cast("string") for c in columns]
    parts = [
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]
    return F.sha2(F.concat(*parts), 256)


def _levels(n: Column) -> Column:
    """Levels that the next node row spans in a tree with ``n`` nodes left: up to ``STEP``."""
    found = F.lit(STEP)
    for levels in range(STEP - 1, -1, -1):
        found = F.when(n <= FAN**levels, levels).otherwise(found)
    return found


def _width(levels: Column) -> Column:
    return F.pow(F.lit(FAN), levels).cast("long")


def _link(tree: Column, level: Column, at: Column, n: Column, trees: int) -> list[Column]:
    """Where a node, the ``at``-th of ``n`` in its tree, has its parent row and its place
    there; nulls for the root. The last node of a source's tree goes on in the top tree."""
    top = tree == TOP
    ends = n == 1
    here, wide = _width(_levels(n)), _width(_levels(F.lit(trees)))
    alone = top if trees > 1 else F.lit(True)
    none = F.lit(None).cast("long")
    return [
        F.when(~ends, tree).when(alone, none).otherwise(F.lit(TOP)).cast("long").alias("up_tree"),
        F.when(~ends, level).when(alone, none).otherwise(F.lit(0)).cast("int").alias("up_level"),
        F.when(~ends, _div(at, here)).when(alone, none).otherwise(_div(tree, wide)).alias("up_group"),
        F.when(~ends, at % here).when(alone, none).otherwise(tree % wide).cast("int").alias("up_at"),
    ]


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _placed(docs: DataFrame, id_: Column, group: Column, leaf: Column, start: Column) -> tuple[DataFrame, int]:
    """(id, leaf, start, tree, at, n, place) of each row and the number of trees.

    ``tree`` numbers the groups in order, ``at`` the ``n`` leaves of a group, ``place`` all
    leaves. Rows move once, in a range shuffle whose last key is unique; the driver gets two
    counts of each task.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        group.alias("group"), id_.alias("id"), leaf.alias("leaf"), start.alias("start"),
        F.monotonically_increasing_id().alias("unique"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("group", "id", "leaf", "unique")]
    ranked = stash(
        keyed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "group", "id", "leaf", "start",
            F.spark_partition_id().alias("task"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("row"),
        )
    )
    counts = ranked.groupBy("task", "group").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    own = Window.partitionBy("group").orderBy("task")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    runs = pin(
        counts.select(
            "task", "group", "first",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
            F.sum("n").over(Window.partitionBy("group")).alias("n"),
            F.first("task").over(own).alias("task0"),
            F.first("first").over(own).alias("first0"),
        )
    )
    begun = {r["task0"]: r["k"] for r in runs.where("task = task0").groupBy("task0").agg(F.count(F.lit(1)).alias("k")).collect()}
    rows = {r["task"]: r["k"] for r in counts.groupBy("task").agg(F.sum("n").alias("k")).collect()}
    bases, trees, places = [], 0, 0
    for task in sorted(rows):
        bases.append((task, trees, places))
        trees += begun.get(task, 0)
        places += rows[task]
    base = spark.createDataFrame(bases, "task int, trees long, places long")
    # A row for each task, so both broadcasts are bounded by the cluster.
    numbered = runs.join(F.broadcast(base.select(F.col("task").alias("task0"), "trees")), "task0").join(
        F.broadcast(base.select("task", "places")), "task"
    )
    rank = F.dense_rank().over(Window.partitionBy("task0").orderBy("first0"))
    marks = numbered.select(
        F.col("task").alias("_task"),
        F.col("group").alias("_group"),
        (F.col("trees") + rank - 1).alias("tree"),
        (F.col("before") - F.col("first")).alias("shift"),
        "n",
        "places",
    )
    same = (F.col("task") == F.col("_task")) & F.col("group").eqNullSafe(F.col("_group"))
    placed = ranked.join(marks, same).select(
        "id", "leaf", "start", "tree", (F.col("row") + F.col("shift")).alias("at"), "n",
        (F.col("places") + F.col("row")).alias("place"),
    )
    return placed, trees


def _parents(hashes: Column) -> Column:
    """The hashes of every ``FAN`` consecutive ones; the last run may be shorter."""
    begins = F.sequence(F.lit(1), F.size(hashes), F.lit(FAN))
    return F.transform(begins, lambda a: F.sha2(F.concat_ws("", F.slice(hashes, a, FAN)), 256))


def _rows_of_nodes(level: DataFrame, number: int, trees: int) -> DataFrame:
    """Node rows over the (tree, at, n, hash, lo, hi) of a level; trees with one node are done."""
    levels = _levels(F.col("n"))
    grouped = (
        level.where("n > 1")
        .groupBy("tree", "n", levels.alias("levels"), _div(F.col("at"), _width(levels)).alias("group"))
        .agg(
            F.transform(F.sort_array(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"]).alias("h0"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
        )
    )
    for i in range(1, STEP + 1):
        above = _parents(F.col(f"h{i - 1}"))
        grouped = grouped.withColumn(f"h{i}", F.when(F.col("levels") >= i, above))
    top = F.coalesce(*[F.col(f"h{i}") for i in range(STEP, 0, -1)])[0]
    wide = _width(F.col("levels"))
    left = _div(F.col("n") + wide - 1, wide)
    return grouped.select(
        "tree", F.lit(number).alias("level"), "group", "lo", "hi", left.alias("n"), top.alias("hash"),
        # The levels below the row's own node, the lowest first.
        F.slice(F.array(*[F.col(f"h{i}") for i in range(STEP)]), F.lit(1), F.col("levels")).alias("below"),
        F.when((F.col("tree") != TOP) & (left == 1), top).alias("subroot"),
        *_link(F.col("tree"), F.lit(number + 1), F.col("group"), left, trees),
    )


def _grow(level: DataFrame, largest: int, trees: int) -> tuple[list[DataFrame], DataFrame]:
    """Node rows of trees from their lowest level upwards, and each tree's last node."""
    built, done, number = [], [level.where("n = 1")], 0
    while largest > 1:
        rows = stash(_rows_of_nodes(level, number, trees))
        built.append(rows)
        level = rows.select("tree", F.col("group").alias("at"), "n", "hash", "lo", "hi")
        done.append(level.where("n = 1"))
        for _ in range(STEP):
            largest = -(-largest // FAN)
        number += 1
    last = done[0]
    for more in done[1:]:
        last = last.unionByName(more)
    return built, last


def build(
    docs: DataFrame, columns: list[str], id_column: str = "doc_id", group_column: str = "source",
    start: Column | None = None,
) -> Manifest:
    """Trees of hashes over the rows, one for each value of ``group_column``, and one over
    their roots.

    A leaf is the ``entry_hash`` of ``columns``. Leaves of a group ascend by ``id_column``
    (null first, then by their hashes); every ``FAN`` consecutive nodes become the hash of
    their hashes, until one is left. Groups ascend by value, null first. ``start`` is the
    hash that a later climb begins with, the leaf itself if not given.

    Repeated rows are leaves of their own. No rows have no root (None). The text is read and
    hashed where it lies; only hashes are shuffled. A group of any size spreads: positions
    come from a range shuffle, and a node row takes ``FAN ** STEP`` nodes at most.
    """
    leaf = entry_hash([F.col(f"`{c}`") for c in columns])
    placed, trees = _placed(
        docs, F.col(f"`{id_column}`"), F.col(f"`{group_column}`"), leaf, leaf if start is None else start
    )
    placed = pin(
        placed.select(
            "id", "leaf", "start", "tree", "n", "at", "place",
            *_link(F.col("tree"), F.lit(0), F.col("at"), F.col("n"), trees),
        )
    )
    largest = placed.agg(F.max("n")).first()[0]
    if largest is None:
        return Manifest(placed, _rows_of_nodes(_level(placed), 0, 1), None)
    below, subroots = _grow(_level(placed), largest, trees)
    tops = subroots.select(
        F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(trees).cast("long").alias("n"),
        "hash", "lo", "hi",
    )
    above, last = _grow(tops, trees, trees)
    nodes = [*below, *above] or [_rows_of_nodes(_level(placed), 0, trees)]
    whole = nodes[0]
    for more in nodes[1:]:
        whole = whole.unionByName(more)
    return Manifest(placed, whole, last.first()["hash"])


def _level(placed: DataFrame) -> DataFrame:
    return placed.select(
        "tree", "at", "n", F.col("leaf").alias("hash"), F.col("place").alias("lo"), F.col("place").alias("hi")
    )


# The hashes left and right of the place ``at``, level by level through a node row n.
_AT = f"cast(at div cast(pow({FAN}, i) AS bigint) AS int)"
_STEPS = f"""transform(sequence(0, size(n.below) - 1), i -> named_struct(
  'left', concat_ws('', slice(n.below[i], cast({_AT} div {FAN} * {FAN} + 1 AS int), {_AT} % {FAN})),
  'right', concat_ws('', slice(n.below[i], {_AT} + 2, {FAN - 1} - {_AT} % {FAN}))))"""
_NONE = "CAST(array() AS array<struct<left:string,right:string>>)"


def climb(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """(id, leaf, subroot, proof, folded) of each leaf: ``proof`` has the siblings on its way to
    the root, 32 bytes each, left to right and upwards; ``folded`` is the root that the
    leaf's ``start`` gives with them.

    One recursive query climbs from every node row: each round joins it to the row above, by
    the link of the row before, and appends the siblings there. The up to ``FAN ** STEP``
    leaves below a row share its way, so leaves are shuffled once, to their row, whatever the
    height: there each takes its own siblings and the way on, and folds its hash through
    all of them. The rounds grow with the logarithm of the rows, one for every ``STEP`` levels.
    """
    nodes = manifest.nodes.select(
        "tree", "level", "group", "below", "subroot", "up_tree", "up_level", "up_group", "up_at"
    )
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        ways = pin(
            spark.sql(
                f"""
                WITH RECURSIVE way (tree, level, group, up_tree, up_level, up_group, at, subroot, steps) AS (
                  SELECT tree, level, group, up_tree, up_level, up_group, up_at, subroot, {_NONE} FROM {{nodes}}
                  UNION ALL
                  SELECT w.tree, w.level, w.group, n.up_tree, n.up_level, n.up_group, n.up_at,
                    coalesce(w.subroot, n.subroot), concat(w.steps, {_STEPS})
                  FROM way w JOIN {{nodes}} n
                  ON w.up_tree = n.tree AND w.up_level = n.level AND w.up_group = n.group
                )
                SELECT tree, level, group, subroot, steps FROM way WHERE up_tree IS NULL
                """,
                nodes=nodes,
            )
        )
    finally:
        spark.conf.set(limit, before)
    key = ["tree", "level", "group"]
    rows = nodes.select(*key, "below").join(ways, key).alias("n")
    leaves = manifest.leaves.select(
        "id", F.unhex("leaf").alias("leaf"), F.unhex("start").alias("start"), F.col("up_tree").alias("tree"),
        F.col("up_level").alias("level"), F.col("up_group").alias("group"), F.col("up_at").alias("at"),
        (F.col("n") == 1).alias("alone"),
    )
    steps = F.coalesce(F.expr(f"concat({_STEPS}, n.steps)"), F.expr(_NONE))
    subroot = F.when(F.col("alone"), F.lower(F.hex("leaf"))).otherwise(F.col("subroot"))
    met = leaves.join(rows, key, "left").select("id", "leaf", "start", subroot.alias("subroot"), steps.alias("steps"))
    return met.select(
        "id", F.lower(F.hex("leaf")).alias("leaf"), "subroot",
        F.unhex(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")).alias("proof"),
        F.aggregate(
            "steps", F.lower(F.hex("start")),
            lambda folded, s: F.sha2(F.concat(s["left"], folded, s["right"]), 256),
        ).alias("folded"),
    )
