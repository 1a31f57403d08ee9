"""References to records that do not exist, followed down the foreign keys."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathlake.session import cut

#: Children of one key that meet in one join key; a key with more is salted.
SALT_ROWS = 1_000_000


@dataclass(frozen=True)
class Entity:
    """One table of the graph.

    ``df`` holds one row per ``id``. ``time`` names the column by which orphans
    are reported and against which a parent's lifetime is tested.
    ``valid_from``/``valid_to`` mark a parent that lives only for a while.
    """

    df: DataFrame
    id: str
    time: str | None = None
    valid_from: str | None = None
    valid_to: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    child: str
    child_key: tuple[str, ...]
    parent: str
    parent_key: tuple[str, ...]


def _salted(children: DataFrame, parents: DataFrame, keys: list[str], rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``: keys of many children are spread, as widely as they have children, and their parents copied.

    Keys are counted with partial aggregation. Where none is hot, as most
    often, the salt is 0 everywhere and no parent is copied.
    """
    rows = SALT_ROWS if rows is None else rows
    hot = cut(children.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows).select(*keys, F.ceil(F.col("_n") / rows).cast("int").alias("_salts")))
    if hot.isEmpty():
        return children.withColumn("_salt", F.lit(0)), parents.withColumn("_salt", F.lit(0))
    salts = F.coalesce("_salts", F.lit(1))
    c = children.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64("ref_id"), salts).cast("int")).drop("_salts")
    p = parents.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return c, p


def _children(entities: dict[str, Entity], fk: ForeignKey) -> DataFrame:
    e = entities[fk.child]
    period = F.date_format(F.col(e.time), "yyyy-MM") if e.time else F.lit(None).cast("string")
    keys = [F.col(c).cast("string").alias(f"_k{i}") for i, c in enumerate(fk.child_key)]
    time = F.col(e.time) if e.time else F.lit(None).cast("timestamp_ntz")
    rows = e.df.select(F.col(e.id).cast("bigint").alias("ref_id"), time.alias("_time"), period.alias("period"), *keys)
    return rows.dropna(subset=[f"_k{i}" for i in range(len(keys))])


def direct_orphans(entities: dict[str, Entity], fk: ForeignKey) -> DataFrame:
    """Rows whose key names no parent that lived at the row's time.

    A NULL key names nothing and is no case. A row without time is matched by
    no parent that has a lifetime, so it is an orphan.
    """
    p = entities[fk.parent]
    keys = [f"_k{i}" for i in range(len(fk.parent_key))]
    life = [F.col(c).alias(a) for c, a in ((p.valid_from, "_from"), (p.valid_to, "_to")) if c]
    parents = p.df.select(*[F.col(c).cast("string").alias(k) for c, k in zip(fk.parent_key, keys)], *life).distinct()
    c, p_ = _salted(_children(entities, fk), parents, keys)
    on = [c[k] == p_[k] for k in (*keys, "_salt")]
    if p.valid_from:
        on.append(p_["_from"] <= c["_time"])
    if p.valid_to:
        on.append(p_["_to"].isNull() | (p_["_to"] > c["_time"]))
    return c.join(p_, on, "left_anti").select(
        F.lit(fk.child).alias("ref_table"), "ref_id", "period", F.lit("direct").alias("kind"), F.lit(fk.parent).alias("missing_in"), F.lit(0).alias("depth")
    )


def cascade_orphans(entities: dict[str, Entity], keys: list[ForeignKey]) -> DataFrame:
    """Direct and inherited orphans of a foreign-key graph, to its fixpoint.

    A row is a *direct* orphan for each key whose parent is missing (or was
    deleted, or did not exist yet). A row that names an orphaned record is an
    *inherited* orphan, at the depth of the shortest chain. Each round
    semi-joins the children with the last round's orphans and is checkpointed;
    rounds end when none is new, which they must, so cycles in the graph end too.

    Result: ``ref_table, ref_id, period, kind, missing_in, depth``; direct rows
    once for each missing parent table, inherited rows once. Empty tables give
    no rows.
    """
    found = None
    for fk in keys:
        d = direct_orphans(entities, fk)
        found = d if found is None else found.unionByName(d)
    found = cut(found)
    frontier = found.select("ref_table", "ref_id").distinct()
    tables = {fk.parent for fk in keys} & {fk.child for fk in keys}
    for depth in count(1):
        step = None
        for fk in (k for k in keys if k.parent in tables):
            p = entities[fk.parent]
            names = [f"_k{i}" for i in range(len(fk.parent_key))]
            bad = p.df.select(F.col(p.id).cast("bigint").alias("ref_id"), *[F.col(c).cast("string").alias(k) for c, k in zip(fk.parent_key, names)])
            bad = bad.join(frontier.filter(F.col("ref_table") == fk.parent).select("ref_id"), "ref_id", "left_semi").select(*names).distinct()
            c, b = _salted(_children(entities, fk), bad, names)
            rows = c.join(b, [*names, "_salt"], "left_semi").select(
                F.lit(fk.child).alias("ref_table"), "ref_id", "period", F.lit("inherited").alias("kind"), F.lit(fk.parent).alias("missing_in"), F.lit(depth).alias("depth")
            )
            step = rows if step is None else step.unionByName(rows)
        if step is None:
            return found
        step = step.join(found.select("ref_table", "ref_id").distinct(), ["ref_table", "ref_id"], "left_anti").dropDuplicates(["ref_table", "ref_id"])
        step = cut(step)
        if step.isEmpty():
            return found
        found, frontier = found.unionByName(step), step.select("ref_table", "ref_id")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted by table and period: direct, inherited, and rows in all."""
    return orphans.groupBy("ref_table", "period").agg(
        F.count_distinct(F.when(F.col("kind") == "direct", F.col("ref_id"))).alias("direct"),
        F.count_distinct(F.when(F.col("kind") == "inherited", F.col("ref_id"))).alias("inherited"),
        F.count_distinct("ref_id").alias("orphans"),
    )
