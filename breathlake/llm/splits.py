"""Train, validation and test splits that keep related records together.

Records and the entities they name form a bipartite graph. The smallest label
reaches every node of a component by label propagation in Spark joins; whole
components are then assigned to splits so that shares and label distributions
stay near their targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathlake.session import cut

#: Links of one entity that meet in one join key; an entity with more is split into parts.
PART_LINKS = 1_000_000
#: Bundles in which groups are placed: each holds the groups of one hash value, whole.
BUNDLES = 4096
#: Labels that are told apart in keeping the distribution; if there are more, they share this many pools by hash.
MAX_STRATA = 256


def _parted(links: DataFrame, most: int) -> DataFrame:
    """``record, entity, part``: entities of more than ``most`` links in parts, which a record of their own ties to part 0."""
    links = links.select(F.concat(F.lit("r"), F.col("record").cast("string")).alias("record"), "entity")
    hot = cut(links.groupBy("entity").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("entity", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    if hot.isEmpty():
        return links.withColumn("part", F.lit(0))
    d = links.join(hot, "entity", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("record"), F.col("parts")), F.lit(0)).cast("int"))
    tie = hot.select(F.concat(F.lit("e"), F.col("entity").cast("string")).alias("record"), "entity", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return d.select("record", "entity", "part").unionByName(tie)


def propagate_labels(links: DataFrame, part_links: int = PART_LINKS) -> DataFrame:
    """``entity, label``: the smallest entity of each connected component.

    ``links(record, entity)`` is the bipartite graph; repeated links count once
    and null ends are ignored. In each round a record takes the least label of
    its entities and an entity the least label of its records; then each label
    is replaced by the label of the entity it names, which halves long chains.
    One entity may hold any share of the links: beyond ``part_links`` it is
    split into parts tied to each other, so no join key has more rows. A record
    names few entities. Rounds end when no label changes, which they must,
    since labels only get smaller.
    """
    links = cut(_parted(cut(links.dropna().distinct()), part_links))
    node = ["entity", "part"]
    labels = cut(links.select(*node, F.col("entity").alias("label")).distinct())
    while True:
        seen = links.join(labels, node).groupBy("record").agg(F.min("label").alias("label"))
        step = links.join(seen, "record").groupBy(*node).agg(F.min("label").alias("label"))
        jump = step.filter("part = 0").select(F.col("entity").alias("label"), F.col("label").alias("far"))
        step = step.join(jump, "label", "left").select(*node, F.least("label", F.coalesce("far", "label")).alias("label"))
        step = cut(step.join(labels.withColumnRenamed("label", "old"), node).select(*node, "label", (F.col("label") != F.col("old")).alias("moved")))
        labels = step.select(*node, "label")
        if step.filter("moved").isEmpty():
            return labels.filter("part = 0").select("entity", "label")


def assign_groups(members: DataFrame, targets: list[tuple[str, float]], seed: int = 17, bundles: int = BUNDLES) -> DataFrame:
    """``group, split`` for whole groups, near the target shares in every stratum.

    ``members(group, stratum, n)`` counts the records of a group by the label
    whose distribution is to be kept; a group may have several, and null is a
    label of its own. Groups fall into ``bundles`` by hash, large and small
    alike, and the bundles are placed largest first, each in the split where
    the summed squared deviation of stratum shares from their targets grows
    least. With fewer groups than bundles most stand alone. A target of zero
    gets nothing; shares are normalised to one. Only the bundles' counts by
    stratum come to the driver, at most ``bundles x MAX_STRATA``.
    """
    spark = members.sparkSession
    group_type = dict(members.dtypes)["group"]
    total_share = sum(s for _, s in targets)
    shares = [(n, s / total_share) for n, s in targets]
    stratum = F.coalesce(F.col("stratum").cast("string"), F.lit(""))
    members = members.select("group", stratum.alias("stratum"), "n", F.pmod(F.xxhash64("group", F.lit(seed)), F.lit(bundles)).cast("int").alias("bundle"))
    members = cut(members.groupBy("group", "bundle", "stratum").agg(F.sum("n").alias("n")))
    if members.select("stratum").distinct().limit(MAX_STRATA + 1).count() > MAX_STRATA:
        members = members.withColumn("stratum", F.pmod(F.xxhash64("stratum"), F.lit(MAX_STRATA)).cast("string"))
    held: dict[int, dict] = {}
    for r in members.groupBy("bundle", "stratum").agg(F.sum("n").alias("n")).collect():
        held.setdefault(r["bundle"], {})[r["stratum"]] = r["n"]
    whole: dict = {None: 0}  # all strata together weigh as much as each by itself
    for by in held.values():
        for s, n in by.items():
            whole[s] = whole.get(s, 0) + n
            whole[None] += n
    if not whole[None]:
        return spark.createDataFrame([], f"group {group_type}, split string")
    got = {n: dict.fromkeys(whole, 0) for n, _ in shares}
    placed = []
    for b, by in sorted(held.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        by = by | {None: sum(by.values())}

        def cost(name: str, share: float, by=by) -> float:
            # growth of (held - target)^2 / target, but for what is the same for every split
            return sum((len(whole) - 1 if s is None else 1) * (((got[name][s] + n) ** 2 - got[name][s] ** 2) / (share * whole[s]) - 2 * n / whole[s]) for s, n in by.items() if n)

        best = min(((cost(n, s), n) for n, s in shares if s > 0))[1]
        for s, n in by.items():
            got[best][s] += n
        placed.append((b, best))
    chosen = spark.createDataFrame(placed, "bundle int, split string")
    return members.select("group", "bundle").distinct().join(F.broadcast(chosen), "bundle").select("group", "split")  # at most ``bundles`` rows


def forced_pairs(records: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of one group whose written ids differ, from ``records(group, written, id)``.

    Written forms are paired first and only then expanded, so records that
    share their form are never paired. The output itself is quadratic in a
    group that is written in many ways.
    """
    forms = records.select("group", "written").distinct()
    other = forms.withColumnRenamed("written", "written_b")
    pairs = forms.join(other, "group").filter(F.col("written") < F.col("written_b"))
    left = records.select("group", "written", F.col("id").alias("i"))
    right = records.select("group", F.col("written").alias("written_b"), F.col("id").alias("j"))
    both = pairs.join(left, ["group", "written"]).join(right, ["group", "written_b"])
    return both.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).filter("a < b").distinct()
