"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every source gets a target in words. A document's expected number of copies is target / source size; the
documents of a source are put in one order (longest first, then id), the expected copies are summed up along
it, one random offset per source (a hash of its name and the seed) is added, and a document is emitted once
for every integer boundary that its step crosses. Because lengths fall along the order, the words taken
differ from the target by about one document's length at most.

The running sum is distributed: a range partitioning by (source, length, id) sorts the thin rows, each row
keeps its position in its partition, and only one count per partition and source is summed up over the
partitions, so a source that holds a third of all rows spreads over a third of the tasks.

Defined results: null texts have size 0; a null source is a source of its own, ordered last; a source of
size 0 has target 0 and takes nothing; equal rows are separate documents; null ids sort last; an empty table gives
an empty result. Reruns agree whatever the partitioning, as the order is total up to equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, pieces, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES
) -> DataFrame:
    """sizes: one row per source (source, source_size). Adds target: `share` of all sizes dealt out by
    weight (weights repeat along the sources' code-point order, null last), no target above `most` times its
    source's size, the excess shared again by weight until none is above. The loop runs over one row per source
    and ends after as many rounds as there are groups of capped sources."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    known = materialize(
        sizes.select(
            "source",
            "source_size",
            F.element_at(listed, (nth + 1).cast("int")).alias("weight"),
            (F.col("source_size") * F.lit(float(most))).alias("cap"),
        ),
        "mix-sources",
    )
    total = (known.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0  # words per unit of weight
    while True:
        capped = F.col("weight") * F.lit(level) >= F.col("cap")
        fixed, free = known.agg(
            F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)),
        ).first()
        if not free or (total - fixed) / free <= level:
            break
        level = (total - fixed) / free
    return known.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("cap")).alias("target"))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_COPIES,
    seed: int = 0,
) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, copies, taken (= copies * size)."""
    thin = docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"),
    )
    parts = pieces(docs, 64 << 20)
    by = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id").asc_nulls_last()]
    placed = materialize(
        thin.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()),
        "mix-order",
    ).withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("source", "part").agg(
        F.min("at").alias("first_at"), F.count("*").alias("n"), F.sum("size").alias("words")
    )
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    r, t, p = runs.alias("r"), targets.alias("t"), placed.alias("p")
    runs = r.join(t, F.expr("r.source <=> t.source")).select(
        "r.source", "r.part", "r.first_at", "r.before", "t.source_size", "t.target"
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("before") + F.col("at") - F.col("first_at")
    offset = F.pmod(F.xxhash64(F.coalesce("p.source", F.lit("")), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (
        p.join(runs.alias("r"), F.expr("p.source <=> r.source AND p.part = r.part"))
        .select("p.*", "r.first_at", "r.before", "r.source_size", "r.target", offset.alias("offset"))
        .withColumn("rate", rate)
        .withColumn("rank", rank)
        .withColumn(
            "copies",
            F.floor((F.col("rank") + 1) * F.col("rate") + F.col("offset"))
            - F.floor(F.col("rank") * F.col("rate") + F.col("offset")),
        )
        .select(
            "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
        )
    )


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies. Rows that share id, source and size stand next to each other in the mix's order; their copies
    are dealt out evenly, and where these do not divide, the first rows by place in a stored table get one more."""
    size = F.regexp_count(text_of(text), F.lit(WORD)).cast("long")
    taken = mix(docs, key, text, source, **settings).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"))
    taken = materialize(taken.where("copies > 0").select(F.col("doc_id").alias("__i"), F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("n").alias("__n"), F.col("copies").alias("__c")), "mix-taken")
    same = F.col(f"`{key}`").eqNullSafe(F.col("__i")) & F.col(f"`{source}`").eqNullSafe(F.col("__s")) & (size == F.col("__z"))
    columns = [f"`{c}`" for c in docs.columns]
    copies = F.floor(F.col("__c") / F.col("__n")).cast("int")

    def repeated(rows: DataFrame, times: Column) -> DataFrame:
        return rows.withColumn("__t", times.cast("int")).where("__t > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__t")))).select(*columns)

    uneven = taken.where("__c % __n <> 0")
    out = repeated(docs.join(taken.where("__c % __n = 0"), same), copies)
    if uneven.isEmpty():
        return out
    rows = materialize(docs.join(uneven, same).withColumn("__u", F.monotonically_increasing_id()), "mix-uneven")
    by = ["__i", "__s", "__z"]
    placed = rows.select(*by, "__u", "__n", "__c").repartitionByRange(pieces(rows, 64 << 20), *by, "__u").sortWithinPartitions(*by, "__u")
    placed = materialize(placed.withColumn("__at", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__at", 33)), "mix-places")
    runs = placed.groupBy(*by, "__p").agg(F.min("__at").alias("__first"), F.count("*").alias("__m"))
    before = W.partitionBy(*by).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__m").over(before), F.lit(0))).alias("r")
    p = placed.alias("p")
    nth = p.join(runs, F.expr("p.__i <=> r.__i AND p.__s <=> r.__s AND p.__z = r.__z AND p.__p = r.__p"))
    nth = nth.select(F.col("p.__u"), (F.col("r.__before") + F.col("p.__at") - F.col("r.__first")).alias("__nth"))
    return out.unionByName(repeated(rows.join(nth, "__u"), copies + (F.col("__nth") < F.col("__c") % F.col("__n")).cast("int")))
