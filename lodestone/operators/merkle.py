"""Digest trees of a corpus: two versions are compared from the root, and only what differs is read further.

files: source, sha256, prefix.  A prefix is the first LEVELS hex digits of the MD5 of a source's name.
digests: level, prefix, digest.  On the lowest level a digest is the SHA-256 of its files' "name=hash;" in order of the name's
bytes, above of its children's "prefix=digest;".  Both tables are in order of their prefixes, so that a reader who asks for some
prefixes skips other row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import cut

LEVELS = 4  # 65,536 leaves; a leaf's names meet in one row, so deeper trees are for more than some 10 ** 8 files
FEW = 1024  # prefixes that are pushed down to the files; more are joined


def _digest(groups: DataFrame, key: str, *line) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.concat(*line)))
    return groups.groupBy(key).agg(F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("digest"))


def write(at: str, hashes: DataFrame, levels: int = LEVELS) -> None:
    """Writes the tables of hashes (source, sha256) below at; of a repeated source the rows count together."""
    spark = hashes.sparkSession
    name = F.substring(F.md5(F.col("source").cast("binary")), 1, levels).alias("prefix")
    hashes.select("source", "sha256", name).repartitionByRange("prefix").sortWithinPartitions("prefix", "source").write.parquet(f"{at}/files")
    leaves = spark.read.parquet(f"{at}/files")
    level = cut(_digest(leaves, "prefix", "source", F.lit("="), F.coalesce("sha256", F.lit("")), F.lit(";")))
    every = level.withColumn("level", F.lit(levels))
    for n in range(levels - 1, -1, -1):
        level = cut(_digest(level.withColumn("up", F.substring("prefix", 1, n)), "up", "prefix", F.lit("="), "digest", F.lit(";")).withColumnRenamed("up", "prefix"))
        every = every.unionByName(level.withColumn("level", F.lit(n)))
    every.repartitionByRange("level", "prefix").sortWithinPartitions("level", "prefix").write.parquet(f"{at}/digests")


def read(spark: SparkSession, at: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{at}/{t}") for t in ("files", "digests")}


def _below(rows: DataFrame, above: DataFrame, n: int) -> DataFrame:
    """The rows whose prefix begins with one of above's of n digits."""
    some = [r.prefix for r in above.select("prefix").limit(FEW + 1).collect()]  # bounded
    if len(some) <= FEW:
        return rows.filter(F.substring("prefix", 1, n).isin(some)).filter(F.col("prefix") >= min(some)).filter(F.col("prefix") < max(some) + "g") if some else rows.limit(0)
    return rows.join(above.select(F.col("prefix").alias("_p")), F.substring("prefix", 1, n) == F.col("_p"), "left_semi")


def changes(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> tuple[DataFrame, list[int]]:
    """source, status (added, changed, removed) of files that differ, and the digests compared on each level."""
    levels = max(t["digests"].agg(F.max("level")).first()[0] or 0 for t in (old, new))
    above, compared = None, []
    for n in range(levels + 1):
        sides = [t["digests"].filter(F.col("level") == n) for t in (old, new)]
        if above is not None:
            sides = [_below(s, above, n - 1) for s in sides]
        o, w = (s.select("prefix", F.col("digest").alias(c)) for s, c in zip(sides, "ow"))
        both = cut(o.join(w, "prefix", "full_outer"))
        compared.append(both.count())
        above = both.filter(~F.col("o").eqNullSafe(F.col("w"))).select("prefix")
    o, w = (_below(t["files"], above, levels).select("source", F.struct(F.coalesce("sha256", F.lit("")).alias("h")).alias(c)) for t, c in ((old, "o"), (new, "w")))
    o, w = (x.groupBy("source").agg(F.array_sort(F.collect_list(c)).alias(c)) for x, c in ((o, "o"), (w, "w")))
    both = o.join(w, "source", "full_outer").filter(~F.col("o").eqNullSafe(F.col("w")))
    return both.select("source", F.when(F.col("o").isNull(), "added").when(F.col("w").isNull(), "removed").otherwise("changed").alias("status")), compared
