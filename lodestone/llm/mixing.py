"""Mixing sources to target weights: budgets down a domain-language-source tree, token prefixes of seeded epochs.

Documents are grouped under domain (a hash class of the source), language and source.  The root's budget goes down level
by level: each node shares its budget among its children by weight, none above what its subtree can give (its tokens
times ``max_epochs``); what a child can't use goes to its siblings first, and only what a whole family can't use goes to
its parent's siblings, because a subtree never gets more than it can give.  The shares of one family have a closed form
over running sums (``_pour``), so a level is one window over the few rows of the tree.

A leaf with a budget takes whole epochs first and then the longest prefix within the budget of one more epoch, in an
order seeded by (seed, epoch, document).  A leaf may hold a third of all rows, so the prefix is found in steps: token
sums of 2**BITS hash ranges a leaf, running sums over those, then the same within the range in which the budget ends
(``DEPTH`` times), and a window over single rows only inside the last one, 2**-(BITS * DEPTH) of a leaf.  Everything is DataFrame functions; there is no Python on the executors.

Defined results: null languages or sources are the leaf ''; a document without words has no tokens and comes with its
place in the order; rows that repeat a doc_id, or have none, share its place and are ordered by tokens; an empty table gives no rows;
a weight that is null, missing or negative counts as 1, 1 and 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SEED = 17
FRACTION = 0.6
MAX_EPOCHS = 2
BITS = 8
DEPTH = 2
LEVELS = ("domain", "lang", "source")
#: Target weights of the four domain classes and the languages; sources weigh the same within a language.
WEIGHTS = {"domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def n_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 if null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def draw(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in an epoch's order: 60 bits of a hash."""
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def leaves(docs: DataFrame) -> DataFrame:
    source = F.coalesce(F.col("source"), F.lit(""))
    domain = F.concat(F.lit("d"), F.pmod(F.crc32(source.cast("binary")), F.lit(4)).cast("string"))
    return docs.select("doc_id", domain.alias("domain"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), source.alias("source"), n_words(F.col("text")).alias("tokens"))


def _weight(level: str, weights: dict) -> Column:
    w = F.lit(1.0)
    for name, value in weights.get(level, {}).items():
        w = F.when(F.col(level) == name, F.lit(float(max(value, 0)))).otherwise(w)
    return w


def _pour(nodes: DataFrame, family: list[str]) -> DataFrame:
    """budget of each node from its family's ``poured``, by weight w and never above its capacity cap (whole tokens).

    In order of cap / w, a node is full if what the fuller ones before it take and its share of the rest reach its cap:
    cap_before + (cap / w) * w_from_here <= poured.  The rest shares what is left by weight, rounded down.
    """
    order = Window.partitionBy(*family).orderBy(F.col("ratio").asc_nulls_last(), *[F.col(c) for c in LEVELS if c in nodes.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*family)
    n = nodes.withColumn("ratio", F.try_divide(F.col("cap"), F.col("w")))
    n = n.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_rest", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    n = n.withColumn("full", F.coalesce(F.col("cap_before") + F.col("ratio") * F.col("w_rest") <= F.col("poured"), F.lit(False)))
    taken, w_left = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole), F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0)).over(whole)
    share = F.floor(F.coalesce(F.try_divide((F.col("poured") - taken) * F.col("w"), w_left), F.lit(0.0)))
    n = n.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), share)).cast("long"))
    return n.drop("ratio", "cap_before", "w_rest", "full", "poured")


def budgets(tokens: DataFrame, fraction: float = FRACTION, max_epochs: int = MAX_EPOCHS, weights: dict | None = None) -> DataFrame:
    """domain, lang, source, tokens, budget: a row for each leaf. tokens: a row for each leaf and its token sum."""
    weights = WEIGHTS if weights is None else weights
    tree = tokens.withColumn("cap", F.col("tokens") * max_epochs)
    root = tree.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * fraction).cast("long").alias("poured"))
    level = None
    for depth in range(1, len(LEVELS) + 1):
        names = list(LEVELS[:depth])
        nodes = tree.groupBy(*names).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(names[-1], weights))
        if level is None:
            nodes = nodes.crossJoin(F.broadcast(root))  # one row
        else:
            nodes = nodes.join(level.select(*names[:-1], F.col("budget").alias("poured")), names[:-1])
        level = cut(_pour(nodes, names[:-1]))  # a row for each node: the next level's plan starts from them
    return level.join(tokens, list(LEVELS)).select(*LEVELS, "tokens", "budget")


def chosen(slim: DataFrame, plan: DataFrame, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """doc_id, domain, lang, source, tokens, epoch of each document taken, once for each epoch that takes it."""
    leaf = list(LEVELS)
    per = plan.filter("budget > 0 and tokens > 0").select(*leaf, F.col("budget"), F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest"))
    at_leaf = slim.join(per, leaf)
    full = at_leaf.filter("whole > 0").withColumn("epoch", F.explode(F.expr("sequence(0, whole - 1)")))
    part = at_leaf.filter("rest > 0").withColumn("epoch", F.col("whole"))
    part = part.withColumn("place", draw(seed, F.col("epoch"), F.col("doc_id")))
    cols = ["doc_id", *leaf, "tokens", "epoch"]
    done = full.select(*cols)
    part = part.withColumn("start", F.lit(0).cast("long"))
    for depth in range(1, DEPTH + 1):
        span = F.shiftright("place", 60 - depth * bits)
        sums = part.groupBy(*leaf, span.alias("span"), "rest", "start").agg(F.sum("tokens").alias("in_span"))
        upto = Window.partitionBy(*leaf).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.col("start") + F.coalesce(F.sum("in_span").over(upto), F.lit(0))).filter("before <= rest")
        # a leaf's ranges that end within its budget, and the one in which the budget ends
        met = part.drop("start").withColumn("span", span).join(sums.select(*leaf, "span", "before", "in_span"), [*leaf, "span"])
        done = done.unionByName(met.filter("before + in_span <= rest").select(*cols))
        part = cut(met.filter("before + in_span > rest").withColumnRenamed("before", "start").drop("span", "in_span"))
    run = Window.partitionBy(*leaf).orderBy("place", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = part.withColumn("upto", F.col("start") + F.sum("tokens").over(run)).filter("upto <= rest")
    return done.unionByName(edge.select(*cols))


def mix(docs: DataFrame, seed: int = SEED, fraction: float = FRACTION, max_epochs: int = MAX_EPOCHS, weights: dict | None = None) -> DataFrame:
    slim = cut(leaves(docs))
    sums = cut(slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")))
    return chosen(slim, cut(budgets(sums, fraction, max_epochs, weights)), seed)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, once for each epoch that takes their document."""
    key = ["doc_id", "lang", "source", "tokens"]
    nth = lambda *more: F.row_number().over(Window.partitionBy(*key, *more).orderBy(F.lit(1)))
    # rows that agree in all of these are alike to mix(), so any m of them may stand for the m that an epoch takes
    taken = mix(docs.select("doc_id", "text", "lang", "source"), **options).select(*key, nth("epoch").alias("nth"))
    text, blank = F.col("text"), F.lit("")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.coalesce("lang", blank).alias("lang"), F.coalesce("source", blank).alias("source"), n_words(text).alias("tokens"))
    rows, taken = rows.withColumn("nth", nth()).alias("r"), taken.alias("t")
    same = F.col("r.doc_id").eqNullSafe(F.col("t.doc_id"))
    for c in (*key[1:], "nth"):
        same = same & (F.col(f"r.{c}") == F.col(f"t.{c}"))
    return rows.join(taken, same).select("r.row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


_POUR_SQL = """
{name}_o AS (SELECT *, CASE WHEN w > 0 THEN cap / w END AS ratio FROM {name}_n),
{name}_b AS (SELECT *, coalesce(sum(cap) OVER ({family} ORDER BY ratio NULLS LAST, {names} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(w) OVER ({family}) - coalesce(sum(w) OVER ({family} ORDER BY ratio NULLS LAST, {names} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_rest FROM {name}_o),
{name}_f AS (SELECT *, coalesce(cap_before + ratio * w_rest <= poured, false) AS is_full FROM {name}_b),
{name} AS (SELECT {names}, CAST(CASE WHEN is_full THEN cap ELSE least(cap, floor(coalesce((poured - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({family})) * w
    / nullif(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({family}), 0), 0))) END AS BIGINT) AS budget FROM {name}_f)"""


def _case(level: str) -> str:
    known = WEIGHTS.get(level, {})
    return "CAST(CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in known.items()) + " ELSE 1 END AS DOUBLE)" if known else "CAST(1 AS DOUBLE)"


def _oracle() -> str:
    """crc32 isn't in DuckDB: the classes of the sources that the tables hold are computed here, by the same function."""
    import zlib

    names = ["", *(f"src{i}" for i in range(1000))]
    classes = ", ".join(f"('{s}', 'd{zlib.crc32(s.encode()) % 4}')" for s in names)
    levels, prev = [], None
    for i, level in enumerate(LEVELS):
        cols, family = ", ".join(LEVELS[: i + 1]), f"PARTITION BY {', '.join(LEVELS[:i])}" if i else ""
        poured = f"JOIN (SELECT {', '.join(LEVELS[:i])}, budget AS poured FROM l{i}) p USING ({', '.join(LEVELS[:i])})" if i else f"CROSS JOIN (SELECT CAST(floor(coalesce(sum(tokens), 0) * {FRACTION}) AS BIGINT) AS poured FROM leaf) p"
        levels.append(f"l{i + 1}_n AS (SELECT g.*, {_case(level)} AS w, poured FROM (SELECT {cols}, CAST(sum(tokens) * {MAX_EPOCHS} AS BIGINT) AS cap FROM leaf GROUP BY ALL) g {poured})")
        levels.append(_POUR_SQL.format(name=f"l{i + 1}", family=family, names=cols).strip())
    return f"""WITH class(source, domain) AS (VALUES {classes}),
slim AS (SELECT doc_id, domain, coalesce(lang, '') AS lang, c.source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens
    FROM documents d JOIN class c ON coalesce(d.source, '') = c.source),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM slim GROUP BY ALL),
{", ".join(levels)},
per AS (SELECT domain, lang, source, l3.budget // leaf.tokens AS whole, l3.budget % leaf.tokens AS rest FROM l3 JOIN leaf USING (domain, lang, source) WHERE budget > 0 AND tokens > 0),
part AS (SELECT s.*, whole AS epoch, rest, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY ('0x' || substr(md5('{SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::UBIGINT, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto
    FROM slim s JOIN per USING (domain, lang, source) WHERE rest > 0)
SELECT doc_id, domain, lang, source, tokens, CAST(epoch AS INTEGER) AS epoch FROM part WHERE upto <= rest
UNION ALL SELECT doc_id, domain, lang, source, tokens, CAST(e AS INTEGER) FROM slim JOIN per USING (domain, lang, source), (SELECT unnest(range({MAX_EPOCHS})) AS e) WHERE e < whole"""


ORACLE = _oracle()
