"""Scores of retrieval and answering on a gold set.

gold: qid, answerable, relevant array<struct<source, heading>>.  hits: mode, qid, rank, source, heading.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of passages that are looked for at once: what one automaton, which every task builds, is made of.
AT_ONCE = 4 << 20
KS = (1, 3, 5)


def containing(docs: DataFrame, key: str, passages: DataFrame, item: str, at_once: int = AT_ONCE) -> DataFrame:
    """key, item of each two such that docs.text contains passages.text; an empty passage is in every text, null in none.

    An automaton of all passages reads each text once, where it lies, and only hits leave a task.  Passages of more than
    at_once characters are taken in rounds, by a hash of the passage; equal passages are looked for once.
    """
    passages = passages.filter(F.col("text").isNotNull()).select(item, "text")
    total = passages.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    rounds = max(1, -(-total // at_once))
    kinds = [docs.schema[key].dataType, passages.schema[item].dataType]
    arrow = [to_arrow_type(k) for k in kinds]
    schema = f"{key} {kinds[0].simpleString()}, {item} {kinds[1].simpleString()}"
    out = None
    for r in range(rounds):
        items: dict[str, list] = {}
        for p in passages.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r).collect():  # a round's passages
            items.setdefault(p.text, []).append(p[item])
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            everywhere = shared.value.get("", [])
            automaton = ahocorasick.Automaton()
            for text, ids in shared.value.items():
                if text:
                    automaton.add_word(text, ids)
            automaton.make_automaton()
            for b in batches:
                keys, found = [], []
                for k, text in zip(b.column(key).to_pylist(), b.column("text")):
                    if text.is_valid:
                        hits = {id(ids): ids for _, ids in automaton.iter(text.as_py())} if len(automaton) else {}
                        ids = [i for some in (*hits.values(), everywhere) for i in some]
                        keys += [k] * len(ids)
                        found += ids
                yield pa.RecordBatch.from_arrays([pa.array(keys, arrow[0]), pa.array(found, arrow[1])], names=[key, item])

        part = docs.select(key, "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def targets(gold: DataFrame) -> DataFrame:
    return gold.filter("answerable").select("qid", F.posexplode("relevant").alias("target_no", "t")).select("qid", "target_no", F.col("t.source").alias("source"), F.col("t.heading").alias("target"))


def met(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Hits that meet a target: the same source, and the target's heading within theirs, whatever the case."""
    inside = F.contains(F.lower("heading"), F.lower("target"))
    return hits.join(targets(gold), ["qid", "source"]).filter(inside)


def retrieval_report(hits: DataFrame, gold: DataFrame, modes: DataFrame, ks: tuple = KS) -> DataFrame:
    """mode, questions, recall_at_k..., mrr: means over all answerable questions; one without a hit counts as 0."""
    wanted = gold.filter("answerable").select("qid", F.size("relevant").alias("n_targets"))
    found = met(hits, gold)
    at = lambda k: F.size(F.collect_set(F.when(F.col("rank") <= k, F.col("target_no")))).alias(f"met_{k}")
    per = found.groupBy("mode", "qid").agg(*[at(k) for k in ks], F.min("rank").alias("first"))
    every = wanted.crossJoin(F.broadcast(modes)).join(per, ["mode", "qid"], "left")  # a few modes
    share = lambda k: F.avg(F.coalesce(F.col(f"met_{k}"), F.lit(0)) / F.col("n_targets")).alias(f"recall_at_{k}")
    return every.groupBy("mode").agg(F.count("*").alias("questions"), *[share(k) for k in ks], F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def _mean(value: Column, where: Column) -> Column:
    return F.coalesce(F.avg(F.when(where, value.cast("double"))), F.lit(0.0))


def abstention_report(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """decision_accuracy, false_abstention_rate, missed_abstention_rate; the mean of nothing is 0."""
    a = answers.select("qid", "abstained").join(gold.select("qid", "answerable"), "qid")
    yes, ab = F.col("answerable"), F.col("abstained")
    return a.agg(_mean(ab != yes, F.lit(True)).alias("decision_accuracy"), _mean(ab, yes).alias("false_abstention_rate"), _mean(~ab, ~yes).alias("missed_abstention_rate"))


def gold_cited(answers: DataFrame, citations: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of answered answerable questions with a citation that meets a target."""
    asked = answers.filter("not abstained").join(gold.filter("answerable").select("qid"), "qid", "left_semi").select("qid")
    good = met(citations, gold).select("qid").distinct().withColumn("ok", F.lit(1.0))
    return asked.join(good, "qid", "left").agg(F.count("*").alias("answered"), F.coalesce(F.avg(F.coalesce("ok", F.lit(0.0))), F.lit(0.0)).alias("gold_cited"))


def uncovered(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """Answerable questions no chunk of the corpus can answer: none, if the gold set fits the corpus."""
    t = targets(gold)
    inside = F.contains(F.lower(F.col("heading")), F.lower(F.col("target")))
    hit = t.join(chunks.select("source", "heading"), "source").filter(inside).select("qid").distinct()
    return gold.filter("answerable").select("qid").join(hit, "qid", "left_anti")
