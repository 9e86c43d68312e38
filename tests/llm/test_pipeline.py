"""The corpus pipeline on whole given tables: each stage against a plain version of it on the stage's own input."""

import collections
import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import bpe, mixing, pii, quality_rules
from lodestone.llm.common import Texts, Words

from .test_operators import PATTERNS, brute_components, encoder, valid

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        out.append(docs.collect())
        docs = spark.createDataFrame(out[-1], docs.schema)
    return out


def test_names_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "PII", "mixing sources", "byte-level BPE"]
    for rows in stages[:-1]:
        assert list(rows[0].asDict()) == COLUMNS


def test_quality_stage(spark, stages):
    before, after = stages[:2]
    model = quality_rules.train(spark.createDataFrame(before), spark.read.parquet(f"{SF}/labels.parquet"))
    want = set()
    for r in before:
        raw = (r.text or "").encode()
        t = Texts(np.array([0]), np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        lines = quality_rules.Lines(t, Words(t))
        size = [len(x) for x in r.text.split("\n") if x.strip("\x20\t\n\x0b\f\r")] if r.text else []
        y = quality_rules.viterbi(lines.x, model)
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        grams = collections.Counter(zip(words, words[1:], words[2:]))
        repeated = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
        share = sum(s for s, c in zip(size, y) if c == quality_rules.CONTENT) / max(1, sum(size))
        if words and 100 * len(repeated) <= 50 * len(words) and share >= quality_rules.MIN_CONTENT:
            want.add(r.doc_id)
    assert {r.doc_id for r in after} == want
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r.doc_id for r in before if quality.get(r.doc_id) == 1]
    assert sum(i in want for i in good) >= 0.97 * len(good)
    assert not [i for i in want if quality.get(i) == 0]


def test_near_duplicates_stage(stages):
    before, after = stages[1:3]
    found = brute_components([(r.doc_id, r.text) for r in before])
    assert sorted(after) == sorted(r for r in before if found[r.doc_id][1] == r.doc_id)
    assert len(after) < len(before)


def test_pii_stage(spark, stages):
    before, after = stages[2:4]
    new = {r.doc_id: r for r in after}
    model = pii.train(spark.createDataFrame(before))
    listed = {r.doc_id: r.spans for r in pii.digests(spark.createDataFrame(before), model).collect()}
    assert len(new) == len(before) and any(listed.values())
    for r in before:
        spans = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in listed[r.doc_id].split(",") if x))
        want, at = "", 0
        for a, b, k in spans:
            if a >= at:
                want += r.text[at:a] + f"[{k.upper()}]"
            at = max(at, b)
        assert new[r.doc_id].text == want + r.text[at:] and (new[r.doc_id].lang, new[r.doc_id].source) == (r.lang, r.source)
        for kind, p in PATTERNS.items():
            assert not [m for m in re.finditer(p, new[r.doc_id].text) if valid(kind, m[0])]


def test_mixing_stage(spark, stages):
    before, after = stages[3:5]
    times = collections.Counter(r.doc_id for r in after)
    assert set(after) <= set(before) and max(times.values()) <= mixing.MAX_EPOCHS
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert 0.4 * words(before) < words(after) <= mixing.FRACTION * words(before)
    want = collections.Counter(r.doc_id for r in mixing.mix(spark.createDataFrame(before)).collect())
    assert times == want


def test_bpe_stage_and_the_whole(spark, stages):
    enc, _, _ = encoder()
    want = collections.Counter()
    for r in stages[4]:
        ids = enc.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    rows = lambda got: collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got)
    assert rows(stages[5]) == want == rows(corpus_pipeline.run(spark, SF).collect())


def test_stages_take_empty_and_odd_tables(spark, stages):
    odd = spark.createDataFrame([(1, None, None, None, None), (1, "", "en", "s", 0), (None, "x " * 80, "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:]:
            docs = stage(spark, docs, SF)
            docs.collect()
    assert bpe.production(odd.limit(0)).count() == 0
