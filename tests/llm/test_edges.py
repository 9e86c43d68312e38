"""Null ids, repeated rows and columns whose names clash with the operators' own."""

import hashlib

import pytest

import corpus_pipeline
from lodestone.llm import bpe, debruijn, jaccard, mixing, pii, quality_classifier, quality_rules, substring, warc

CLASHING = ("_t", "_email", "_id", "row", "epoch", "tokens", "nth", "rank", "n", "a", "b", "bucket", "ranges", "rep", "component_id", "quality")
LONG = " ".join(f"w{i * i % 991}" for i in range(400))
ROWS = [(1, LONG, "en", "s1"), (1, LONG, "en", "s1"), (2, None, None, None), (None, LONG, "en", "s1"), (None, "mail a@b.co now", None, "s1"), (None, None, None, None), (3, LONG + " end", "de", ""), (4, " \n", "es", "s2")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, s, len(t or ""), *["z"] * len(CLASHING)) for i, t, lang, s in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)).cache()


def by_id(df, *cols):
    return sorted(([r[c] for c in ("doc_id", *cols)] for r in df.collect()), key=repr)


def test_null_ids_link_with_nothing(odd):
    got = by_id(jaccard.join(odd), "n_shingles", "component_id")
    assert got == sorted([[1, 396, 1]] * 2 + [[3, 397, 1], [2, 0, 2], [4, 0, 4], [None, 396, None], [None, 1, None], [None, 0, None]], key=repr)
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    assert by_id(kept, "text") == sorted([[1, LONG], [2, None], [4, " \n"], [None, LONG], [None, "mail a@b.co now"], [None, None]], key=repr)


def test_null_ids_keep_their_texts(odd):
    whole = lambda t: hashlib.sha256(t.encode()).hexdigest()
    none = {tuple(r) for r in by_id(substring.dedup(odd), "n_removed", "kept_sha256") if r[0] is None}
    assert none == {(None, 0, whole(LONG)), (None, 0, whole("mail a@b.co now")), (None, 0, whole(""))}
    none = {tuple(r) for r in by_id(debruijn.dedup(odd), "n_removed", "kept_sha256") if r[0] is None}
    assert none == {(None, 0, whole(LONG)), (None, 0, whole("mail a@b.co now")), (None, 0, whole(""))}
    assert [r for r in by_id(debruijn.dedup(odd), "n_removed") if r[0] == 3] == [[3, 400]]


def test_null_ids_pass_through(odd):
    ids = sorted((r[0] for r in ROWS), key=repr)
    blank = quality_classifier.fit([])
    for out in (quality_rules.judge(odd, quality_rules.DEFAULT), quality_classifier.score(odd, blank), bpe.production(odd), pii.digests(odd, pii.DEFAULT)):
        assert sorted((r.doc_id for r in out.select("doc_id").collect()), key=repr) == ids


def test_stages_keep_columns(odd):
    assert pii.redact(odd, pii.DEFAULT).columns == odd.columns
    texts = sorted((r.text for r in pii.redact(odd, pii.DEFAULT).select("text").collect()), key=repr)
    assert texts == sorted((None if t is None else t.replace("a@b.co", "[EMAIL]") for _, t, _, _ in ROWS), key=repr)
    assert quality_rules.keep(odd, quality_rules.DEFAULT).columns == odd.columns
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules"


def test_mixed_documents_are_the_rows_that_mix_takes(odd):
    rows = odd.select("doc_id", "text", "lang", "source")
    for options in ({}, {"fraction": 2.0}, {"fraction": 1.0, "seed": 3}):
        got = mixing.mixed_documents(odd, **options)
        assert got.columns == odd.columns
        want = sorted(((r.doc_id, r.lang, r.source, r.tokens) for r in mixing.mix(rows, **options).collect()), key=repr)
        assert sorted(((r.doc_id, r.lang or "", r.source or "", len((r.text or "").split())) for r in got.collect()), key=repr) == want
    # two epochs of everything that has words: each row comes twice
    texts = [r.text for r in mixing.mixed_documents(odd, fraction=2.0).select("text").collect()]
    assert sorted(texts) == sorted(2 * [t for _, t, _, _ in ROWS if t and t.strip()])


def test_empty_tables(odd):
    none, blank = odd.limit(0), quality_classifier.fit([])
    for out in (bpe.production(none), substring.dedup(none), quality_rules.judge(none, quality_rules.DEFAULT), pii.digests(none, pii.DEFAULT), pii.redact(none, pii.DEFAULT), debruijn.dedup(none), quality_classifier.score(none, blank), jaccard.one_of_each(none)):
        assert out.collect() == []


def test_a_doc_id_with_several_texts_counts_with_the_least(spark):
    rows = [(7, "b " + LONG), (7, "a " + LONG), (7, None), (8, LONG), (5, "c " + LONG), (5, "d " + LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert by_id(jaccard.join(df), "n_shingles", "component_id") == [[5, 397, 5]] * 2 + [[7, 0, 7]] * 3 + [[8, 396, 5]]
    assert by_id(jaccard.one_of_each(df), "text") == [[5, "c " + LONG], [7, None]]
    empty = hashlib.sha256(b"").hexdigest()
    assert by_id(debruijn.dedup(df), "n_words", "n_removed", "kept_sha256")[2:5] == [[7, 0, 0, empty]] * 3
    assert [r[:2] for r in by_id(debruijn.dedup(df), "n_removed")][-1] == [8, 400]
    assert by_id(substring.dedup(df), "n_bytes", "kept_sha256")[2:5] == [[7, 0, empty]] * 3


def test_warc_without_page_ids(spark):
    big = "<p>" + "x" * 200
    pages = spark.createDataFrame([(2, "u", big), (None, "v", big), (1, "w", big), (None, None, None), (None, "u", "y" * 150)], "page_id long, url string, html string")
    got = warc.read(warc.normalise(warc.write(warc.with_roles(pages)))).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=repr) == sorted(
        [(1, 203, "response", None), (2, 203, "revisit", 1), (None, 203, "revisit", 1), (None, 0, "response", None), (None, 150, "response", None)], key=repr
    )


def test_trees_do_not_see_what_labels_them(spark):
    keyed = [(i, f'x token = "{hashlib.sha1(str(i).encode()).hexdigest()}" y {"%016d" % (i * 7919)} end') for i in range(200)]
    model = pii.train(spark.createDataFrame(keyed, "doc_id long, text string"))
    used = {t[0] for t in model["trees"]} | {side[0] for t in model["trees"] for side in t[2:] if side[2] != side[3]}
    assert pii.FEATURES.index("keyword") not in used


def test_unique_payloads_stay_out_of_the_join(spark, monkeypatch):
    """Pages whose payload comes once are never shuffled, even if repeated digests are too many to be sent."""
    monkeypatch.setattr(warc, "HOT_SHARE", 1)  # no digest is hot
    rows = [(i, f"u{i}", ("same %d " % (i % 4) if i < 40 else f"own {i} ") * 20) for i in range(400)] + [(900, "v", "x"), (901, "v", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = warc.with_roles(pages)
        got = {r.page_id: (r.record_type, r.refers_to, r.payload is None) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: ("revisit", i % 4, True) if 4 <= i < 40 else ("response", None, False) for i, _, _ in rows}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2 and "LeftAnti" in plan
