import json

import pytest
from pyspark.sql import functions as F

from lodestone import extra_queries  # noqa: F401  (its SQL is a part of that of stored_queries)
from lodestone import stored_queries as SQ
from lodestone.functions import text as X
from lodestone.operators import chunking as C
from lodestone.plans import tables as T
from lodestone.sources import loaders as L


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).first().o


def test_tokens_and_terms(spark):
    assert one(spark, X.token_count, "Étion_1, a-b!") == 6
    assert one(spark, X.token_count, None) == 0
    got = one(spark, X.search_terms, "The policies' studies dies class bus U.S. forms is")
    assert got == ["policy", "study", "die", "class", "bus", "u.s", "form"]


def test_redaction_and_snippets(spark):
    assert one(spark, X.redact, "a@b.co +1 (555) 123-4567; 12345, 1234") == "[email] [phone]; [number], 1234"
    assert one(spark, X.snippet, "x" * 180) == "x" * 180
    assert one(spark, X.snippet, "x" * 181) == "x" * 177 + "..."
    assert one(spark, X.neutralise, "a </passage x=<y> b <p>") == "a (/passage x=(y) b <p>"
    assert one(spark, X.cited_numbers, "[2, 1] [2] [99999999999]") == [2, 1]
    fixed = spark.createDataFrame([("See [1, 9] and [7] .",)], "t string").select(X.repair_marks(F.col("t"), F.lit(3)).alias("o")).first().o
    assert fixed == "See [1] and."


def test_front_matter(spark):
    got = one(spark, L.front_matter, "---\nTitle: 'A: b'\nbad\n---\nbody\n")
    assert got.meta == {"title": "A: b"} and got.body == "body\n"
    assert one(spark, L.front_matter, "---\na: b\n").body == "---\na: b\n"


def test_markdown_sections(spark):
    text = "top\n# A\nx\n### B##\n```\n# no\n```\n## C\ny\n# D\n\n"
    rows = L.markdown_sections(spark.createDataFrame([("s", text, "T")], "source string, text string, title string")).orderBy("section_no").collect()
    assert [(r.heading, r.text) for r in rows] == [("T", "top"), ("A", "x"), ("A > B", "```\n# no\n```"), ("A > C", "y")]


def test_html():
    title, body = L.page_text('<title>T &amp;</title><nav>n</nav></nav><h2>H</h2><p>a  b<ul><li>x<li>y</ul><p><a href="https://e.x">l</a><script>"</p>"</script>')
    assert title == "T &" and body == "## H\n\na b\n\n- x\n\n- y\n\nl (https://e.x)"


def test_faq(spark):
    docs = [("a", json.dumps({"title": "T", "faqs": [{"Q": "q?", "A": "a"}, {"office": {"hours": ["9", "10"]}}]})), ("b", '{"prompt": "p", "response": ["x", "y"]}\n\n{"q": "z", "body": "w"}')]
    rows = L.faq_sections(spark.createDataFrame(docs, "source string, text string")).orderBy("source", "section_no").collect()
    assert [(r.heading, r.text, r.kind) for r in rows] == [("q?", "a", "faq"), ("T", "office hours: 9\noffice hours: 10", "section"), ("p", "x\ny", "faq"), ("z", "w", "faq")]


def test_load_folder_and_gold(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "my_file-a.md").write_text("---\nupdated: 2024-01-01\n---\n# H\nx")
    (tmp_path / "README.md").write_text("no")
    (tmp_path / "f.json").write_text('[{"q": "a", "a": "b"}]')
    (tmp_path / "p.html").write_text("<title>W</title><p>hi")
    rows = {r.source: r for r in L.load_folder(spark, str(tmp_path)).collect()}
    assert set(rows) == {"sub/my_file-a.md", "f.json", "p.html"}
    assert rows["sub/my_file-a.md"].title == "My file a" and rows["sub/my_file-a.md"].updated == "2024-01-01" and rows["p.html"].title == "W"
    (tmp_path / "g.jsonl").write_text('{"id": "1", "question": "q", "relevant": [{"source": "s", "heading": "h"}]}\n\n{"id": "2", "question": "r"}\n')
    with pytest.raises(ValueError, match="2"):
        L.gold_set(spark, str(tmp_path / "g.jsonl"))


def test_manifest(spark):
    e = spark.createDataFrame([(1, "p", "a", None, None, None), (2, "p", "b", "o", 3, "2024-01-01")], "entry_no int, path string, title string, owner string, refresh_days int, updated string")
    assert [tuple(r) for r in L.source_manifest(e).collect()] == [("p", "b", "o", 3, "2024-01-01")]


def test_packing():
    assert C.pack("a b\n\nc d", 10, 2) == ["a b\n\nc d"]
    text = "\n\n".join(f"w{i} x{i} y{i}" for i in range(8))
    chunks = C.pack(text, 8, 2)
    assert all(C.count_tokens(c) <= 8 for c in chunks)
    for a, b in zip(chunks, chunks[1:]):
        assert b.startswith(C.tail(a, 2) + "\n\n") and a.endswith(C.tail(a, 2))
    # pieces of an over-long sentence come before the short one that waits
    assert C.units("Ab c. " + "D " * 6 + ". E f.", 4) == ["D D D D", "D D .", "Ab c. E f."][:2] + ["Ab c.", "E f."]
    assert C.units("-" * 9, 4) == ["----", "----", "-"]
    assert C.faq_chunks("q", "one two three", 3) == ["Q: q\nA: one two", "Q: q\nA: three"]
    with pytest.raises(ValueError):
        C.pack("a", 5, 5)


def test_ids_and_distinct(spark):
    s = spark.createDataFrame([("a/b", "", "x", "section", 0), ("a/b", "", "x", "section", 1), ("a", "", "x", "section", 0)], "source string, heading string, text string, kind string, section_no int")
    c = C.distinct_chunks(C.with_ids(C.chunk_sections(s)))
    assert sorted((r.source, r.section_no) for r in c.collect()) == [("a", 0), ("a/b", 0)]
    assert C.describe(c).first().sources == 2


def test_files_from_a_table(spark):
    """Files as rows go by their suffix, whatever its case; unknown ones, PDF and read-me files are left out; null is empty."""
    files = [
        ("a/note_one.MD", "---\ntitle: N\nupdated: 2024-01-01\n---\nlead\n# H\nbody"), ("b/page-two.htm", "<h1>T</h1><p>x</p>"), ("c.txt", "just text"), ("d.json", '{"Q": "q?", "A": "a"}'),
        ("e.jsonl", '{"Q": "1?", "A": "x"}\n{"prompt": "2?", "response": "y"}'), ("f.css", "p {}"), ("README.md", "# No"), ("g.pdf", "%PDF"), ("h.txt", None), ("nosuffix", "t"),
    ]
    got = {(r.source, r.section_no): (r.title, r.updated, r.heading, r.text, r.kind) for r in L.load_files(spark.createDataFrame(files, "source string, text string")).collect()}
    assert got == {
        ("a/note_one.MD", 0): ("N", "2024-01-01", "N", "lead", "section"), ("a/note_one.MD", 1): ("N", "2024-01-01", "H", "body", "section"),
        ("b/page-two.htm", 0): ("Page two", "", "T", "x", "section"), ("c.txt", 0): ("C", "", "C", "just text", "section"), ("d.json", 0): ("D", "", "q?", "a", "faq"),
        ("e.jsonl", 0): ("E", "", "1?", "x", "faq"), ("e.jsonl", 1): ("E", "", "2?", "y", "faq"),
    }
    assert L.load_files(spark.createDataFrame(files[:0], "source string, text string")).collect() == []


def test_references_without_their_semicolon(spark):
    pages = spark.createDataFrame([("a", "<title>x &amp y&amp</title><p>&lt b &copy; &amp; &noname; &#65; &#66 &ampx; AT&T & &</p>"), ("b", None)], "url string, html string")
    got = {r.source: (r.title, r.text) for r in L.html_documents(pages, closed=True).collect()}
    assert got == {"a": ("x &amp y&amp", "&lt b © & &noname; A &#66 &ampx; AT&T & &"), "b": ("", "")}
    browsers = {r.source: (r.title, r.text) for r in L.html_documents(pages).collect()}
    assert browsers["a"] == ("x & y&", "< b © & &noname; A B &x; AT&T & &")


def test_markdown_texts_are_dealt_once(spark):
    docs = spark.createDataFrame([("s", "a\r\n# A\n## B\nx\n  ```\n# c\n```\n### C ##\n\ny\n# D", "T")], "source string, text string, title string")
    got = L.markdown_sections(docs)
    assert [(r.heading, r.text) for r in got.orderBy("section_no").collect()] == [("T", "a"), ("A > B", "x\n```\n# c\n```"), ("A > B > C", "y")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 1


def test_folder_files_are_of_few_documents(spark, tmp_path, monkeypatch):
    spark.range(300).selectExpr("id AS doc_id", "'t' AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(SQ, "_place", lambda spark, name: f"{tmp_path}/{name}")
    assert SQ.folder_load(spark, str(tmp_path)).count() == 301
    per_file = spark.read.text(f"{tmp_path}/folder/plain").filter("value LIKE '# Doc%'").groupBy("_metadata.file_path").count()
    assert max(r["count"] for r in per_file.collect()) <= SQ.PER_FILE < 300


def test_one_row_group_is_dealt(spark, tmp_path, monkeypatch):
    spark.range(40000).selectExpr("id", "md5(cast(id AS string)) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(T, "SPLIT_BYTES", 0)  # as a file larger than a split
    rows = T.table(spark, str(tmp_path), "documents").selectExpr("spark_partition_id() AS p").distinct().count()
    assert rows >= spark.sparkContext.defaultParallelism
