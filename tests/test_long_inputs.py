"""Texts of a megabyte of one kind end soon, and give what their short forms give."""

import re
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import answer as A
from lodestone.sources import loaders as L

N = 500_000


def first(spark, text, f):
    began = time.time()
    got = spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("x")).first().x
    assert time.time() - began < 30
    return got


def test_redaction_of_long_names(spark):
    assert first(spark, "a@" + "b." * N + "c", X.redact) == "[email]"
    assert first(spark, "a@" + "b." * N + ". x", X.redact) == "[email].. x"
    assert first(spark, "a." * N + " x", X.redact) == "a." * N + " x"
    assert first(spark, "see m@b-c.d, a@b and x.y+z@p_q.r.s!", X.redact) == "see [email], a@b and [email]!"


def test_marks_of_many_numbers(spark):
    mark = "x [" + "1, " * N + "2] y"
    assert first(spark, mark, X.cited_numbers) == [1, 2]
    assert first(spark, mark, X.without_markers) == "x y"
    assert first(spark, "a" + " " * N + "b", X.without_markers) == "a" + " " * N + "b"
    assert first(spark, "[1" + " " * N + "x [1" + " " * N + ",3]", X.cited_numbers) == [1, 3]
    assert first(spark, "see  [1] [2 ,3]" + " " * N + ".", lambda c: X.repair_marks(c, F.lit(2))) == "see [1] [2]."
    assert first(spark, "one [1] two \t[2,3][ 4 ] [5", X.without_markers) == "one two[ 4 ] [5"


HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")


@pytest.mark.parametrize("line", ["# a", "## a b ##", "###### x#y # #", "####### no", "#no", "# ", "#  ", "# #", "# ###", "# x #  #", "#\ta\t#\t", "# a\\#", " # a", "#", "", "# é ü ##  "])
def test_headings_as_by_one_pattern(spark, line):
    want = HEADING.match(line)
    got = spark.createDataFrame([("s", line + "\nbody", "none")], "source string, text string, title string").transform(L.markdown_sections).first()
    assert got.heading == ((want[2].strip() if want else "") or "none")
    assert got.text == ("body" if want else (line.strip() + "\nbody").strip())


def test_headings_of_many_blanks(spark):
    text = "# a" + " " * 1_000_000 + "b" + " " * N + "#" * N + "\nbody\n" + "#" * 6 + "\t" * N + "c #" + " " * N + "x\nend"
    began = time.time()
    got = spark.createDataFrame([("s", text, "t")], "source string, text string, title string").transform(L.markdown_sections).orderBy("section_no").collect()
    assert time.time() - began < 30
    assert [r.text for r in got] == ["body", "end"] and got[0].heading == "a" + " " * 1_000_000 + "b" and got[1].heading.endswith(" > c #" + " " * N + "x")


def test_blanks_within_front_matter_and_answers(spark):
    fm = first(spark, "---\nk: 'v" + " " * N + "w'\nq: " + '"' * N + "x" + '"' * N + "\n---\nbody", L.front_matter)
    assert fm.meta == {"k": "v" + " " * N + "w", "q": "x"} and fm.body == "body"
    hits = spark.createDataFrame([(1, "cats", 1, "A." + "\t" * N + "cats are here")], "qid long, question string, rank int, text string")
    began = time.time()
    assert A.extractive(hits.select("qid", "question"), hits).first().answer == "cats are here [1]"
    assert time.time() - began < 30
