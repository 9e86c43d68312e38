"""Column functions over text: counts, search terms, tidying, redaction, snippets and citation marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def stripped(text: Column) -> Column:
    """Without white space at both ends, in one pass; a pattern for the end would try every blank of the text."""
    return F.btrim(text, F.lit(P.BLANKS))


def heading_name(line: Column) -> Column:
    """What a heading line says: without its first and last number signs and the blanks about them; one of number signs is a sign."""
    rest = stripped(F.substr(line, F.length(F.regexp_extract(line, P.HEADING, 1)) + 1))
    bare = F.rtrim(rest, F.lit("#"))
    return F.when((bare == "") & (rest != ""), "#").otherwise(F.rtrim(bare, F.lit(P.BLANKS)))


def token_count(text: Column) -> Column:
    """Words of any script and single other characters."""
    return F.regexp_count(blank(text), F.lit(P.TOKEN))


def fold(word: Column) -> Column:
    """Plural folding: -ies to -y, a final -s dropped unless -ss, -us or -is."""
    n = F.length(word)
    ies = (n > 4) & word.endswith("ies")
    s = (n > 3) & word.endswith("s") & ~(word.endswith("ss") | word.endswith("us") | word.endswith("is"))
    return F.when(ies, F.concat(F.left(word, n - 3), F.lit("y"))).when(s, F.left(word, n - 1)).otherwise(word)


def folded(word: str) -> str:
    """fold of one word, for code that looks at each different word once."""
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "us", "is")) else word


def search_terms(text: Column) -> Column:
    """Lower-cased words without stop words, plurals folded; in order, repeats kept."""
    words = F.regexp_extract_all(F.lower(blank(text)), F.lit(P.TERM), F.lit(0))
    return F.transform(F.filter(words, lambda w: ~w.isin(P.STOPWORDS)), fold)


def tidy(text: Column) -> Column:
    """Runs of blanks to one, lines stripped, at most one empty line, ends stripped."""
    t = F.regexp_replace(blank(text), "\r\n?", "\n")
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.regexp_replace(t, " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), "^[ \n]+|[ \n]+$", "")


def redact(text: Column) -> Column:
    """E-mail addresses, then phone numbers, then long numbers."""
    t = F.regexp_replace(blank(text), P.EMAIL, "[email]")
    return F.regexp_replace(F.regexp_replace(t, P.PHONE, "[phone]"), P.LONG_NUMBER, "[number]")


def snippet(text: Column, width: int = 180) -> Column:
    flat = F.trim(F.regexp_replace(blank(text), "\\s+", " "))
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(width - 3))), F.lit("...")))


def neutralise(text: Column) -> Column:
    """Angle brackets of passage and question tags become parentheses, those inside such a tag too."""
    tag = "(?i)</?\\s*(?:passages|passage|question)\\b[^>]*>"
    hits = F.transform(F.regexp_extract_all(text, F.lit(tag), F.lit(0)), lambda t: F.translate(t, "<>", "()"))
    between = F.split(text, tag, -1)
    return F.array_join(F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.get(hits, i), F.lit("")))), "")


def escape(text: Column) -> Column:
    out = blank(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def without_markers(text: Column) -> Column:
    return F.regexp_replace(blank(text), "(?<!\\s)\\s*+" + P.MARKER, "")


def _numbers(group: Column) -> Column:
    """The numbers of a mark's inside, as strings."""
    return F.split(F.regexp_replace(group, "\\s", ""), ",")


def cited_numbers(text: Column) -> Column:
    """Distinct numbers of [n] and [n, m] in order of first use; a number that no int holds is left out."""
    groups = F.regexp_extract_all(blank(text), F.lit(P.MARKER), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.transform(_numbers(g), lambda n: n.try_cast("int"))))
    return F.array_distinct(F.filter(numbers, lambda n: n.isNotNull()))


def repair_marks(answer: Column, n_passages: Column) -> Column:
    """Numbers that point at no passage go, with their brackets if none is left; blanks before them are tidied."""
    groups = F.regexp_extract_all(blank(answer), F.lit(P.MARKER), F.lit(1))

    def mark(group: Column) -> Column:
        good = F.filter(_numbers(group), lambda n: n.try_cast("int").between(1, n_passages))
        return F.when(F.size(good) > 0, F.concat(F.lit("["), F.array_join(good, ", "), F.lit("]"))).otherwise("")

    marks = F.transform(groups, mark)
    text = F.array_join(F.transform(F.split(blank(answer), P.MARKER, -1), lambda p, i: F.concat(p, F.coalesce(F.get(marks, i), F.lit("")))), "")
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]{2,}", " "), "[ \t]+([.,;:!?])", "$1")
    return stripped(text)


def default_title(path: Column) -> Column:
    """A file's stem with blanks for _ and -, the first letter upper, the rest lower case."""
    stem = F.regexp_replace(F.regexp_replace(path, "^.*/", ""), "\\.[^.]*$", "")
    t = F.trim(F.regexp_replace(stem, "[_-]", " "))
    return F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substr(t, F.lit(2))))


def order_key(source: Column, *numbers: Column) -> Column:
    """Corpus order as one string: path components, then section and piece numbers."""
    parts = [F.replace(source, F.lit("/"), F.lit("\u0001"))] + [F.lpad(n.cast("string"), 10, "0") for n in numbers]
    return F.concat_ws("\u0001", *parts)
