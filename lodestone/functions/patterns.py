"""Patterns, word lists and texts whose values are fixed by the results that they must give (fixed values)."""

#: White space of line and word splitting.
SPACE = " \\t\\n\\r\\x0b\\f"
#: The same as characters.
BLANKS = " \t\n\r\x0b\f"
#: Word characters of any script, one meaning in Java and RE2.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
TERM = r"[a-z0-9]+(?:['.][a-z0-9]+)*"
STOPWORDS = (
    "a an and are as at be been but by can could do does for from had has have how i if in into is it its "
    "may me my of on or our should so than that the their them then there these they this to up us was we "
    "what when where which who whom why will with would you your"
).split()
#: A match starts at the first of a run of its characters, or where the last one ended, so that a long run is read once.
#: Groups are repeated possessively (++, *+), which Java does in a loop; a plain repeat of a group is a recursion a round.
EMAIL = r"(?:\G|(?<![\p{L}\p{N}_.+-]))[\p{L}\p{N}_.+-]++@[\p{L}\p{N}_-]++(?:\.[\p{L}\p{N}_-]++)++"
PHONE = r"(?<![\p{L}\p{N}_])(?:\+?\d[\d\s().-]{7,}\d)(?![\p{L}\p{N}_])"
LONG_NUMBER = r"\b\d{5,}\b"
SENTENCE = r"""(?<=[.!?])\s+(?=[A-Z0-9("'])"""
MARKER = r"\[(\d++(?:\s*+,\s*+\d++)*+)\]"
HEADING = r"^(#{1,6})\s[\s\S]"
QUESTION_KEYS = ("question", "q", "title", "prompt")
ANSWER_KEYS = ("answer", "a", "response", "body", "text")
LIST_KEYS = ("faqs", "faq", "questions", "items", "entries")
SUFFIXES = ("md", "markdown", "txt", "json", "jsonl", "html", "htm", "pdf")
#: Tags of web pages: whose content is skipped, that are headings, and that begin and end a line.
HIDDEN_TAGS = ("script", "style", "nav", "footer", "header", "noscript")
HEAD_TAGS = ("h1", "h2", "h3", "h4")
LINE_TAGS = ("p", "li", "div", "tr", "br", "section", "article", "dd", "dt")
LINK_STARTS = ("http://", "https://", "mailto:")
