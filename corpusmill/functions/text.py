"""Text functions on columns. White space is Unicode's and U+001C to U+001F unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]+"
#: The punctuation that the Indic word splitter sets apart (ASCII's but the backslash, dandas and script marks).
INDIC_MARKS = r"""([!"#$%&'()*+,\-./:;<=>?@\[\]^_`{|}~\x{964}\x{965}\x{aaf1}\x{aaf0}\x{abeb}\x{abec}\x{abed}\x{abee}\x{abef}\x{1c7e}\x{1c7f}])"""
#: The marks that character scoring sets apart from a word, and the words and marks of the quality signals.
ASCII_MARK = r"[!-/:-@\[-`{-~]"
QE_TOKEN = r"(?U)[\p{L}\p{N}]+(?:[-'/][\p{L}\p{N}]+)*|[^\s\x1c-\x1f\p{L}\p{N}_]"


def trim_space(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def sanitize(s: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(s, SPACE, " "))


def strip_tokens(s: Column) -> Column:
    """Words at white space, without non-alphanumeric ASCII edges, lower-cased, empty ones left out; null has none."""
    bare = F.transform(F.split(F.coalesce(s, F.lit("")), SPACE), lambda t: F.lower(F.regexp_replace(t, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")))
    return F.filter(bare, lambda t: t != "")


def unique_tokens(s: Column) -> Column:
    """strip_tokens at their first occurrence."""
    return F.array_distinct(strip_tokens(s))


def ascii_chars(s: Column) -> Column:
    return F.length(F.regexp_replace(s, r"[^\x00-\x7f]", ""))


def first_segment_rest(s: Column) -> Column:
    """What follows the first empty line, or all."""
    at = F.instr(s, "\n\n")
    return trim_space(F.when(at > 0, F.substr(s, at + 2)).otherwise(s))


def last_segment(s: Column) -> Column:
    """What follows the last empty line, or all."""
    return trim_space(F.element_at(F.split(s, "\n\n"), -1))


def qe_tokens(s: Column) -> Column:
    """Words (joined by single - ' /) and single marks; underscores are dropped."""
    return F.regexp_extract_all(s, F.lit(QE_TOKEN), 0)


def indic_tokens(s: Column) -> Column:
    """Marks set apart, numbers with separators kept whole; the empty text is one empty token."""
    apart = F.regexp_replace(F.translate(trim_space(s), "\t", " "), INDIC_MARKS, " $1 ")
    one = F.trim(F.regexp_replace(apart, "[ ]+", " "))
    for _ in range(2):  # neighbours share a digit, so twice
        one = F.regexp_replace(one, r"([0-9]) ([,.:/]) ([0-9])", "$1$2$3")
    return F.split(one, " ", -1)


def tokens_13a(s: Column) -> Column:
    """The 13a tokenisation of machine-translation scoring, lower-cased. Its patterns and their order."""
    out = F.lower(F.regexp_replace(F.replace(F.replace(s, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit("")), "\n", " "))
    for mark, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(mark), F.lit(char))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    out = F.regexp_replace(out, r"([{-~\[-` -&(-+:-@/])", " $1 ")
    out = F.regexp_replace(out, r"([^0-9])([.,])", "$1 $2 ")
    out = F.regexp_replace(out, r"([.,])([^0-9])", " $1 $2")
    out = F.regexp_replace(out, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(out, SPACE), lambda t: t != "")


def words_and_marks(s: Column) -> Column:
    """Words at white space; an ASCII mark at a word's end, else one at its start, stands apart."""

    def apart(w: Column) -> Column:
        head, tail = F.substr(w, F.lit(1), F.length(w) - 1), F.right(w, F.lit(1))
        one = F.length(w) == 1
        return F.when(one, F.array(w)).when(tail.rlike(ASCII_MARK), F.array(head, tail)).when(w.rlike("^" + ASCII_MARK), F.array(F.left(w, F.lit(1)), F.substr(w, F.lit(2)))).otherwise(F.array(w))

    words = F.filter(F.split(s, SPACE), lambda w: w != "")
    return F.flatten(F.transform(words, apart))


def ascii_words(s: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), 0)


def ngrams(tokens: Column, n: int, join: str = " ") -> Column:
    """All runs of n neighbours, joined."""
    last = F.coalesce(F.size(tokens), F.lit(0)) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), join)))


def char_ngrams(s: Column, n: int) -> Column:
    """All runs of n characters, white space left out."""
    bare = F.regexp_replace(s, SPACE, "")
    last = F.coalesce(F.length(bare), F.lit(0)) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(bare, i, F.lit(n))))


def column_index(ref: Column) -> Column:
    """0-based column of a spreadsheet reference like AB12."""
    letters = F.filter(F.split(F.upper(F.regexp_extract(ref, r"^[A-Za-z]+", 0)), ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1


def language_of_file(name: Column) -> Column:
    """The language in names like 'English - Karbi Training Data 2026.xlsx', spaces as underscores; all-lower names get a capital."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"(?i)^English\s*-\s*", ""), r"(?i)\s*Training\s*Data.*$", "")
    bare = F.regexp_replace(trim_space(bare), SPACE, "_")
    return F.when((bare == F.lower(bare)) & (bare != F.upper(bare)), F.concat(F.upper(F.substr(bare, F.lit(1), F.lit(1))), F.substr(bare, F.lit(2)))).otherwise(bare)


def json_object_in(s: Column) -> Column:
    """The outermost {...} of a reply if it parses, else null."""
    chunk = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(F.when(chunk != "", chunk)).isNotNull(), chunk)
