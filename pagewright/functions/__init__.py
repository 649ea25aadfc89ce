"""Text rules as Column expressions: scripts, markers, values, sentence shapes.

Every rule is a built-in expression, so it runs inside code generation next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ranges of the rules.
LATIN = "\\x{0}-\\x{2AF}\\x{1D00}-\\x{1DBF}\\x{1E00}-\\x{1EFF}\\x{2C60}-\\x{2C7F}\\x{A720}-\\x{A7FF}\\x{FB00}-\\x{FB06}"
RIGHT_TO_LEFT = "\\x{590}-\\x{8FF}\\x{FB1D}-\\x{FDFF}\\x{FE70}-\\x{FEFF}"
PLACEHOLDERS = (
    "unknown", "unknown author", "no author", "untitled", "no title", "none", "not available",
    "n/a", "na", "null", "nil", "author", "title", "subject", "keywords", "default",
)


def runs(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def named(value: Column, function) -> Column:
    """``function`` of the value, which is worked out once: a plain column is written out wherever it is read, in every round of a lambda as well, once a filter moves below it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def held(text: Column, pattern: str) -> Column:
    """Characters of the pattern's class in the text."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def letter_words(text: Column, least: int = 2) -> Column:
    return runs(text, f"\\p{{L}}{{{least},}}")


def vocabulary_words(text: Column) -> Column:
    return F.transform(runs(text, "[\\p{L}-]+"), F.lower)


def latin_letters(text: Column) -> Column:
    return held(F.regexp_replace(text, "[^\\p{L}]", ""), f"[{LATIN}]")


def right_to_left_letters(text: Column) -> Column:
    return held(F.regexp_replace(text, "[^\\p{L}]", ""), f"[{RIGHT_TO_LEFT}]")


def foreign_letters(text: Column) -> Column:
    return held(F.regexp_replace(text, "[^\\p{L}]", ""), f"[^{LATIN}]")


def reads_right_to_left(text: Column) -> Column:
    return (right_to_left_letters(text) > 0) & (right_to_left_letters(text) >= latin_letters(text))


def reads_as_sentence(text: Column) -> Column:
    return F.size(letter_words(text)) >= 4


def reads_as_item(text: Column) -> Column:
    """Letters in words of three or more are at least 35% of the text."""
    letters = F.aggregate(letter_words(text, 3), F.lit(0), lambda a, w: a + F.length(w))
    return (letters > 0) & (letters * 100 >= F.length(text) * 35)


def is_web_address(word: Column) -> Column:
    return word.contains("://") | F.lower(word).startswith("www.") | word.rlike("[?&][A-Za-z_][A-Za-z0-9_.-]*=")


def states_an_equation(text: Column) -> Column:
    words = F.filter(F.split(text, "[ \\t\\r\\n]+"), lambda w: (w != "") & ~is_web_address(w))
    return F.array_join(words, " ").rlike("=[^=]*[^= ][^=]*$") & (F.size(words) <= 12)


def is_caption(text: Column) -> Column:
    return text.rlike("^(Figure|Table)[ \\t]+[0-9]")


def ends_broken(text: Column) -> Column:
    return text.rlike("[\\p{L}\\p{N}][-\\x{AD}]$")


def is_value(text: Column) -> Column:
    stripped = F.regexp_replace(text, "^[ ()*\\x{2020}\\x{2021}]+|[ ()*\\x{2020}\\x{2021}]+$", "")
    dashes = stripped.rlike("^[-\\x{2013}\\x{2014}]+$")
    return (stripped != "") & (dashes | (stripped.rlike("\\p{N}") & (held(stripped, "\\p{L}") <= 1)))


def is_compound_name(word: Column) -> Column:
    return word.rlike("^(\\p{Lu}\\p{Ll}+){2,}$")


def is_folio(text: Column) -> Column:
    return text.rlike("^[0-9]+(-[0-9]+)?$")


def english_declared(lang: Column) -> Column:
    return F.element_at(F.split(F.lower(lang), "[-_]"), 1).isin("en", "eng")


def stated(value: Column, most: int = 1000) -> Column:
    """A metadata value after clean-up, or null where nothing is stated."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(value, "[\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{FFFE}\\x{FFFF}]", ""), "[ \\t\\r\\n\\x{A0}]+", " "))
    return F.when((F.length(value) <= most * 4) & (F.length(clean) <= most) & clean.rlike("[\\p{L}\\p{N}]") & ~F.lower(clean).isin(*PLACEHOLDERS), clean)


def marker_family(text: Column) -> Column:
    """bullet, letter, number, or null where no list marker opens the text."""
    plus = text.rlike("^\\+[ \\t]+(\\p{L}{2}|[0-9]+%)") & reads_as_item(F.substring(text, 3, 1 << 20))
    bullet = text.rlike("^[\\x{2022}*+-][ \\t]") & ~text.rlike("^\\*[ \\t]+\\*") & (~text.startswith("+") | plus)
    return F.when(bullet, "bullet").when(text.rlike("^[A-Za-z][.)][ \\t]+"), "letter").when(text.rlike("^[0-9]{1,3}[.)][ \\t]+"), "number")


def marker_value(text: Column) -> Column:
    family = marker_family(text)
    letter = F.ascii(F.lower(F.substring(text, 1, 1))) - 96
    return F.when(family == "letter", letter).when(family == "number", F.regexp_extract(text, "^([0-9]{1,3})", 1).try_cast("int"))


def xml_text(text: Column) -> Column:
    """XML 1.0 text: characters it can't hold go, five are escaped."""
    out = F.regexp_replace(text, "[\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{FFFE}\\x{FFFF}]", "")
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out
