"""Rules over one printed line, or a line and the one after it, as Column expressions.

The patterns avoid look-around and use explicit classes, so they mean the same in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import english_declared, held, reads_as_item, runs, stated

# White space, strokes, glyphs and look-alike letters of the rules.
WS = r"\t\n\x{B}\x{C}\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
STROKES = "—–―‒‐_─━-"
ARROWS = "→←↔⇒⇐⇔⟶⟵⟷⟹⟸⟺↦"
BULLET_GLYPHS = "•*−–—-"
IDEOGRAPHS = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFD}"
FULL_WIDTH = r"\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{20000}-\x{3FFFD}"
RTL_LETTERS = r"\x{590}-\x{8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}"
ATTACHING = "!\"'),.:;?]}،؛؟۔’”"
CYRILLIC = r"\x{400}-\x{4FF}"
LATIN_FOR = ("АВЕКМНОРСТУХІЈЅаеорсухіјѕ", "ABEKMHOPCTYXIJSaeopcyxijs")
CYRILLIC_FOR = ("ABEKMHOPCTYXaeopcyx", "АВЕКМНОРСТУХаеорсух")
GLYPH_PREFIXES = ("glyph", "index", "cid", "gid")
CYRILLIC_LANGUAGES = ("ru", "uk", "be", "bg", "mk", "sr", "kk", "ky", "tg", "mn")

LIST = rf"^([•*−-]|[0-9]+[.)]|[A-Za-z][.)])[{WS}]"
MARKED = rf"^([0-9]+|[A-Za-z])[.)][{WS}]"
OPENS_BULLET = rf"^[{BULLET_GLYPHS}][{WS}]"
ARROW = rf"(?s)^[{WS}]*[−-]?[{ARROWS}].*[^{WS}]"
RULE_END = rf"(^|[{WS}])[{STROKES}]{{2,}}[{WS}]*$"
SECTION = rf"^([0-9]{{1,2}}(\.[0-9]{{1,2}})?)[{WS}]+\p{{Lu}}"
CHAPTER = r"^([Cc][Hh][Aa][Pp][Tt][Ee][Rr]) ([1-9][0-9]*|[IVXLCDMivxlcdm]+)([.:] *| [-–—] | )(.+)$"
CANONICAL = "^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
EXERCISE = r"(^|[^\p{L}])(practice|exercises?)([^\p{L}]|$)"
ENDNOTE = rf"^([A-Za-z0-9]{{1,4}}\.)[{WS}]+"
FOOTNOTE = rf"^([1-9][0-9]{{0,2}})[{WS}]"
GLYPH_NAME = r"^(\p{L}+)([0-9]+)$"
CITES_LEFT, CITES_RIGHT = r"(^|[^0-9A-Za-z_])[0-9]{1,3}$", r"^U\. S\. [0-9]{1,4}([^0-9A-Za-z_]|$)"
CLOSES_UP = r"\p{L}\p{N}_"


def collapsed(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WS}]", "")


def tokens(text: Column) -> Column:
    """What white space parts: the property holds ``WS`` and is asked once a character, where a class asks for each of its ranges."""
    return F.filter(F.split(text, r"\p{IsWhite_Space}+"), lambda t: t != "")


def is_typed_rule(text: Column) -> Column:
    """Two strokes or more, of nine kinds, and nothing else but white space."""
    return squeezed(text).rlike(f"^[{STROKES}]{{2,}}$")


def is_bullet_glyph(text: Column) -> Column:
    return F.trim(text).rlike(f"^[{BULLET_GLYPHS}]$")


def advances(text: Column) -> Column:
    """One for each character but white space, two for a full-width one."""
    return F.length(squeezed(text)) + held(squeezed(text), f"[{FULL_WIDTH}]")


def is_plus_bullet(text: Column) -> Column:
    return text.rlike(rf"^\+[{WS}]+(\p{{L}}{{2}}|[0-9]+%)") & reads_as_item(F.substring(text, 3, 1 << 30))


def section_number(text: Column) -> Column:
    """The number of one or two levels that opens a section title, as printed, or null."""
    number = F.regexp_extract(text, SECTION, 1)
    title = F.regexp_replace(text, rf"^[0-9.]+[{WS}]+", "")
    fits = (F.length(text) <= 120) & (held(title, r"\p{L}") >= 3) & ~number.rlike(r"(^|\.)0+(\.|$)")
    return F.when(text.rlike(SECTION) & fits, number)


def roman(value: Column) -> Column:
    """Value of a canonical roman numeral, or null."""
    v = F.upper(value)

    def count(s: str) -> Column:
        return (F.length(v) - F.length(F.replace(v, F.lit(s), F.lit("")))) / len(s)

    plain = sum((count(s) * n for s, n in (("M", 1000), ("D", 500), ("C", 100), ("L", 50), ("X", 10), ("V", 5), ("I", 1))), F.lit(0.0))
    less = sum((count(s) * 2 * n for s, n in (("IV", 1), ("IX", 1), ("XL", 10), ("XC", 10), ("CD", 100), ("CM", 100))), F.lit(0.0))
    return F.when((v != "") & v.rlike(CANONICAL), (plain - less).cast("int"))


def chapter_label(text: Column) -> Column:
    """(number, title, marker) of a ``Chapter N`` label, or null; the marker is of a roman numeral."""
    label = collapsed(text)
    numeral, title = F.regexp_extract(label, CHAPTER, 2), F.trim(F.regexp_extract(label, CHAPTER, 4))
    digits = numeral.rlike("^[0-9]+$")
    number = F.when(digits, numeral.try_cast("int")).otherwise(roman(numeral))
    found = F.struct(number.alias("number"), title.alias("title"), F.when(~digits, F.concat(F.lit("chapter "), F.lower(numeral))).alias("marker"))
    return F.when((F.length(text) <= 512) & label.rlike(CHAPTER) & number.isNotNull() & (title != ""), found)


def names_exercises(text: Column) -> Column:
    return F.lower(text).rlike(EXERCISE)


def endnote_marker(text: Column) -> Column:
    return F.when(text.rlike(ENDNOTE), F.regexp_extract(text, ENDNOTE, 1))


def footnote_number(text: Column) -> Column:
    """The number that opens a note's line: white space follows, and a letter somewhere."""
    return F.when(text.rlike(FOOTNOTE) & (held(text, r"\p{L}") > 0), F.regexp_extract(text, FOOTNOTE, 1).try_cast("int"))


def marker_kind(text: Column, whole: bool = False) -> Column:
    """``number`` or ``letter`` and the mark that ends it, or null; ``whole``: nothing follows."""
    pattern = r"^([0-9]+|[A-Za-z])([.)])" + ("$" if whole else f"[{WS}]")
    kind = F.when(F.regexp_extract(text, pattern, 1).rlike("^[0-9]"), "number").otherwise("letter")
    return F.when(text.rlike(pattern), F.concat(kind, F.regexp_extract(text, pattern, 2)))


def marked_value(text: Column) -> Column:
    """A number's value, or a letter's code."""
    token = F.regexp_extract(text, MARKED, 1)
    return F.when(text.rlike(MARKED), F.when(token.rlike("^[0-9]"), token.try_cast("bigint")).otherwise(F.ascii(F.lower(token)).cast("bigint")))


def page_label(text: Column) -> Column:
    value = stated(text)
    return F.when(F.length(value) <= 32, value)


def outline_title(text: Column, most: int = 512) -> Column:
    clean = collapsed(F.regexp_replace(text, r"[\x{1}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{FFFE}\x{FFFF}]", ""))
    return F.when((F.length(text) <= most * 4) & (F.length(clean) <= most) & clean.rlike(r"[\p{L}\p{N}]"), clean)


def normal_phrase(text: Column) -> Column:
    return F.lower(collapsed(text))


def percent(fraction: Column) -> Column:
    """A share as a percentage of two decimals."""
    hundredths = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction)) * 10_000 + 0.5).cast("bigint")
    return F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit("%"))


def is_index_glyph_name(name: Column) -> Column:
    prefix = F.regexp_extract(name, GLYPH_NAME, 1)
    low = F.lower(prefix)
    return name.rlike(GLYPH_NAME) & ~low.isin("u", "uni") & ((F.length(prefix) <= 2) | low.isin(*GLYPH_PREFIXES))


def nearly(a: Column, b: Column, one_letter_in: int) -> Column:
    allowed = F.greatest(F.lit(1), F.floor(F.least(F.length(a), F.length(b)) / one_letter_in).cast("int"))
    return (a == b) | ((F.abs(F.length(a) - F.length(b)) <= allowed) & (F.levenshtein(a, b) <= allowed))


def reads_visual_order(text: Column) -> Column:
    """A bracket closes before any opens, and one opens."""
    steps = F.transform(runs(text, r"[()\[\]{}]"), lambda c: F.when(c.isin("(", "[", "{"), 1).otherwise(-1))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("least"))
    least = F.aggregate(steps, zero, lambda a, s: F.struct((a["sum"] + s).alias("sum"), F.least(a["least"], a["sum"] + s).alias("least")))["least"]
    return (least < 0) & text.rlike(r"[(\[{]")


def joined_ideographs(text: Column) -> Column:
    """Spaces between ideographs go."""
    return F.when(F.length(text) > 2, F.regexp_replace(text, f"(?<=[{IDEOGRAPHS}]) +(?=[{IDEOGRAPHS}])", "")).otherwise(text)


def latin_repaired(text: Column) -> Column:
    """Tokens with Cyrillic letters become Latin where every one of them has a Latin twin."""

    def repaired(token: Column) -> Column:
        mapped = F.translate(token, *LATIN_FOR)
        return F.when(mapped.rlike(f"[{CYRILLIC}]"), token).otherwise(mapped)

    return F.array_join(F.transform(F.split(text, " "), repaired), " ")


def cyrillic_repaired(text: Column) -> Column:
    """Tokens whose Latin letters all have Cyrillic twins become Cyrillic, if they are mixed, or capitals that are no numeral."""
    keys = CYRILLIC_FOR[0]

    def repaired(token: Column) -> Column:
        latin = F.regexp_replace(token, "[^A-Za-z]", "")
        mixed = token.rlike(f"[{CYRILLIC}]") | (latin.rlike("^[A-Z]+$") & ~latin.rlike("^[XCM]+$"))
        return F.when(latin.rlike(f"^[{keys}]+$") & mixed, F.translate(token, *CYRILLIC_FOR)).otherwise(token)

    return F.array_join(F.transform(F.split(text, " "), repaired), " ")


def repaired_script(text: Column, lang: Column) -> Column:
    cyrillic = F.element_at(F.split(F.lower(lang), "[-_]"), 1).isin(*CYRILLIC_LANGUAGES)
    return F.when(english_declared(lang), latin_repaired(text)).when(cyrillic, cyrillic_repaired(text)).otherwise(text)


# --- a line and the next ------------------------------------------------------------------------------


def last_of(text: Column) -> Column:
    """As much of a line's end as the rules of pairs read: four characters, or all where white space ends it."""
    end = F.substring(text, -4, 4)
    return F.when(end.rlike(rf"[^{WS}]\z"), end).otherwise(text)


def first_of(text: Column) -> Column:
    """As much of a line's beginning as the rules of pairs read: eleven characters, or all where white space opens it."""
    begin = F.substring(text, 1, 11)
    return F.when(begin.rlike(f"^[^{WS}]"), begin).otherwise(text)


def breaks_at_closed_en_dash(left: Column, right: Column) -> Column:
    return left.endswith("–") & left.rlike(rf"[{CLOSES_UP}]–\z") & right.rlike(f"^[{CLOSES_UP}]")


def breaks_at_closed_em_dash(left: Column, right: Column) -> Column:
    return left.endswith("—") & left.rlike(rf"[^{WS}\p{{Pd}}]—\z") & right.rlike(rf"^[{CLOSES_UP}\"'\p{{Pi}}]")


def wide_without_space(left: Column, right: Column) -> Column:
    return left.rlike(rf"[{FULL_WIDTH}][{WS}]*\z") & right.rlike(f"^[{WS}]*[{FULL_WIDTH}]")


def arabic_without_space(left: Column, right: Column) -> Column:
    """An attaching mark follows a right-to-left letter."""
    marks = ATTACHING.replace("]", r"\]")
    last = F.regexp_extract(left, rf"([{RTL_LETTERS}])[{WS}]*\z", 1)
    return last.rlike(r"\p{L}") & right.rlike(f"^[{WS}]*[{marks}]")


def continues_citation(left: Column, right: Column) -> Column:
    return right.startswith("U. S. ") & left.rlike(CITES_LEFT) & right.rlike(CITES_RIGHT)


def word_halves(left: Column, right: Column) -> tuple[Column, Column]:
    """The letters before a line's last hyphen, and those that open the next line."""
    return F.lower(F.regexp_extract(left, r"(\p{L}*)-\z", 1)), F.lower(F.regexp_extract(right, r"^(\p{L}*)", 1))


def join_operation(left: Column, right: Column, knows, of_word: tuple[Column, Column] | None = None) -> Column:
    """space, concatenate or remove (the hyphen), for a line and the next.

    ``knows`` tells whether the document's words hold a word, ``of_word`` gives ``word_halves`` where they are known; the order of the cases is the rule.  Of its first three none
    holds where the line ends in a printed ASCII character: such an end, the commonest, is asked for before them.
    """
    prefix, suffix = of_word or word_halves(left, right)
    vouched = knows(F.concat(prefix, suffix)) & ~knows(F.concat(prefix, F.lit("-"), suffix))
    halves = (F.length(prefix) >= 2) & (F.length(suffix) >= 2)
    hyphen = F.when(vouched & (right.rlike(r"^\p{Ll}") | halves), "remove").otherwise("concatenate")
    return (
        F.when(left.endswith("-"), hyphen)
        .when(F.ascii(F.substring(left, -1, 1)).between(33, 126), "space")
        .when(left.endswith("­"), "remove")
        .when(wide_without_space(left, right) | arabic_without_space(left, right), "concatenate")
        .when(breaks_at_closed_en_dash(left, right) | breaks_at_closed_em_dash(left, right), "concatenate")
        .otherwise("space")
    )
