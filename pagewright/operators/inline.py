"""Styled text as an array of runs (text, style, href), and what is done to its ends, its links and its markup.

Styles are bits; a run with an href is a link's text.  All of it is expressions over the array, in the row that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import xml_text

# Style bits, and the widths of deferred link targets.
ITALIC, BOLD, UNDERLINE, SUPERSCRIPT, SUBSCRIPT = 1, 2, 4, 8, 16
PAGE_WIDTH, NOTE_WIDTH = 48, 128
#: What is trimmed.
SPACE = " \t\r\n"
#: What XML text can't hold as it is.
NOT_PLAIN = "[&<>\"'\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{FFFE}\\x{FFFF}]"


def has(style: Column, bit: int) -> Column:
    return style.bitwiseAND(F.lit(bit)) != 0


def plain_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def wholly_bold(runs: Column) -> Column:
    """Every run that shows something is bold; links aren't asked."""
    return F.forall(runs, lambda r: r["href"].isNotNull() | has(r["style"], BOLD) | ~r["text"].rlike(r"[^ \t\r\n]"))


def with_text(run: Column, text: Column) -> Column:
    return F.struct(text.alias("text"), run["style"].alias("style"), run["href"].alias("href"))


def ends_replaced(runs: Column, end: Column) -> Column:
    """The last character gives way to ``end``, in its run's style; a run that is left empty goes."""
    last = F.element_at(runs, -1)
    cut = F.substring(last["text"], F.lit(1), F.length(last["text"]) - 1)
    changed = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(with_text(last, F.concat(cut, end))))
    return F.when(F.size(runs) == 0, runs).otherwise(F.filter(changed, lambda r: r["text"] != ""))


def dropped(runs: Column, count: Column) -> Column:
    """Without the first characters; a link's remainder stays a link."""
    return cut_out(runs, count, F.lit(1 << 30))


def cut_out(runs: Column, start: Column, stop: Column) -> Column:
    """The characters from start up to stop, in their styles.

    One pass finds the first and the last run that is kept, and where they are cut; no run is copied in it.
    """
    kind = "struct<at:int,i:int,first:int,begin:int,last:int,end:int>"

    def step(bounds: Column):
        def found(s: Column, r: Column) -> Column:
            end = s["at"] + F.length(r["text"])
            begin, until = F.greatest(bounds["start"], s["at"]), F.least(bounds["stop"], end)
            kept = begin < until
            opens = kept & (s["first"] < 0)
            return F.struct(
                end.alias("at"), (s["i"] + 1).alias("i"), F.when(opens, s["i"]).otherwise(s["first"]).alias("first"), F.when(opens, begin - s["at"]).otherwise(s["begin"]).alias("begin"),
                F.when(kept, s["i"]).otherwise(s["last"]).alias("last"), F.when(kept, until - s["at"]).otherwise(s["end"]).alias("end"),
            )

        return found

    def parts(b: Column) -> Column:
        held = F.slice(runs, b["first"] + 1, b["last"] - b["first"] + 1)

        def part(r: Column, i: Column) -> Column:
            skipped = F.when(i == 0, b["begin"]).otherwise(0)
            until = F.when(i == b["last"] - b["first"], b["end"]).otherwise(F.length(r["text"]))
            return F.when((skipped == 0) & (until == F.length(r["text"])), r).otherwise(with_text(r, F.substring(r["text"], skipped + 1, until - skipped)))

        return F.when(b["first"] < 0, F.slice(runs, 1, 0)).otherwise(F.transform(held, part))

    # the bounds, and then the places, are named once, so no run works them out again
    zero = F.lit(0)
    bounds = F.array(F.struct(start.alias("start"), stop.alias("stop")))
    begun = F.struct(zero.alias("at"), zero.alias("i"), F.lit(-1).alias("first"), zero.alias("begin"), zero.alias("last"), zero.alias("end")).cast(kind)
    places = F.transform(bounds, lambda b: F.aggregate(runs, begun, step(b)))
    return F.filter(F.get(F.transform(places, parts), zero), lambda r: r["text"] != "")


def trimmed(runs: Column) -> Column:
    """Without white space at both ends, whatever runs it is in."""

    def cut(text: Column) -> Column:
        lead = F.length(text) - F.length(F.ltrim(text, F.lit(SPACE)))
        return cut_out(runs, lead, F.length(F.rtrim(text, F.lit(SPACE))))

    return F.get(F.transform(F.array(plain_text(runs)), cut), F.lit(0))


def divided_at(runs: Column, count: Column) -> Column:
    """Whether the text may be divided after ``count`` characters: inside it, and not inside a link."""

    def step(s: Column, r: Column) -> Column:
        end = s["at"] + F.length(r["text"])
        return F.struct(end.alias("at"), (s["inside"] | (r["href"].isNotNull() & (s["at"] < count) & (count < end))).alias("inside"))

    inside = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside")), step, lambda s: s["inside"])
    return (count > 0) & (count < F.length(plain_text(runs))) & ~inside


def links_merged(runs: Column) -> Column:
    """Neighbouring links of one target become one, with white space between them."""
    kind = "array<struct<text:string,style:int,href:string>>"

    def step(out: Column, r: Column) -> Column:
        n = F.size(out)
        last, gap = F.element_at(out, -1), F.try_element_at(out, F.lit(-2))
        alike = (n > 0) & r["href"].isNotNull() & last["href"].eqNullSafe(r["href"])
        across = (n > 1) & r["href"].isNotNull() & last["href"].isNull() & ~last["text"].rlike(r"[^ \t\r\n]") & gap["href"].eqNullSafe(r["href"])
        joined = lambda keep, text, like: F.concat(F.slice(out, F.lit(1), n - keep), F.array(with_text(like, text)))
        grown = F.when(alike, joined(1, F.concat(last["text"], r["text"]), last)).when(across, joined(2, F.concat(gap["text"], last["text"], r["text"]), gap)).otherwise(F.concat(out, F.array(r)))
        return F.when(n == 0, F.array(r)).otherwise(grown).cast(kind)

    return F.aggregate(runs, F.array().cast(kind), step)


def href(kind: Column, target: Column) -> Column:
    """An outer address as it is, a page's or note's as a token of fixed width that is resolved when the book is whole."""
    page = F.concat(F.lit("page-"), target)
    note = F.concat(F.lit("note:"), xml_text(target), F.lit(":"))
    wide = lambda token, width: F.when(F.length(token) >= width, token).otherwise(F.rpad(token, width, "-"))
    return F.when(kind == "page", wide(page, PAGE_WIDTH)).when(kind == "note", wide(note, NOTE_WIDTH)).otherwise(xml_text(target))


def markup(runs: Column) -> Column:
    """XHTML of the runs: emphasis inside strength inside underline, scripts and links around them."""

    tags = [(ITALIC, "em"), (BOLD, "strong"), (UNDERLINE, "u"), (SUPERSCRIPT, "sup"), (SUBSCRIPT, "sub")]
    styles = [[tag for bit, tag in tags if style & bit and not (bit == SUBSCRIPT and style & SUPERSCRIPT)] for style in range(2 * SUBSCRIPT)]
    opening = F.array(*[F.lit("".join(f"<{tag}>" for tag in reversed(inner))) for inner in styles])
    closing = F.array(*[F.lit("".join(f"</{tag}>" for tag in inner)) for inner in styles])

    def said(text: Column) -> Column:  # most texts hold nothing to escape
        return F.when(text.rlike(NOT_PLAIN), xml_text(text)).otherwise(text)

    def one(r: Column) -> Column:
        style = r["style"].bitwiseAND(F.lit(2 * SUBSCRIPT - 1))
        out = F.concat(F.get(opening, style), said(r["text"]), F.get(closing, style))
        return F.when(r["href"].isNotNull(), F.concat(F.lit('<a href="'), said(r["href"]), F.lit('">'), out, F.lit("</a>"))).otherwise(out)

    return F.array_join(F.transform(runs, one), "")


def block_markup(kind: Column, payload: Column, level: Column, ident: Column, rtl: Column) -> Column:
    """A block's element; right-to-left text says so."""
    way = F.when(rtl, ' dir="rtl"').otherwise("")

    def element(name: str, inner: str = "") -> Column:
        begin, end = (f"<{inner}>", f"</{inner}>") if inner else ("", "")
        return F.concat(F.lit(f"<{name}"), way, F.lit(">" + begin), payload, F.lit(f"{end}</{name}>\n"))

    tag = F.concat(F.lit("h"), level.cast("string"))
    heading = F.concat(F.lit("<"), tag, F.lit(' id="'), xml_text(ident), F.lit('"'), way, F.lit(">"), payload, F.lit("</"), tag, F.lit(">\n"))
    return F.when(kind == "heading", heading).when(kind == "aside", element("aside", "p")).when(kind == "quotation", element("blockquote", "p")).when(kind == "preformatted", element("pre")).when(kind == "listItem", element("li")).otherwise(element("p"))
