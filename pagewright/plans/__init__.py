"""Decision tables: evidence in, one verdict out, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_finding(english: Column, judged: Column, lonely: Column, misread: Column, words: Column, numeric: Column, number: Column, tokens: Column) -> Column:
    """few_english, misread or null, from a page's word counts."""
    known, weighed = english - lonely, judged - lonely
    heavy = numeric * 5 >= tokens
    cut = F.when(heavy, misread * 10 >= words).otherwise(misread * 1000 >= words * 85)
    both = ~heavy & (known * 10 < weighed * 6) & (misread * 1000 >= words * 75)
    usable = (weighed >= 20) & (number * 5 < tokens)
    return F.when(~usable, None).when(known * 2 < weighed, "few_english").when(cut | both, "misread")


def ink_finding(rows: Column, fraction: Column, english: Column) -> Column:
    return F.when((rows >= 7) & (fraction >= 0.75) & (english < rows), "missing_text")


def short_reading(counts, foreign: Column, letters: Column) -> Column:
    """A reading too short for the word test, in mixed scripts and mostly no English; ``counts`` gives columns by name."""
    known, weighed = counts("english") - counts("lonely"), counts("english") + counts("damaged") - counts("lonely")
    short = (weighed >= 5) & (weighed < 20) & (counts("number_tokens") * 5 < counts("tokens"))
    return short & (foreign >= 5) & (foreign * 10 >= letters) & (known * 3 < weighed * 2)


def two_short_readings(reading, layer) -> Column:
    """Two readings, each short and mostly no English, that are enough to judge together."""

    def unread(counts) -> tuple[Column, Column]:
        known, weighed = counts("english") - counts("lonely"), counts("english") + counts("damaged") - counts("lonely")
        return (weighed >= 5) & (weighed < 20) & (counts("number_tokens") * 5 < counts("tokens")) & (known * 2 < weighed), weighed

    (a, n), (b, m) = unread(reading), unread(layer)
    return a & b & (n + m >= 20)


def reads_better(misread: Column, words: Column, before_misread: Column, before_words: Column) -> Column:
    """A smaller share of misread words."""
    return (words > 0) & (misread * F.greatest(F.lit(1), before_words) < before_misread * words)


def sparse_layer(english: Column) -> Column:
    return english < 32


def cells_were_read(cells: Column, transcribed: Column) -> Column:
    return (cells < 9) | (transcribed * 2 >= cells)


def indicates_loss(rows: Column, fraction: Column) -> Column:
    return (rows >= 8) & (fraction >= 0.2)


def bands_are_kept(banded_ink: Column, banded_words: Column, first_ink: Column, first_words: Column) -> Column:
    return (banded_ink < first_ink) & (banded_words >= first_words)


# Recognition policies, and what each does with a text layer over a page-sized image.
POLICIES = {"never": "keep", "automatic": "judge", "automatic_including": "retry", "automatic_keeping": "keep", "always": "retry"}


def recognition_plan(policy: Column, evidence) -> Column:
    """keep, verify, compare or replace, for a page's evidence (columns by name) under a policy."""
    rule = F.create_map(*[F.lit(x) for pair in POLICIES.items() for x in pair])[policy]
    automatic = policy.startswith("automatic")
    needs = (policy == "always") | (automatic & (evidence("lacks_text") | ((rule == "retry") & evidence("image_backed")) | ((rule == "judge") & evidence("finding").isNotNull())))
    return (
        F.when(evidence("requires_image"), "keep")
        .when(~needs, F.when((rule == "judge") & evidence("sparse"), "verify").otherwise("keep"))
        .when((rule == "judge") & F.coalesce(evidence("finding") == "misread", F.lit(False)), "compare")
        .otherwise("replace")
    )


def recognition_resolve(plan: Column, outcome: Column, evidence) -> tuple[Column, Column]:
    """(what becomes of the page, warnings) once recognition ended: read, empty, failed, or none was made."""
    none = F.array().cast("array<string>")
    made = (plan != "keep") & (outcome != "none")
    crops, finding = evidence("drawn"), evidence("finding")

    def layer(said: str) -> Column:
        of_finding = F.when(finding.isNotNull(), F.array(F.concat(F.lit("layer:"), finding, F.lit(f":{said}")))).otherwise(none)
        verified = F.array(F.lit(f"layer:unread:{said}")) if said == "implausible" else none
        return F.when(plan == "verify", verified).otherwise(of_finding)

    bad = evidence("reading_bad") | ((plan == "verify") & evidence("sparse") & evidence("beside_bad"))
    empty = outcome == "empty"
    refused = bad & ((plan == "replace") | (evidence("sparse") & ~empty))
    keeps = plan.isin("compare", "verify")
    lost = F.when(evidence("uncovered"), F.array(F.lit("incomplete"))).otherwise(none)
    cases = (
        (~made, "kept_layer", F.when(finding.isNotNull(), F.array(F.concat(F.lit("layer:"), finding, F.lit(":retained")))).otherwise(none)),
        ((outcome == "failed") & keeps, "kept_layer", F.concat(layer("kept_over"), F.array(F.lit("failed:layer")))),
        ((outcome == "failed") & crops, "kept_as_extracted", F.concat(layer("kept_as_extracted"), F.array(F.lit("failed:drawn")))),
        (outcome == "failed", "page_image", F.concat(layer("page_image"), F.array(F.lit("failed:page")))),
        (empty & crops & (plan != "verify"), "kept_as_extracted", F.concat(layer("kept_as_extracted"), F.array(F.lit("failed:drawn")))),
        (refused, "page_image", F.concat(F.array(F.lit("reading_implausible")), layer("implausible"))),
        (plan == "verify", "kept_layer", none),
        ((plan == "compare") & ~(~bad & evidence("better")), "kept_layer", layer("kept_over")),
        (empty, "page_image", F.concat(layer("page_image"), F.array(F.lit("failed:no_text")))),
    )
    disposition, warnings = F.lit("replaced"), F.concat(layer("replaced"), F.array(F.lit("ocr")), lost)
    for condition, kept, said in reversed(cases):
        disposition, warnings = F.when(condition, kept).otherwise(disposition), F.when(condition, said).otherwise(warnings)
    kept_text = disposition.isin("kept_layer", "kept_as_extracted")
    encoding = F.when(evidence("damaged_encoding"), F.array(F.concat(F.lit("encoding:"), F.when(kept_text, "retained").otherwise(disposition)))).otherwise(none)
    unverified = ((plan == "keep") | keeps) & ~evidence("requires_image") & evidence("image_backed") & (disposition == "kept_layer")
    return disposition, F.concat(encoding, F.when(unverified, F.array(F.lit("unverified"))).otherwise(none), warnings)


def image_class(f, role: Column, from_image: Column) -> Column:
    """What an image shows, by its shares of flat, edge, ground and coloured pixels (columns by name)."""
    flat, hard, soft, ground, few = f("flat"), f("hard"), f("soft"), f("ground"), f("colours") <= 4096
    ratio = F.when(hard + soft > 0, hard / (hard + soft)).otherwise(0.0)
    typed = (ground >= 0.20) & (f("chroma") < 0.10) & (soft < 0.15) & (ratio >= 0.40) & (hard >= 0.01)
    text = F.when(role != "page", "line art or chart").when(~from_image, "text page (born-digital)").when((f("bilevel") >= 0.95) & few, "text page (bilevel scan)").otherwise("text page (tonal scan)")
    return (
        F.when(typed, text)
        .when(few & (flat >= 0.30), "line art or chart")
        .when((flat <= 0.12) & (soft >= 0.30) & (ground <= 0.15), "photograph")
        .when((soft >= 0.20) & (ground <= 0.55) & (flat <= 0.55), "continuous-tone art")
        .when((ratio >= 0.40) & (flat >= 0.45), "line art or chart")
        .otherwise("mixed")
    )


def lossy_is_safe(kind: Column, f, role: Column) -> Column:
    tone = kind.isin("photograph", "text page (tonal scan)") | ((kind == "continuous-tone art") & ((role == "page") | (f("flat") < 0.30))) | ((kind == "mixed") & (role == "page"))
    return (f("chroma") < 0.02) | tone


def is_paper(red: Column, green: Column, blue: Column) -> Column:
    """A ground whose tint may go: neutral, or light, warm and faint."""
    warm = (red >= green) & (green >= blue) & (red - blue <= 64) & (red * 299 + green * 587 + blue * 114 >= 160_000)
    return (F.greatest(F.abs(red - green), F.abs(green - blue)) <= 4) | warm


def is_monochrome(red: Column, green: Column, blue: Column, off_tint: Column, largest: Column) -> Column:
    return is_paper(red, green, blue) & (off_tint <= 0.001) & (largest < 64)


def lacks_readable_text(visible: Column, replacements: Column, drawn: Column, damaged: Column, chars: Column) -> Column:
    """No visible text, many replacement characters, writing that is drawn, or an unreadable encoding."""
    return (visible == 0) | (replacements > F.greatest(F.lit(2), F.floor(chars / 50))) | drawn | damaged


def is_navigation(entries: Column, distinct_titles: Column, pages: Column, depth: Column) -> Column:
    return (entries >= 2) & (entries <= 10_000) & (entries <= 3 * pages) & (depth < 4) & (distinct_titles * 2 > entries)
