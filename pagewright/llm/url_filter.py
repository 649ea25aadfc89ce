"""URL filters: domain rules first, then logistic regression on hashed character n-grams.

All work on pages is DataFrame expressions: the url is cut into host and path, the rules
are a ``CASE`` sorted by length, and the model's score folds literal weights over the
hashed n-grams of host and path.  The features of the small labelled table come from the
same expressions, so training and scoring can't drift apart; the gradient steps run on
the driver over that table alone, whose size is fixed here.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule,
and the model's verdict on no features (its bias).  Repeated rows each give a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (verdict, rule): a rule is a host and a path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

N_BUCKETS = 4096
GRAM = 4

#: Stems of the small labelled table: words that unwanted hosts are made of, alone and joined, and ordinary names.
BAD_WORDS = ("spam", "adult", "casino", "poker", "slots", "bets", "betting", "lotto", "pills", "viagra", "cheap", "free", "bonus", "win", "track", "tracker", "ads", "adserver", "click", "porn", "xxx", "sex", "cams", "tube", "loan", "crack", "warez", "keygen", "replica", "farm")
GOOD_NAMES = (
    "therou", "ththra", "erinan", "news-daily", "city-library", "open-science", "garden-notes", "recipes", "weather", "university", "museum", "history",
    "thanin", "ondere", "maths-club", "read-more", "health-info", "school", "einkeit", "achung", "lesaux", "queteau", "anento", "osmente", "radio", "theatre",
    "farmers-market", "free-software", "music-hall", "travel-guide", "bookshop", "letters", "philosophy", "archive", "physics", "kitchen", "photo-walks", "the-reader",
)
#: Common syllables; ordinary names are made of them as well.
SYLLABLES = ("the", "tion", "ing", "er", "an", "re", "on", "in", "ed", "st", "en", "ble", "ou", "ha", "ly", "sh", "ti", "ter", "men", "lich", "eau", "que", "ado", "ver")
BAD_PATHS = ("/buy-now/pills", "/casino/bonus", "/adult/video", "/track/click", "/bets/free")
GOOD_PATHS = ("/en/12", "/de/7.html", "/fr/825", "/es/93/", "/article/history", "/docs/index.html", "/blog/2020/notes")
#: Joins of two bad words that are left out of the table, so that whole hosts are judged by what they are made of.
LEFT_OUT = {("spam", "farm"), ("adult", "xxx"), ("casino", "win"), ("ads", "track"), ("cheap", "pills"), ("free", "bets")}


def bad_names() -> list[str]:
    """Every word with four others after it, in a fixed order, and alone."""
    n = len(BAD_WORDS)
    joins = [(w, BAD_WORDS[(i + step) % n]) for i, w in enumerate(BAD_WORDS) for step in (1, 7, 12, 19)]
    return [*BAD_WORDS, *(f"{a}-{b}" for a, b in joins if (a, b) not in LEFT_OUT)]


def good_names() -> list[str]:
    """The ordinary names, and each syllable with others after it, in a fixed order."""
    n = len(SYLLABLES)
    made = [SYLLABLES[i] + SYLLABLES[(i + step) % n] + (SYLLABLES[(i + 3 * step) % n] if step % 2 else "") for i in range(n) for step in (1, 2, 5, 7, 10, 13)]
    return [*GOOD_NAMES, *made]


def training_rows() -> list[tuple[str, int]]:
    """The labelled table: names under prefixes, endings and paths, in a fixed order; most are good, as most pages are."""
    rows = []
    for label, names, paths, forms in ((1, bad_names(), BAD_PATHS + GOOD_PATHS, 1), (0, good_names(), GOOD_PATHS, 2)):
        for i, name in enumerate(names):
            for j in range(forms):
                k = i + j
                prefix, ending = ("", "www.", "blog.", "m.")[k % 4], ("example.com", "example.org", "example.net", "com")[(k // 4 + j) % 4]
                rows.append((f"http{'s' * (k % 2)}://{prefix}{name}.{ending}{paths[(i + 3 * j) % len(paths)]}", label))
    return rows


def split_url(df: DataFrame, url: str = "__url") -> DataFrame:
    """Adds host and path.  Host: after the first ``://`` up to ``/ ? #``; path: from there up to ``? #``."""
    at = f"instr({url}, '://')"
    return (
        df.withColumn("__rest", F.expr(f"CASE WHEN {at} > 0 THEN substring({url}, {at} + 3) ELSE '' END"))
        .withColumn("__whole", F.substring_index(F.substring_index("__rest", "?", 1), "#", 1))
        .withColumn("host", ascii_lower(F.substring_index("__whole", "/", 1)))
        .withColumn("path", F.expr("CASE WHEN instr(__whole, '/') > 0 THEN substring(__whole, instr(__whole, '/')) ELSE '' END"))
    )


def grams(host: str = "host", path: str = "path") -> Column:
    """Distinct buckets of the character n-grams of ``^host`` and ``path$``."""

    def of(marked: str) -> str:
        return f"transform(sequence(1, greatest(1, length({marked}) - {GRAM - 1})), __i -> substring({marked}, __i, {GRAM}))"

    marked_host, marked_path = f"concat('^', {host}, '/')", f"concat('|', {path}, '$')"
    return F.expr(f"array_distinct(transform(concat({of(marked_host)}, {of(marked_path)}), __g -> cast(crc32(cast(__g AS binary)) % {N_BUCKETS} AS int)))")


def fit(spark: SparkSession, rows: list[tuple[str, int]] | None = None, epochs: int = 200, rate: float = 0.5, decay: float = 1e-4) -> tuple[float, list[float]]:
    """Bias and weights by full-batch gradient steps over the labelled table (a few hundred rows at most)."""
    rows = training_rows() if rows is None else rows
    values = ", ".join("('" + url.replace("'", "''") + f"', {label})" for url, label in rows)
    feats = split_url(spark.sql(f"SELECT * FROM VALUES {values} AS t(__url, label)")).select("label", grams().alias("g")).collect()
    examples = [(list(r["g"]), float(r["label"])) for r in feats]
    weights, bias = [0.0] * N_BUCKETS, 0.0
    scale = [1 / math.sqrt(max(1, len(g))) for g, _ in examples]
    for _ in range(epochs):
        step, step_bias = {}, 0.0
        for (g, y), s in zip(examples, scale, strict=True):
            error = 1 / (1 + math.exp(-(bias + s * sum(weights[b] for b in g)))) - y
            step_bias += error
            for b in g:
                step[b] = step.get(b, 0.0) + error * s
        bias -= rate * step_bias / len(examples)
        for b, d in step.items():
            weights[b] -= rate * (20 * d / len(examples) + decay * weights[b])
    return bias, weights


def rule_column(rules=RULES) -> Column:
    """The longest fitting rule, else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, rest = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def judge(pages: DataFrame, rules=RULES, model: tuple[float, list[float]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's probability of block) for every row of pages."""
    bias, weights = model or fit(pages.sparkSession)
    literal = F.split(F.lit(",".join(f"{w:.6f}" for w in weights)), ",").cast("array<double>")
    df = split_url(pages.select("page_id", F.col("url").alias("__url"))).withColumn("rule", rule_column(rules)).withColumn("__g", grams())
    total = F.aggregate("__g", F.lit(0.0), lambda acc, b: acc + F.get(literal, b))
    score = 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.greatest(F.lit(1), F.size("__g"))))))
    verdict_of = F.lit(None).cast("string")
    for verdict, rule in rules:
        verdict_of = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(verdict_of)
    df = df.withColumn("score", F.round(score, 6))
    return df.select("page_id", "host", "path", "rule", F.coalesce(verdict_of, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
