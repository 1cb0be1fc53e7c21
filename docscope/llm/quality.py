"""Quality rules: divergence of a document's histograms from its language's, in DataFrame functions only.

Two histograms are compared with the references of the document's language by Jensen-Shannon distance: character
classes, and common words. The references are means over all documents of the language that pass the base rules
and are long enough. Short documents pass unless the base rules reject them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
PUNCTUATION = r"[.,;:!?'\"()\-]"
#: Common words of English, French, Spanish and German, of any case; words that languages share are one bin.
COMMON = (
    "the of and to in that is for "
    "de la le et les des en que "
    "el y los del "
    "der die und den von zu das"
).split()
CHAR_BINS = ("c_lower", "c_upper", "c_digit", "c_space", "c_punct", "c_symbol", "c_wide")
WORD_BINS = tuple(f"w_{i}" for i in range(len(COMMON) + 1))
TOTALS = {"c_total": CHAR_BINS, "w_total": WORD_BINS}
WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
MIN_JUDGED_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 50, 0.22, 0.24
#: Few words make a histogram noisy: both limits are wider by this over the root of the number of words.
SLACK = 0.6


def base_features(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``__words`` and the base counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    d = docs.select("*", split.alias("__words"), lines.alias("__lines"))
    d = d.withColumn("__each", F.transform("__words", lambda w: F.xxhash64(w)))
    n = F.size("__words")
    # Windows by the hash of their words' hashes. Each array that a lambda refers to is referred to twice at
    # least, so that it is a column of its own and not evaluated for each element.
    following = lambda i: [F.get("__each", i + k) for k in range(1, window)]
    hashes = F.slice(F.transform("__each", lambda x, i: F.xxhash64(x, *following(i))), F.lit(1), n - (window - 1))
    d = d.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__hashes": F.when(n > window, hashes),
        }
    )
    twice = F.size("__hashes") > F.size(F.array_distinct("__hashes"))
    pairs = F.array_sort(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("__sorted", F.when(twice, pairs))
    same = lambda s, k: F.get("__sorted", k)["h"] == s["h"]
    found = F.transform("__sorted", lambda s, k: F.when(same(s, k + 1) | same(s, k - 1), s["i"]))
    d = d.withColumn("__at", F.array_sort(F.filter(found, lambda i: i.isNotNull())))
    new = F.transform("__at", lambda p, k: F.least(F.lit(window), F.coalesce(F.get("__at", k + 1) - p, F.lit(window))))
    covered = F.aggregate(new, F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return d.drop("__lines", "__each", "__hashes", "__sorted", "__at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def histograms(d: DataFrame) -> DataFrame:
    """Counts by character class (``c_``) and common word (``w_``; the last is all other words), without the text.

    Only common words leave their row. All words of a row meet in one task before the shuffle, so what is
    shuffled is a row of counts for each document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    counts = {
        "__row": F.monotonically_increasing_id(),
        "__n": F.length(text).cast("long"),
        "__common": F.filter(F.transform("__words", F.lower), lambda w: w.isin(COMMON)),
        "c_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "c_digit": F.regexp_count(text, F.lit(r"\d")),
        "c_punct": F.regexp_count(text, F.lit(PUNCTUATION)),
        "c_symbol": F.col("n_symbols"),
        "c_wide": F.octet_length(text),
    }
    d = d.withColumns(counts).drop("text", "__words")
    own = [c for c in d.columns if c not in ("__row", "__common")]
    d = d.select("__row", *own, F.explode_outer("__common").alias("__word"))
    found = [F.count_if(F.col("__word") == c).alias(w) for w, c in zip(WORD_BINS, COMMON, strict=False)]
    d = d.groupBy("__row").agg(*(F.first(c).alias(c) for c in own), *found)
    d = d.withColumns({"c_space": F.col("__n") - F.col("word_chars"), "c_wide": F.col("c_wide") - F.col("__n")})
    known = sum((F.col(w) for w in WORD_BINS[1:-1]), F.col(WORD_BINS[0]))
    rest = F.col("__n") - sum((F.col(c) for c in CHAR_BINS[2:]), F.col(CHAR_BINS[1]))
    d = d.withColumns({"c_lower": F.greatest(rest, F.lit(0)).cast("long"), WORD_BINS[-1]: F.col("n_words") - known})
    totals = {t: sum((F.col(b) for b in bins[1:]), F.col(bins[0])) for t, bins in TOTALS.items()}
    return d.withColumns(totals).drop("__row", "__n")


def shares(total: str) -> list[Column]:
    return [F.col(b) / F.greatest(F.col(total), F.lit(1)) for b in TOTALS[total]]


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance: the square root of the divergence in bits, 0 to 1."""

    def part(x: Column, y: Column) -> Column:
        to_mean = lambda a: F.when(a > 0, a * F.log2(2 * a / (x + y))).otherwise(0.0)
        return (to_mean(x) + to_mean(y)) / 2

    total = F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def references(features: DataFrame, min_words: int = MIN_JUDGED_WORDS) -> DataFrame:
    """lang, ref_chars, ref_words: mean histograms over every document of a language that passes the base rules."""
    fit = features.where(~base_failed() & (F.col("n_words") >= min_words)).groupBy("lang")
    named = [x for t, bins in TOTALS.items() for x in zip(bins, shares(t), strict=True)]
    means = fit.agg(*(F.avg(share).alias(b) for b, share in named))
    return means.select(F.col("lang").alias("__lang"), F.array(*CHAR_BINS).alias("ref_chars"), F.array(*WORD_BINS).alias("ref_words"))


def judge(
    docs: DataFrame,
    min_words: int = MIN_JUDGED_WORDS,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    slack: float = SLACK,
    broadcast_langs: int = 10_000,
) -> DataFrame:
    """doc_id, the base counts, base_failed, char_distance, word_distance and kept of every row of ``docs``.

    A null text counts as empty and fails the base rules. Null languages are a language of their own. Documents of
    fewer than ``min_words`` words, or of a language without a reference, are judged by the base rules alone.
    Repeated rows are judged alike, whatever their ids (null too); a distance at its limit is kept; long texts are read
    whole; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    thin = base_features(docs.select("doc_id", "text", "lang"))
    features = staged(histograms(thin), "quality")
    refs = staged(references(features, min_words), "quality-references")
    if refs.count() <= broadcast_langs:
        refs = F.broadcast(refs)
    d = features.join(refs, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    d = d.withColumns(
        {
            "base_failed": base_failed(),
            "char_distance": distance(F.array(*shares("c_total")), F.col("ref_chars")),
            "word_distance": distance(F.array(*shares("w_total")), F.col("ref_words")),
        }
    )
    wider = slack / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    far = (F.col("char_distance") > max_char_distance + wider) | (F.col("word_distance") > max_word_distance + wider)
    bad = F.col("base_failed") | ((F.col("n_words") >= min_words) & F.coalesce(far, F.lit(False)))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return d.select("doc_id", *counts, "base_failed", (~bad).alias("kept"), "char_distance", "word_distance")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op7_quality_rules": op7_quality_rules}
SQL: dict[str, str] = {}
