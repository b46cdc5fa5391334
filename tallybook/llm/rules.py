"""Line-first cleaning with DataFrame functions only.

Rules judge each line by itself: how it ends, whether it is navigation, whether it
is boilerplate. Failing lines are removed, and a document that loses too much of its
text is rejected.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm import common

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
LEAST_KEPT = 0.5  # of the characters
# fixed values: phrases of boilerplate lines, lower case
BOILERPLATE = """
all rights reserved|privacy policy|terms of use|terms of service|cookie policy|use cookies|accept cookies
|javascript is disabled|enable javascript|click here|read more|sign up|log in|subscribe to|skip to content
|powered by|share this|lorem ipsum
""".replace("\n", "").split("|")
SPACE = r"[\x20\x09-\x0D]+"
ENDS = r"[.!?:;,\"'”’)\]…]$"


def bind(value: Column, body) -> Column:
    """``body`` of a value that is worked out once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the list, the first one included.

    Windows are 64-bit hashes with their places. Sorted, equal windows are neighbours.
    """

    def count(w: Column) -> Column:
        # each word is hashed once; windows are hashes of those
        pairs = lambda h: F.zip_with(h, F.slice(h, 2, F.size(h) - 1), lambda a, b: F.xxhash64(a, b))
        threes = lambda h: F.zip_with(pairs(h), F.slice(h, 3, F.size(h) - 2), lambda a, b: F.xxhash64(a, b))
        windows = bind(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.slice(threes(h), 1, F.size(h) - 2))

        keyed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("hash"), i.alias("at"))))

        def places(s: Column) -> Column:
            same = lambda x, y: F.coalesce(x["hash"] == y["hash"], F.lit(False))
            twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
            return bind(F.transform(twice, lambda x: x["at"]), covered)

        return bind(keyed, places)

    def covered(starts: Column) -> Column:
        return F.size(F.array_distinct(F.concat(starts, F.transform(starts, lambda p: p + 1), F.transform(starts, lambda p: p + 2))))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bind(words, count)).cast("long")


def good_line(line: Column) -> Column:
    """A line that ends like a sentence or is long enough to be prose, is no navigation and no boilerplate.

    Words are counted once a line, and tests that need the count only come before those that read the line again.
    """

    def judged(n_words: Column) -> Column:
        bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
        marked = F.regexp_count(line, F.lit(r"[#*$%&<>!]{2,}"))
        ended = (n_words >= 10) | F.rtrim(line).rlike(ENDS)
        navigation = (bars >= 2) & (3 * bars >= n_words)
        boilerplate = (n_words <= 12) & bind(F.lower(line), lambda x: reduce(or_, [F.contains(x, F.lit(p)) for p in BOILERPLATE]))
        return ended & ~navigation & ~boilerplate & (3 * marked < n_words)

    return bind(F.regexp_count(line, F.lit(common.WORD)), judged)


def clean(docs: DataFrame, least_kept: float = LEAST_KEPT) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept, kept_text.

    ``kept_text`` holds the lines that passed; lines without a word are neither judged nor counted. A document
    is kept if it passes the base rules (50 words, at most half of them in repeated 3-word windows) and its
    passing lines hold at least ``least_kept`` of the characters of its lines with a word. A null or blank
    text has all counts 0, fails and is not kept. Repeated rows get equal results, extra columns are ignored.
    Empty tables give empty results.
    """
    rows = common.id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    listed = rows.select(
        "doc_id", "text",
        F.filter(F.split("text", SPACE), lambda x: x != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(common.WORD)).alias("lines"),
    )
    counted = listed.select(
        "doc_id",
        "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.filter("lines", good_line).alias("good"),
    )
    chars = lambda lines: F.aggregate(lines, F.lit(0), lambda t, x: t + F.length(x))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    judged = counted.select("*", failed.alias("base_failed"), (chars("good") >= least_kept * chars("lines")).alias("enough"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("enough")).alias("kept"), F.concat_ws("\n", "good").alias("kept_text"),
    )
