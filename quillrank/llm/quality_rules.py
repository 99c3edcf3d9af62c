"""Line-first cleaning: judge lines, drop those that fail, reject documents that lose too much.

Only column expressions: every count is made inside the row, so nothing is shuffled
and a long or frequent line costs no more than its bytes. Null text has no words and
fails; repeated rows are judged alike; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.vectors import let
from quillrank.llm.common import whole_text

SPACE = "[\\x20\\x09-\\x0D]+"
BLANK = " \t\n\x0b\f\r"
#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Shares above which a line fails, of its words.
MAX_SYMBOLS_PER_WORD, MAX_PIPES_PER_WORD, MAX_SHOUTS_PER_WORD = 0.5, 0.25, 0.34
#: Words from which a line's share of distinct words is judged, and the least share.
REPEAT_LINE_WORDS, MIN_DISTINCT = 20, 0.2
#: Share of the word characters that a document may lose.
MAX_LOST = 0.5
BOILERPLATE = (
    "(?i)^\\s*(all rights reserved|accept (all )?cookies|we use cookies|this (site|website) uses cookies|skip to (main )?content"
    "|sign (in|up)|log ?in|subscribe( now)?|share (this|on)|read more|click here|terms of (use|service)|privacy policy"
    "|please enable javascript|back to top|next page|previous page)\\b.{0,60}$"
)


def words_in(text: Column) -> Column:
    """The words: runs of characters other than space and 9 to 13."""
    bare = F.btrim(text, F.lit(BLANK))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1))


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeated_words(words: Column) -> Column:
    """Words inside a three-word window that the text has twice or more."""

    def marked(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return let(windows, covered)

    def covered(h: Column) -> Column:
        # Windows in order of hash, then place: one is repeated if a neighbour has its hash.
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = let(
            ordered,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda e, k: ((k > 0) & (F.try_element_at(s, F.greatest(k, F.lit(1)))["h"] == e["h"])) | (F.try_element_at(s, k + 2)["h"] == e["h"]).eqNullSafe(True)),
                    lambda e: e["i"],
                )
            ),
        )
        spans = let(repeated, lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.try_element_at(p, k + 2) - x, F.lit(3)))))
        some = F.aggregate(spans, F.lit(0), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(some)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, marked))


def line_fails(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules for one line with words."""
    bare = F.btrim(line, F.lit(BLANK))
    spaces = F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit("")))
    words = (spaces + 1).cast("double")
    distinct = F.size(F.array_distinct(F.split(bare, " ")))
    return (
        (_count_of(bare, "#*$%&<>") > MAX_SYMBOLS_PER_WORD * words)
        | ((_count_of(bare, "|") > MAX_PIPES_PER_WORD * words) & (_count_of(bare, "|") >= 2))
        | ((_count_of(bare, "!") > 2 * MAX_SHOUTS_PER_WORD * words) & (words >= 3))
        | ((words >= REPEAT_LINE_WORDS) & (distinct < MIN_DISTINCT * words))
        | bare.rlike(BOILERPLATE)
    )


def _lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "")


def judge(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, n_lines, n_failed_lines, lost_chars and ``keep``."""
    text = whole_text()
    base = docs.select("doc_id", *keep, text.alias("_body"))
    body = F.col("_body")
    facts = let(
        words_in(body),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    lines = let(
        _lines_with_words(body),
        lambda ls: F.struct(
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.filter(ls, line_fails).alias("failed"),
        ),
    )
    lost = F.aggregate(F.col("_l.failed"), F.lit(0).cast("long"), lambda a, x: a + F.length(F.regexp_replace(x, SPACE, "")))
    out = base.withColumn("_w", facts).withColumn("_l", lines).withColumn("lost_chars", lost)
    failed = (F.col("_w.n_words") < MIN_WORDS) | (100 * F.col("_w.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_w.n_words"))
    return out.select(
        "doc_id",
        F.col("_w.n_words").alias("n_words"),
        F.col("_w.word_chars").alias("word_chars"),
        _count_of(body, SYMBOLS).cast("long").alias("n_symbols"),
        F.col("_l.n_dup_lines").alias("n_dup_lines"),
        F.col("_w.n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (F.col("lost_chars") <= MAX_LOST * F.col("_w.word_chars"))).alias("kept"),
        F.col("_l.n_lines").alias("n_lines"),
        F.size("_l.failed").cast("long").alias("n_failed_lines"),
        "lost_chars",
        *keep,
    )


def cleaned_text(text: Column) -> Column:
    """The text without the lines that fail; lines without words stay."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: (F.btrim(x, F.lit(BLANK)) == "") | ~line_fails(x)), "\n")


def passing(docs: DataFrame) -> DataFrame:
    """The documents that pass, unchanged."""
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*names).alias("_row"))
    return judge(packed, "_row").where("kept").select("_row.*")
