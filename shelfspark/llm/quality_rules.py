"""Line-first quality rules, native DataFrame expressions only.

Every line is judged on its own (punctuation, navigation, symbols, repetition,
boilerplate); failing lines go, and a document that loses too much of its text
goes with them. A base test on the whole text (too few words, too many words
inside repeated eight-word windows) comes first.

Defined results: null text counts as empty; an empty text has no words and
fails the base test; repeated rows are judged one by one; other columns of the
input are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
NO_BREAK = "\u00a0"
SYMBOLS = "#*$%&|<>"
#: Characters between the items of a menu or path.
BARS = "|»›·•"
#: Characters that may end a sentence, also inside closing quotes or brackets.
TERMINAL = list(".!?…:;\"'”’»)]。！？")
#: Phrases of page furniture rather than prose.
BOILERPLATE = (
    r"(?i)©|\b(cookie policy|privacy policy|terms of (use|service)|all rights reserved|copyright|javascript is (disabled|required)"
    r"|enable javascript|subscribe to our newsletter|sign up for|click here|log ?in to|lorem ipsum|powered by)"
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    max_loss_percent: int = 50
    max_symbol_percent: int = 10
    min_line_words: int = 3
    min_title_words: int = 3  # a line without an end, of so many words with capitals, is a row of titles or labels
    repeat_line_words: int = 10
    repeat_line_share: int = 4  # a line of at least repeat_line_words words needs a distinct word for each so many


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``; lambdas don't hoist what they capture."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def count_symbols(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))


def repeated_words(words: Column, window: int) -> Column:
    """Words inside windows of ``window`` words that occur twice or more."""

    def covered(at: Column) -> Column:  # sorted window positions
        step = F.transform(at, lambda p, i: F.when(i + 1 < F.size(at), F.least(F.lit(window), at[i + 1] - p)).otherwise(F.lit(window)))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def positions(s: Column) -> Column:  # (hash, position) sorted by hash
        same = F.transform(s, lambda x, i: F.when(((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.get(s, i + 1)["h"] == x["h"]), x["p"]))
        return F.sort_array(F.filter(same, lambda p: p.isNotNull()))

    def of_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, lambda s: let(positions(s), covered)))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - window + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(window))))
        return F.when(F.size(w) <= window, F.lit(0)).otherwise(let(hashes, of_hashes))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_words)


def line_fails(line: Column, rules: Rules) -> Column:
    """True for navigation, symbol noise, repetition, boilerplate, and fragments without an end."""
    ended = F.right(F.rtrim(line, F.lit(BLANKS + NO_BREAK)), F.lit(1)).isin(TERMINAL)
    symbols = count_symbols(line) * 100 > F.char_length(line) * rules.max_symbol_percent
    bars = F.char_length(line) - F.char_length(F.translate(line, BARS, "")) >= 3

    def by_words(w: Column) -> Column:
        short = (F.size(w) < rules.min_line_words) & ~ended
        initial = lambda x: F.left(x, F.lit(1))
        titles = ~ended & (F.size(w) >= rules.min_title_words) & F.forall(w, lambda x: F.lower(initial(x)) != initial(x))
        repeats = (F.size(w) >= rules.repeat_line_words) & (F.size(F.array_distinct(w)) * rules.repeat_line_share < F.size(w))
        return short | titles | repeats

    return symbols | bars | (~ended & (F.char_length(line) < 200) & line.rlike(BOILERPLATE)) | let(words_of(line), by_words)


def quality_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base counts, the cleaned text, and the verdict."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def measures(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words, rules.window).cast("long").alias("n_repeat_words"))

    def by_lines(lines: Column) -> Column:
        worded = F.filter(lines, lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
        kept = F.filter(worded, lambda x: ~line_fails(x, rules))
        return let(worded, lambda w: F.struct((F.size(w) - F.size(F.array_distinct(w))).cast("long").alias("n_dup_lines"), F.array_join(kept, "\n").alias("clean_text")))

    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    measured = base.select(
        "doc_id",
        let(words_of(F.col("t")), measures).alias("m"),
        F.char_length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        count_symbols(F.col("t")).cast("long").alias("n_symbols"),
        let(F.split("t", "\n"), by_lines).alias("l"),
    )
    flat = measured.select("doc_id", "m.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "m.n_repeat_words", "l.clean_text")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    left = F.char_length(F.translate("clean_text", BLANKS, "")).cast("long")
    return (
        flat.withColumns({"base_failed": failed, "clean_chars": left})
        .withColumn("kept", ~F.col("base_failed") & (100 * F.col("clean_chars") >= (100 - rules.max_loss_percent) * F.col("word_chars")))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_chars", "clean_text")
    )
