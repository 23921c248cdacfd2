"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

Measures are whole numbers, worked out once for each text: words, characters in words, symbols, repeated lines, words in
repeated windows, words like the one before, stop words and lines. A rule bounds one measure by a share of another; a text is kept if
it passes the base rules and all others. Nothing is exchanged between rows and no Python runs.

Windows are compared by a 64-bit hash, and neighbours with equal hashes word by word.

Defined cases: null and empty texts have no words, all measures are 0 and the base rule on length fails; rows with equal or
null ids stay apart; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words of a repeated window.
WINDOW = 8
#: Frequent short words of four languages.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be at by this from or an are not but he his you "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la le et les des en un une du que est pour qui dans par sur au pas plus il elle "
    "el los las y del se por con una su para al lo como más o"
).split()


class Rule(NamedTuple):
    """measure * 100 is at least `least` and at most `most` percent of `of`; None is no bound."""

    measure: str
    of: str
    least: int | None = None
    most: int | None = None


#: A text that fails one of these is never kept.
BASE_RULES = [Rule("n_words", "one", least=2000), Rule("n_repeat_words", "n_words", most=30)]
#: The further rules that a kept text passes.
RULES = [
    Rule("word_chars", "n_words", least=200, most=1500),
    Rule("n_symbols", "n_words", most=10),
    Rule("n_bangs", "n_words", most=20),
    Rule("n_stop_words", "n_words", least=4),
    Rule("n_doubled_words", "n_words", most=40),
    Rule("n_dup_lines", "n_lines", most=50),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once however often body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of `window` words that the array holds twice or more."""

    def covered(starts: Column) -> Column:
        widths = F.transform(starts, lambda s, i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1) - s, F.lit(window))))
        return F.aggregate(widths, F.lit(0), lambda a, x: a + x)

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, window) == F.slice(words, b["i"] + 1, window)), F.lit(False))

    def starts(found: Column) -> Column:
        twice = F.filter(found, lambda x, i: F.when(i > 0, same(x, F.get(found, i - 1))).otherwise(F.lit(False)) | same(x, F.get(found, i + 1)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def count(hashes: Column) -> Column:
        numbered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(numbered, lambda f: let(starts(f), covered))).otherwise(F.lit(0))

    def windows(each: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words) - window + 1), lambda i: F.xxhash64(F.slice(each, i, window)))

    some = let(F.transform(words, lambda w: F.xxhash64(w)), lambda each: let(windows(each), count))
    return F.when(F.size(words) > window, some).otherwise(F.lit(0)).cast("long")


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of each row as columns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    chars = lambda signs: (F.length(text) - F.length(F.translate(text, signs, ""))).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    of_words = let(
        words_of(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.size(F.filter(ws, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            repeat_words(ws).alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w, i: F.when(i > 0, w == F.get(ws, i - 1)).otherwise(F.lit(False)))).cast("long").alias("n_doubled_words"),
        ),
    )
    of_lines = let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), of_words.alias("w"), F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"), chars(SYMBOLS).alias("n_symbols"), of_lines.alias("l"),
        chars("!").alias("n_bangs"),
    ).select("doc_id", "w.*", "word_chars", "n_symbols", "l.*", "n_bangs", F.lit(1).cast("long").alias("one"))


def passes(rules: list[Rule]) -> Column:
    """Whether a row of measures passes all rules."""
    ok = F.lit(True)
    for r in rules:
        if r.least is not None:
            ok = ok & (100 * F.col(r.measure) >= r.least * F.col(r.of))
        if r.most is not None:
            ok = ok & (100 * F.col(r.measure) <= r.most * F.col(r.of))
    return ok


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, base: list[Rule] = BASE_RULES, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, the measures, base_failed, kept) for each row."""
    return measures(df, id_col, text_col).withColumn("base_failed", ~passes(base)).withColumn("kept", ~F.col("base_failed") & passes(rules)).drop("one")
