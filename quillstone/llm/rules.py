"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Words are runs of characters other than space, tab, line feed, vertical tab,
form feed and carriage return. Windows of words are compared exactly: by a 64-bit hash
first, and by their words where hashes are equal. Stop words count in small letters or with a
capital, bare or before one of MARKS. The thresholds were set once, from what the ratios mean, and
not fitted to labels.

Defined results: a null text has no words and fails the base rules; a null or
empty text has zero in every count; whole texts of every length are counted; repeated rows are
judged alike, each by itself; an empty table gives an empty one; columns that have the
names of results are replaced, all others stay, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE

MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on that the this to was what with "
    "als auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au aux avec dans de des du en est et la le les par pas pour que qui un une "
    "como con de del el en es la las lo los no para por que se su una un y"
).split()


#: What may follow a stop word.
MARKS = ("", ".", ",", ";", ":", "!", "?")


def stop_forms() -> list[str]:
    """The forms in which a stop word is counted."""
    return sorted({form + mark for word in STOP_WORDS for form in (word, word.capitalize()) for mark in MARKS})


@dataclass(frozen=True)
class Threshold:
    """A ratio of two counted columns and the range it has to lie in."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float

    def sql(self) -> str:
        return f"({self.numerator} >= {self.low} * {self.denominator} and {self.numerator} <= {self.high} * {self.denominator})"


#: Every rule has to hold for a document to be kept.
THRESHOLDS = (
    Threshold("mean word length", "word_chars", "n_words", 2.0, 20.0),
    Threshold("symbols per word", "n_symbols", "n_words", 0.0, 0.25),
    Threshold("exclamation marks per word", "n_marks", "n_words", 0.0, 0.5),
    Threshold("stop words per word", "n_stop_words", "n_words", 0.02, 1.0),
    Threshold("repeated lines per line", "n_dup_lines", "n_lines", 0.0, 0.5),
)


def verdict_sql(thresholds: tuple[Threshold, ...] = THRESHOLDS) -> str:
    """The whole table as one SQL condition, good for Spark and for DuckDB."""
    return " and ".join(t.sql() for t in thresholds) or "true"


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with its counts; existing columns of the same names are replaced."""
    kept = [c for c in df.columns if c not in COUNTS]
    blanks = " " * len(WORD_SPACE)
    squeezed = F.translate(F.col("text"), WORD_SPACE + " ", "")
    # the row travels as one struct, so that its names meet none of those below
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.lit(None).alias("row")
    parts = df.select(row, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).select(
        "*",
        F.array_remove(F.split(F.translate(F.col("text"), WORD_SPACE, blanks), " "), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.translate(line, WORD_SPACE + " ", "") != "").alias("lines"),
    )
    window = lambda i: [F.get("words", i + k) for k in range(WINDOW)]
    # a window's words enter one 64-bit hash in order
    windows = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*window(i)))).otherwise(F.array().cast("array<bigint>"))
    counted = parts.select(
        "row",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(squeezed).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "!", ""))).cast("long").alias("n_marks"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: w.isin(stop_forms()))).cast("long").alias("n_stop_words"),
        windows.alias("windows"),
    )
    # only texts in which a hash comes twice are sorted, by hash, then the words, then the place
    order = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), F.concat_ws(" ", *window(i)).alias("w"), i.alias("i"))))
    sorted_windows = counted.withColumn("order", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), order))
    same = lambda s, k: s["h"].eqNullSafe(F.get("order", k)["h"]) & s["w"].eqNullSafe(F.get("order", k)["w"])
    repeated = F.array_sort(
        F.transform(
            F.filter(F.transform("order", lambda s, k: F.struct(s["i"].alias("at"), (same(s, k - 1) | same(s, k + 1)).alias("twice"))), lambda s: s["twice"]),
            lambda s: s["at"],
        )
    )
    covered = F.aggregate(
        repeated,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, at: F.struct((a["n"] + F.least(F.lit(WINDOW), at - a["last"])).alias("n"), at.alias("last")),
        lambda a: a["n"],
    )
    counts = ("n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_stop_words")
    done = sorted_windows.select("row", *counts, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    return done.select(*[F.col("row").getField(c).alias(c) for c in kept], *counts, "n_repeat_words")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words", "base_failed", "kept")


def apply_rules(df: DataFrame, text_col: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """df with its counts, base_failed and kept."""
    base = f"(n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
    # the partition number is never negative: it only keeps a filter on the verdict from being
    # pushed below, where it would repeat every count once for each of its uses
    kept = F.expr(f"not {base} and {verdict_sql(thresholds)}") & (F.spark_partition_id() >= 0)
    return measures(df, text_col).select("*", F.expr(base).alias("base_failed"), kept.alias("kept"))


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for op8's columns."""
    stop = ", ".join(f"'{w}'" for w in stop_forms())
    base = f"(n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
    return f"""
with split as (
  select doc_id, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines
  from {table}),
windows as (
  select doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') as w
  from (select doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) as i from split)),
twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, w) > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, range({WINDOW}) r(k) group by doc_id),
counted as (
  select doc_id, len(words)::bigint as n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')))::bigint as n_symbols,
    (length(text) - length(replace(text, '!', '')))::bigint as n_marks,
    len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    len(list_filter(words, lambda w: w in ({stop})))::bigint as n_stop_words,
    coalesce(n, 0)::bigint as n_repeat_words
  from split left join covered using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  {base} as base_failed, (not {base} and {verdict_sql()}) as kept
from counted"""


def kept_rows(df: DataFrame, text_col: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The rows of df, columns as they are, that the rules keep."""
    judged = apply_rules(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(text_col).alias("_rule_text")), "_rule_text", thresholds)
    return judged.where("kept").select("_row.*")
