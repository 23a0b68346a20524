"""Quality rules: a threshold table compiled into one projection (no user functions).

The measures of a text are array and string functions; the verdict is one conjunction built from
``RULES``. No shuffle: every document is judged where it is read.

Defined results: a null text counts as empty (no words: fails the base rule); null in other columns
changes nothing; repeated rows are judged alike, each for itself; an empty table gives an empty
result; extra columns are carried by ``apply_rules`` and ignored by ``measure``. A column of ``docs`` that
has the name of a measure is replaced by the measure in ``measure`` only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, whole_text

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an "
    "had they you were their one all we can her has there been if more when will would who so no "
    "de la le et les des en un une du que est pour dans qui par sur pas au plus ce il sont se avec "
    "der die und das den von zu mit sich ist im dem nicht ein eine auf für als auch es werden aus hat "
    "el los las del se por con para una su al lo como más pero sus"
).split()

#: (measure, least, most, from how many words on the rule holds). None: no bound on that side.
RULES = (
    ("n_words", 10, None, 0),
    ("mean_word_chars", 1.5, 25.0, 0),
    ("symbol_ratio", None, 0.25, 0),
    ("stop_ratio", 0.01, None, 40),
    ("dup_line_ratio", None, 0.5, 0),
    ("shouted_ratio", None, 0.6, 20),
)
WINDOW = 5


#: A place before a word of a text whose words one space parts, with WINDOW words from there on as group 1.
WINDOWS = rf"(?<![^ ])(?=([^ ]++(?: [^ ]++){{{WINDOW - 1}}}))"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``value`` computed once and called ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words(windows: str, place_bits: int = 24) -> str:
    """SQL for the number of words that lie in a window that is found twice or more among ``windows``.

    A text whose windows all differ has none. Else numbers made of the upper bits of a window's hash and its place are
    sorted, neighbours of equal hash are compared as strings, and the places of equal ones counted. If such
    neighbours ever differ, or the text is too long for the place's ``place_bits`` bits, the windows themselves are sorted.
    """
    covered = f"aggregate(transform(p, (x, i) -> coalesce(least({WINDOW}, x - get(p, i - 1)), {WINDOW})), 0L, (a, x) -> a + x)"
    low = (1 << place_bits) - 1
    keys = f"sort_array(transform({windows}, (w, i) -> (xxhash64(w) & {~low}L) | i))"
    same = lambda j: f"coalesce((get(s, i + {j}) & {~low}L) = (x & {~low}L), false)"
    text = lambda j: f"get({windows}, int(get(s, i + {j}) & {low}L))"
    clash = f"exists(transform(s, (x, i) -> {same(1)} AND {text(0)} != {text(1)}), c -> c)"
    quick = _let("p", f"sort_array(transform(filter(s, (x, i) -> {same(-1)} OR {same(1)}), x -> int(x & {low}L)))", covered)
    twice = "filter(s, (x, i) -> coalesce(get(s, i - 1).w = x.w, false) OR coalesce(get(s, i + 1).w = x.w, false))"
    exact = _let("s", f"sort_array(transform({windows}, (w, i) -> struct(w AS w, i AS p)))", _let("p", f"sort_array(transform({twice}, x -> x.p))", covered))
    sure = _let("s", keys, f"CASE WHEN size({windows}) > {low} OR {clash} THEN -1L ELSE {quick} END")
    return f"CASE WHEN size(array_distinct({windows})) = size({windows}) THEN 0L ELSE {_let('n', sure, f'CASE WHEN n < 0 THEN {exact} ELSE n END')} END"


def measure(docs: DataFrame, *keep: str, place_bits: int = 24) -> DataFrame:
    """The measures of every text, beside the columns ``keep`` of ``docs``."""
    text = whole_text(docs)
    base = docs.select(
        *keep,
        text.alias("_text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    base = base.withColumn("_windows", F.regexp_extract_all(F.array_join("_words", " "), F.lit(WINDOWS), F.lit(1)))
    stop = ", ".join(f"'{w}'" for v in dict.fromkeys(STOP_WORDS) for w in dict.fromkeys((v, v.capitalize())))
    measures = base.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_repeat_words("_windows", place_bits)).alias("n_repeat_words"),
        F.expr(f"size(filter(_words, w -> w IN ({stop})))").cast("long").alias("n_stop_words"),
        F.length(F.regexp_replace("_text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )
    words = F.greatest(F.col("n_words"), F.lit(1))
    return measures.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / words,
            "symbol_ratio": F.col("n_symbols") / words,
            "stop_ratio": F.col("n_stop_words") / words,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "shouted_ratio": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        }
    )


def compiled(rules=RULES) -> Column:
    """The threshold table as one boolean expression: true if every rule holds."""

    def one(rule) -> Column:
        name, least, most, since = rule
        held = F.lit(True)
        if least is not None:
            held &= F.col(name) >= F.lit(least)
        if most is not None:
            held &= F.col(name) <= F.lit(most)
        return held | (F.col("n_words") < F.lit(since)) if since else held

    return reduce(lambda a, b: a & b, map(one, rules))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, *keep: str, rules=RULES) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every row of ``docs``."""
    return measure(docs, *keep).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def apply_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    The task's number beside the verdict keeps the optimizer from copying the measures into the filter, where each
    mention of one would compute it anew.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), docs["text"].alias("text"))
    judged = judge(rows, "_row", rules=rules).select("_row", "kept", F.spark_partition_id().alias("_task"))
    return judged.filter("kept AND _task >= 0").select("_row.*")
