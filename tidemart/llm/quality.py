"""Quality rules: a threshold table compiled into one projection, with built-in expressions only.

Each rule bounds a ratio of two counts in thousandths, so that a verdict is integer arithmetic. Counts:
words (runs without blanks, tabs, line ends), characters in words, symbols, stop words, words with a letter,
exclamation marks, lines with a word and those equal to an earlier one, and words in repeated 3-word windows.

Windows are compared as 64-bit hashes of their words within one text. Hashes that repeat are found by
sorting (hash, position) pairs of the text, in n log n steps; texts without a repeat skip that.

Defined results: a null text is the empty text: no words, rejected for its length. A ratio over nothing
passes. Texts are read whole. Repeated rows give repeated results. Extra columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart.llm.common import by_position, pick

BLANKS = " \t\n\x0b\f\r"
BLANK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?\"'()"
#: Frequent words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    *("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "as", "with", "was", "on", "are", "by", "this"),
    *("be", "at", "or", "from", "an", "not", "have", "but", "you", "which", "he", "his", "they"),
    *("der", "die", "das", "und", "ist", "von", "den", "mit", "zu", "ein", "eine", "nicht", "des", "dem", "im", "auf"),
    *("für", "sich", "auch", "als", "einen", "einer"),
    *("le", "la", "les", "de", "et", "un", "une", "est", "que", "pour", "dans", "du", "au", "pas", "par", "qui", "sur"),
    *("ce", "en", "il", "avec", "ne"),
    *("el", "los", "las", "y", "una", "por", "con", "no", "se", "del", "al", "lo", "para", "su"),
)


@dataclass(frozen=True)
class Rule:
    """1000 * numerator / denominator has to lie from ``least`` to ``most``; None leaves a side open."""

    name: str
    numerator: str
    denominator: str
    least: int | None = None
    most: int | None = None


RULES = (
    Rule("enough_words", "n_words", "one", least=50_000),
    Rule("mean_word_length", "word_chars", "n_words", least=2_000, most=20_000),
    Rule("symbols_to_words", "n_symbols", "n_words", most=200),
    Rule("exclamations_to_words", "n_exclamations", "n_words", most=300),
    Rule("stop_words_to_words", "n_stop_words", "n_words", least=20),
    Rule("words_with_a_letter", "n_letter_words", "n_words", least=600),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=400),
    Rule("repeated_words", "n_repeat_words", "n_words", most=500),
)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the counts that rules refer to, as long columns."""
    plain = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    without = lambda chars: F.length(F.translate("_text", chars, ""))
    cut = plain.withColumns(
        {
            "_words": F.when(without(BLANKS) == 0, F.array().cast("array<string>")).otherwise(
                F.split(F.btrim("_text", F.lit(BLANKS)), BLANK)
            ),
            "_lines": F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""),
        }
    )
    word = lambda w: F.rtrim(F.lower(w), F.lit(MARKS))
    counted = cut.withColumns(
        {
            "n_words": F.size("_words"),
            "word_chars": without(BLANKS),
            "n_symbols": F.length("_text") - without(SYMBOLS),
            "n_exclamations": F.length("_text") - without("!"),
            "n_lines": F.size("_lines"),
            "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
            "n_stop_words": F.size(F.filter("_words", lambda w: word(w).isin(*STOP_WORDS))),
            "n_letter_words": F.size(F.filter("_words", lambda w: w.rlike("\\p{L}"))),
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    )
    at = lambda k: F.get("_hashes", k)
    windows = counted.withColumn(
        "_windows",
        F.when(F.col("n_words") < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.col("n_words") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))
            )
        ),
    )
    pairs = windows.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    hash_at = lambda k: F.get("_sorted", k)["h"]
    repeats = F.filter(
        "_sorted",
        lambda p, k: F.coalesce(p["h"] == hash_at(k - 1), F.lit(False))
        | F.coalesce(p["h"] == hash_at(k + 1), F.lit(False)),
    )
    covered = F.array_distinct(F.flatten(F.transform(repeats, lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2))))
    done = pairs.withColumns({"n_repeat_words": F.coalesce(F.when(F.col("_sorted").isNotNull(), F.size(covered)), F.lit(0)), "one": F.lit(1)})
    names = sorted({c for r in RULES for c in (r.numerator, r.denominator)})
    return done.withColumns({n: F.col(n).cast("bigint") for n in names}).drop(
        "_text", "_words", "_lines", "_hashes", "_windows", "_sorted"
    )


def passes(rule: Rule) -> Column:
    value, over = F.col(rule.numerator) * 1000, F.col(rule.denominator)
    ok = F.lit(True)
    if rule.least is not None:
        ok = ok & (value >= rule.least * over)
    if rule.most is not None:
        ok = ok & (value <= rule.most * over)
    return ok


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document the counts, ``base_failed`` and ``kept``: the whole table in one narrow stage."""
    n = F.col("n_words")
    base_failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    ok = F.lit(True)
    for rule in rules:
        ok = ok & passes(rule)
    return counts(pick(docs, doc_id="bigint", text="string")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & ok).alias("kept"),
    )


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns only, whatever these are called."""
    ok = (F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words"))
    for rule in rules:
        ok = ok & passes(rule)

    def change(rows: DataFrame, at: dict[str, int]) -> DataFrame:
        row = rows.select(F.struct(*rows.columns).alias("_row"), F.col(f"c{at['text']}").alias("text"))
        # A filter on plain columns would be pushed below the counts, with each of them written out anew;
        # it stays above a projection that is not deterministic.
        counted = counts(row).withColumn("_at", F.monotonically_increasing_id())
        return counted.where(ok & (F.col("_at") >= 0)).select("_row.*")

    return by_position(docs, change)
