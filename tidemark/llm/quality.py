"""Quality rules: one table of thresholds over length, symbol, stop-word and line measures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import SPACE, spaced_words

# Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to a in is that for it was on with be as by this are "
    "der die und den von zu das mit sich auf des für ist nicht dem ein eine als "
    "de la que el en y los se del las por un no con su una es para al "
    "le et les du une pour est qui dans par pas au sur avec"
).split()
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: A text is under 2 GB, so a word's place fits 31 bits.
PLACE_BITS = 31


@dataclass(frozen=True)
class Rule:
    """A document fails if `measure` is below `low` or above `high` (either may be open).

    `from_words`: texts with fewer words are not judged by the rule, as ratios
    over a handful of words say little.
    """

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


RULES = (
    Rule("few_words", "n_words", low=10),
    Rule("repeated_windows", "repeat_ratio", high=0.2),
    Rule("word_length", "mean_word_chars", low=2.0, high=15.0, from_words=10),
    Rule("symbols", "symbol_ratio", high=0.3, from_words=10),
    Rule("repeated_lines", "dup_line_ratio", high=0.4, from_words=10),
    Rule("stop_words", "stop_ratio", low=0.01, from_words=50),
)
#: The rules that every verdict contains, whatever table a caller passes.
BASE_RULES = ("few_words", "repeated_windows")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the measures as `_`-prefixed columns; one row for each row.

    Every measure is an expression over the row's own text, so nothing is
    shuffled. Windows are compared by hash first; only texts where two hashes
    agree compare the windows' words.
    """
    full = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns(
        {
            "_words": spaced_words(F.col(text)),
            # lines with a word in them
            "_lines": F.filter(F.split(full, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "_n_symbols": F.regexp_count(full, F.lit(SYMBOLS)).cast("long"),
            "_word_chars": (F.length(full) - F.regexp_count(full, F.lit(SPACE))).cast("long"),
        }
    )
    out = out.withColumns(
        {
            "_n_words": F.size("_words").cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
            "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
            "_n_stop": F.size(
                F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))
            ).cast("long"),
        }
    )

    def at(column: str, i: Column) -> Column:
        return F.get(F.col(column), i)

    out = out.withColumn(
        "_keys",
        F.when(
            F.size("_words") > WINDOW,
            F.transform(
                F.slice("_hashes", F.lit(1), F.size("_hashes") - (WINDOW - 1)),
                lambda h, i: F.xxhash64(h, *[at("_hashes", i + k) for k in range(1, WINDOW)]),
            ),
        ),
    )
    top = lambda x: F.shiftrightunsigned(x, PLACE_BITS)
    # where two windows agree: the upper bits of each window's hash and its place in one long,
    # so that one sort of longs brings windows that may be equal together
    out = out.withColumn(
        "_order",
        F.when(
            F.size(F.array_distinct("_keys")) < F.size("_keys"),
            F.sort_array(
                F.transform(
                    "_keys",
                    lambda x, i: F.shiftleft(top(x), PLACE_BITS).bitwiseOR(i.cast("long")),
                )
            ),
        ),
    )
    near = lambda x, k: F.coalesce(top(at("_order", k)) == top(x), F.lit(False))
    out = out.withColumn(
        "_places",
        F.transform(
            F.filter("_order", lambda x, k: near(x, k - 1) | near(x, k + 1)),
            lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"),
        ),
    )
    # of those few, the words themselves decide
    out = out.withColumn(
        "_sorted",
        F.when(
            F.size("_places") > 0,
            F.array_sort(
                F.transform(
                    "_places",
                    lambda i: F.struct(
                        F.array_join(F.slice("_words", i + 1, F.lit(WINDOW)), " ").alias("w"),
                        i.alias("i"),
                    ),
                )
            ),
        ),
    )
    same = lambda x, i: F.coalesce(at("_sorted", i)["w"] == x["w"], F.lit(False))
    out = out.withColumn(
        "_found",
        F.array_sort(
            F.filter(
                F.transform(
                    "_sorted",
                    lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]),
                ),
                lambda i: i.isNotNull(),
            )
        ),
    )
    # words covered by the windows found: each adds what lies beyond the one before it
    covered = F.aggregate(
        "_found",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(
            (i + WINDOW).alias("end"), (a["n"] + (i + WINDOW) - F.greatest(a["end"], i)).alias("n")
        ),
        lambda a: a["n"],
    )
    return out.withColumn("_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(
        "_words", "_lines", "_hashes", "_keys", "_order", "_places", "_sorted", "_found"
    )


def _measures() -> dict[str, Column]:
    words = F.greatest(F.col("_n_words"), F.lit(1))
    return {
        "n_words": F.col("_n_words"),
        "mean_word_chars": F.col("_word_chars") / words,
        "symbol_ratio": F.col("_n_symbols") / words,
        "dup_line_ratio": F.col("_n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
        "stop_ratio": F.col("_n_stop") / words,
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """One boolean column for each rule: true where the document fails it."""
    measures, out = _measures(), {}
    for rule in rules:
        if rule.measure == "repeat_ratio":  # in whole numbers, as a share is not exact
            fails = 100 * F.col("_n_repeat_words") > round(100 * rule.high) * F.col("_n_words")
        else:
            value, fails = measures[rule.measure], F.lit(False)
            if rule.low is not None:
                fails = fails | (value < rule.low)
            if rule.high is not None:
                fails = fails | (value > rule.high)
        out[rule.name] = fails & (F.col("_n_words") >= rule.from_words)
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """`docs` with measures, `base_failed`, `failed_rules` and `kept` under a struct `quality`.

    Null and blank texts have no words and fail; repeated rows are judged each
    for itself; an empty table gives an empty table. The input's columns stay,
    so clashing names cannot occur except for `quality`, which is replaced.
    """
    missing = set(BASE_RULES) - {r.name for r in rules}
    if missing:
        raise ValueError(f"the base rules {sorted(missing)} can't be left out")
    kept = [c for c in docs.columns if c != "quality"]
    inner = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(text).alias("_text")
    )
    failed = compile_rules(rules)
    names = F.filter(
        F.array(*[F.when(c, F.lit(name)) for name, c in failed.items()]), lambda x: x.isNotNull()
    )
    base = failed[BASE_RULES[0]] | failed[BASE_RULES[1]]
    verdict = F.struct(
        F.col("_n_words").alias("n_words"),
        F.col("_word_chars").alias("word_chars"),
        F.col("_n_symbols").alias("n_symbols"),
        F.col("_n_dup_lines").alias("n_dup_lines"),
        F.col("_n_repeat_words").alias("n_repeat_words"),
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_stop").alias("n_stop_words"),
        base.alias("base_failed"),
        names.alias("failed_rules"),
    )
    # exploded from an array of one: a filter on the verdict would else be pushed below the
    # measures and carry a copy of each of their expressions
    judged = measure(inner, "_text").select("_row", F.explode(F.array(verdict)).alias("quality"))
    return judged.select(
        *[F.col("_row")[c].alias(c) for c in kept],
        F.col("quality").withField("kept", F.size("quality.failed_rules") == 0).alias("quality"),
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass every rule, with their own columns only."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    columns = [F.col("_row")[c].alias(c) for c in docs.columns]
    return judge(held, rules).where("quality.kept").select(*columns)
