"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at counts of the whole text and votes good, bad or abstains. A two-class model with a table of vote
probabilities for each rule is fitted by expectation-maximisation, without labels, on the counts of vote patterns
(at most 3 ** rules rows, however many documents there are). A document's posterior probability of being good
decides, in place of "every filter must pass".

All work is in built-in column functions; the corpus is read once, and only its counts are stored.

Defined results: a null or blank text has no words and fails the base rule. Repeated rows and rows with a null doc_id
get their own result. A very long text is counted to its end, as one row. Other input columns are ignored, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BLANKS, words_of, written

SYMBOLS = "#*$%&|<>"
BAD, GOOD, ABSTAIN = 0, 1, 2

# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that it was for on with as by at be this are from or an have not "
    "le la les de des du et en un une est que qui dans pour par sur au aux avec ce il ne pas se "
    "der die das und ist von den dem mit zu im auf ein eine nicht für als auch sich es "
    "el los las y del se una con por para como más su lo al"
).split()


def with_counts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to doc_id and the counts of the whole text that the rules need. No shuffle."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = d.select(
        "doc_id",
        words_of(F.col("t")).alias("w"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"),
        F.expr(r"regexp_count(t, '\\p{Lu}\\p{Lu}')").cast("long").alias("n_capital_pairs"),
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
    )
    d = d.select(
        "doc_id", "n_symbols", "n_capital_pairs", "word_chars",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: x.isin(*FUNCTION_WORDS))).cast("long").alias("n_function"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    m = "greatest(size(h) - 2, 0)"  # 3-word windows
    d = d.withColumn("win", F.expr(f"zip_with(zip_with(slice(h, 1, {m}), slice(h, 2, {m}), (a, b) -> xxhash64(a, b)), slice(h, 3, {m}), (ab, c) -> xxhash64(ab, c))"))
    d = d.withColumn("n_distinct", F.size(F.array_distinct("h")).cast("long")).drop("h")
    # Only texts with a repeated window sort theirs; equal neighbours give the positions at which repeats stand.
    d = d.withColumn("s", F.expr("if(size(array_distinct(win)) < size(win), sort_array(transform(win, (k, i) -> struct(k, i))), cast(array() as array<struct<k: bigint, i: int>>))"))
    d = d.withColumn("n_windows", F.size("s")).drop("win")
    d = d.withColumn("at", F.expr("sort_array(array_distinct(flatten(zip_with(slice(s, 1, greatest(n_windows - 1, 0)), slice(s, 2, greatest(n_windows - 1, 0)), (a, b) -> if(a.k = b.k, array(a.i, b.i), cast(array() as array<int>))))))")).drop("s", "n_windows")
    covered = F.expr("aggregate(zip_with(at, slice(at, 2, greatest(size(at) - 1, 0)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (s, x) -> s + x)")
    return d.withColumn("n_repeat_words", covered).drop("at")


def rules() -> dict[str, tuple[Column, Column]]:
    """For each rule: when it votes bad, else when it votes good; else it abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c: F.col(c) / n
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbols": (share("n_symbols") > 0.1, share("n_symbols") < 0.02),
        "capitals": (share("n_capital_pairs") > 0.5, share("n_capital_pairs") < 0.1),
        "function_words": (share("n_function") < 0.05, share("n_function") > 0.12),
        "repeats": (share("n_repeat_words") > 0.3, share("n_repeat_words") < 0.1),
        "lines": (lines > 0.3, lines < 0.1),
        "word_length": ((share("word_chars") > 6.5) | (share("word_chars") < 2.5), share("word_chars").between(3, 6)),
        "variety": ((share("n_distinct") < 0.2) & (n < 2000), (share("n_distinct") > 0.35) & (n >= 50)),
    }


def with_votes(counts: DataFrame) -> DataFrame:
    return counts.withColumns({f"vote_{k}": F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN).cast("int") for k, (bad, good) in rules().items()})


def log_odds(model: dict) -> Column:
    """Log of the odds of good to bad of a row of votes."""
    start = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    weigh = lambda k, p: F.element_at(F.array(*(F.lit(math.log(p[GOOD][v] / p[BAD][v])) for v in (BAD, GOOD, ABSTAIN))), F.col(f"vote_{k}") + 1)
    return reduce(lambda s, kp: s + weigh(*kp), model["votes"].items(), start)


def first_guess() -> dict:
    """Votes are right more often than not, and most documents are good."""
    return {"prior": 0.8, "votes": {k: {GOOD: [0.1, 0.7, 0.2], BAD: [0.5, 0.3, 0.2]} for k in rules()}}


def fit(votes: DataFrame, rounds: int = 20) -> dict:
    """Prior and vote probabilities of each class by expectation-maximisation over the counts of vote patterns.

    A round is one aggregate over the pattern table; only its few dozen sums reach the driver.
    """
    names = list(rules())
    columns = [f"vote_{k}" for k in names]
    patterns = written(votes.groupBy(*columns).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    model = first_guess()
    for _ in range(rounds):
        good = F.col("n") / (1 + F.exp(-log_odds(model)))
        sums = [F.sum(good).alias("good"), F.sum("n").alias("all")]
        for c in columns:
            for v in (BAD, GOOD, ABSTAIN):
                sums += [F.sum(F.when(F.col(c) == v, good).otherwise(0.0)).alias(f"{c}_{v}_good"), F.sum(F.when(F.col(c) == v, F.col("n")).otherwise(0)).alias(f"{c}_{v}")]
        got = patterns.agg(*sums).first()
        if not got["all"]:
            return model
        total, g = float(got["all"]), got["good"]
        # one vote of each kind is added, so that no probability is 0
        model = {"prior": (g + 1) / (total + 2), "votes": {}}
        for k, c in zip(names, columns, strict=True):
            good_v = [got[f"{c}_{v}_good"] for v in (BAD, GOOD, ABSTAIN)]
            bad_v = [got[f"{c}_{v}"] - x for v, x in zip((BAD, GOOD, ABSTAIN), good_v, strict=True)]
            model["votes"][k] = {GOOD: [(x + 1) / (g + 3) for x in good_v], BAD: [(max(x, 0.0) + 1) / (total - g + 3) for x in bad_v]}
    return model


def accuracies(model: dict) -> dict[str, float]:
    """Estimated share of right votes among the votes that each rule casts."""
    p = model["prior"]
    right = lambda q: p * q[GOOD][GOOD] + (1 - p) * q[BAD][BAD]
    cast = lambda q: p * (q[GOOD][GOOD] + q[GOOD][BAD]) + (1 - p) * (q[BAD][GOOD] + q[BAD][BAD])
    return {k: right(q) / cast(q) for k, q in model["votes"].items()}


def quality_rules(docs: DataFrame, rounds: int = 20, least: float = 0.5) -> DataFrame:
    """docs(doc_id, text) to doc_id, counts, votes, base_failed, posterior (of being good) and kept."""
    votes = with_votes(written(with_counts(docs), "counts"))
    posterior = 1 / (1 + F.exp(-log_odds(fit(votes, rounds))))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return votes.withColumns({"base_failed": base_failed, "posterior": posterior}).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))
