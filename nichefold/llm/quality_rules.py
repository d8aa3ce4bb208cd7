"""Quality rules by weak supervision, in native expressions only.

Each rule looks at statistics of a whole text and votes good (1), bad (-1) or abstains (0).
Nothing says how far a rule can be trusted: expectation-maximisation over the counts of vote
patterns estimates the share of good documents and each rule's accuracy, and a document's verdict
is its posterior probability of being good.  There are at most 3^8 patterns however large the
corpus, so the model is fitted on one tiny row inside the plan, by higher-order functions, and joined
to all documents as a single broadcast row.

Defined cases: null text counts as empty; texts without words have n_words 0 and fail the base test; texts of any length are read whole;
null ids, repeated rows and extra columns of any name pass through; equal texts have equal verdicts, and a probability of just KEEP_AT keeps; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichefold.llm.common import SPACE_CLASS, free_name, let, materialise

WINDOW = 5
SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "repeats", "dup_lines", "capitals", "short_words", "exclaims", "variety", "word_length")
#: Starts of the fit, and bounds that keep the direction of each rule: on good documents it errs
#: seldom, on bad ones it may well see nothing wrong, as each rule knows one kind of junk.
PRIOR, GOOD_START, BAD_START, ROUNDS = 0.8, 0.97, 0.5, 30
SHARE, GOOD, BAD = (0.05, 0.95), (0.8, 0.999), (0.25, 0.999)
KEEP_AT = 0.5
LOW = (1 << 31) - 1


def _covered(w: Column) -> Column:
    """Words of w in windows of five words that occur at least twice."""

    def starts_of_repeats(h: Column) -> Column:
        # 33 bits of hash above 31 of position sort as plain longs; what may repeat is then settled by all 64 bits.
        packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, 31).bitwiseOR(i.cast("long"))))

        def maybe(s: Column) -> Column:
            top = lambda x: F.shiftright(x, 31)
            near = F.filter(s, lambda x, k: F.coalesce(top(x) == top(F.get(s, k - 1)), F.lit(False)) | F.coalesce(top(x) == top(F.get(s, k + 1)), F.lit(False)))
            at = lambda x: x.bitwiseAND(F.lit(LOW)).cast("int")
            return F.sort_array(F.transform(near, lambda x: F.struct(F.get(h, at(x)).alias("h"), at(x).alias("i"))))

        def sure(c: Column) -> Column:
            eq = lambda x, k: F.coalesce(x["h"] == F.get(c, k)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(c, lambda x, k: eq(x, k - 1) | eq(x, k + 1)), lambda x: x["i"]))

        return let(packed, lambda s: let(maybe(s), sure))

    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    total = let(
        windows,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            F.aggregate(
                starts_of_repeats(h),
                F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum")),
                lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("sum")),
                lambda a: a["sum"],
            )
        ),
    )
    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(total)


def statistics(text: Column) -> Column:
    """A struct of the statistics of a text that the base test and the rules need."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count_of = lambda s, c: F.octet_length(s) - F.octet_length(F.replace(s, F.lit(c), F.lit("")))
    big = lambda c: c.cast("long")

    def of(t: Column) -> Column:
        return let(
            F.array_remove(F.split(t, SPACE_CLASS), ""),
            lambda w: F.struct(
                big(F.size(w)).alias("n_words"),
                big(F.length(F.array_join(w, ""))).alias("word_chars"),
                big(sum((count_of(t, c) for c in SYMBOLS[1:]), count_of(t, SYMBOLS[0]))).alias("n_symbols"),
                let(lines, lambda x: big(F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
                _covered(w).alias("n_repeat_words"),
                big(F.size(lines)).alias("n_lines"),
                big(F.size(F.filter(w, lambda x: (F.length(x) > 1) & (x == F.upper(x)) & (x != F.lower(x))))).alias("n_capitals"),
                big(F.size(F.filter(w, lambda x: F.length(x).between(2, 3)))).alias("n_short"),
                big(count_of(t, "!")).alias("n_exclaims"),
                big(F.size(F.array_distinct(w))).alias("n_distinct"),
            ),
        )

    return let(t, of)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def votes(s: Column) -> Column:
    """One vote a rule, in the order of RULES: bad -1, good 1, else 0."""

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    n = s["n_words"]
    return F.array(
        rule(20 * s["n_symbols"] > n, 100 * s["n_symbols"] <= n),
        rule(100 * s["n_repeat_words"] > 15 * n, 100 * s["n_repeat_words"] <= 2 * n),
        rule(2 * s["n_dup_lines"] > s["n_lines"], (s["n_dup_lines"] == 0) & (s["n_lines"] >= 2)),
        rule(2 * s["n_capitals"] > n, 10 * s["n_capitals"] <= n),
        rule((n >= 20) & (10 * s["n_short"] < n), 5 * s["n_short"] >= n),
        rule(4 * s["n_exclaims"] > n, 50 * s["n_exclaims"] <= n),
        rule((n >= 30) & (s["n_distinct"] * s["n_distinct"] < 4 * n), (n >= 30) & (s["n_distinct"] * s["n_distinct"] >= 25 * n)),
        rule((s["word_chars"] > 12 * n) | (s["word_chars"] < 2 * n), s["word_chars"].between(3 * n, 9 * n)),
    )


def posterior(v: Column, m: Column) -> Column:
    """The probability that a document with votes v is good, by a model m of fit()."""

    def weigh(acc: Column, j: Column) -> Column:
        good, bad = F.get(m["good"], j), F.get(m["bad"], j)
        return acc + F.when(F.get(v, j) > 0, F.log(good / (1 - bad))).when(F.get(v, j) < 0, F.log((1 - good) / bad)).otherwise(0.0)

    odds = F.aggregate(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), F.log(m["p"] / (1 - m["p"])), weigh)
    return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame) -> DataFrame:
    """One row with struct m (p, good, bad) from rows (v array<int>, c count of documents).

    p is the share of good documents; good and bad hold each rule's accuracy on either kind, over
    the documents on which it doesn't abstain.  A rule that never votes keeps its start, as does all
    where there are no documents.
    """
    k = len(RULES)
    double = lambda c: c.cast("double")
    rows = patterns.select(F.struct("v", double(F.col("c")).alias("c")).alias("x")).agg(F.sort_array(F.collect_list("x")).alias("ps"))

    def add(xs: Column, of) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + of(x))

    def within(x: Column, bounds: tuple[float, float]) -> Column:
        return F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), x))

    def step(m: Column, ps: Column) -> Column:
        scored = F.transform(ps, lambda x: F.struct(x["v"].alias("v"), (x["c"] * posterior(x["v"], m)).alias("g"), (x["c"] * (1 - posterior(x["v"], m))).alias("b")))

        def accuracy(xs: Column, part: str, right: int, bounds: tuple[float, float], start: float) -> Column:
            def of(j: Column) -> Column:
                hit = add(xs, lambda x: x[part] * F.when(F.get(x["v"], j) == right, 1.0).otherwise(0.0))
                cast = add(xs, lambda x: x[part] * F.abs(F.get(x["v"], j)))
                return F.coalesce(within(F.try_divide(hit, cast), bounds), F.lit(start))

            return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), of)

        return let(
            scored,
            lambda xs: F.struct(
                within(add(xs, lambda x: x["g"]) / add(xs, lambda x: x["g"] + x["b"]), SHARE).alias("p"),
                accuracy(xs, "g", 1, GOOD, GOOD_START).alias("good"),
                accuracy(xs, "b", -1, BAD, BAD_START).alias("bad"),
            ),
        )

    start = F.struct(F.lit(PRIOR).alias("p"), F.array_repeat(F.lit(GOOD_START), k).alias("good"), F.array_repeat(F.lit(BAD_START), k).alias("bad"))
    fitted = F.when(F.size("ps") > 0, F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda m, _: step(m, F.col("ps")))).otherwise(start)
    return rows.select(fitted.alias("m"))


def judge(stats: DataFrame, stat: str = "st") -> DataFrame:
    """stats with n rows of struct column ``stat``; adds base_failed, votes, quality_prob and kept.

    The vote patterns of all rows are counted before anything is decided.  stats is read twice, so
    bring a written table or one whose statistics are cheap to compute again.
    """
    with_votes = stats.withColumn("votes", votes(F.col(stat)))
    model = fit(with_votes.groupBy(F.col("votes").alias("v")).agg(F.count("*").alias("c")))
    out = with_votes.crossJoin(F.broadcast(model.select(F.col("m").alias("model"))))
    out = out.withColumn("quality_prob", posterior(F.col("votes"), F.col("model")))
    out = out.withColumn("base_failed", base_failed(F.col(stat)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_prob") >= KEEP_AT)).drop("model")


def quality_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, statistics, base_failed, votes, quality_prob and kept; texts are read once."""
    stats = materialise(docs.select(F.col(id_col), statistics(F.col(text_col)).alias("st")), "rules")
    return judge(stats).select(id_col, "st.*", "votes", "quality_prob", "base_failed", "kept")


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the verdict keeps, with their columns as they are.

    The model needs every row's votes before any verdict.  So the rows are written once with their votes beside them, which costs the
    input's size in the shared folder and spares a second computing of all statistics; safe with repeated or null ids.
    """
    v, m = free_name(docs, "votes"), free_name(docs, "model")
    # One expression, so that a text's statistics are computed once.
    both = let(statistics(F.col(text_col)), lambda s: F.struct(votes(s).alias("v"), base_failed(s).alias("f")))
    rows = materialise(docs.withColumn(v, both), "judged")
    model = fit(rows.groupBy(F.col(f"{v}.v").alias("v")).agg(F.count("*").alias("c")))
    judged = rows.filter(~F.col(f"{v}.f")).crossJoin(F.broadcast(model.select(F.col("m").alias(m))))
    return judged.filter(posterior(F.col(f"{v}.v"), F.col(m)) >= KEEP_AT).select(*docs.columns)
