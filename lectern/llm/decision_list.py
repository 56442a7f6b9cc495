"""Quality rules as a learned decision list, in DataFrame expressions only.

Statistics of each text are columns. Sequential covering reads labelled statistics: each step of growth is one
grouped count over (statistic, bin), so the driver sees a few hundred counts and never a labelled row. A rule is a
conjunction of thresholds; it is grown on two thirds of the labelled rows and pruned on the rest. The list comes
out as one ordered ``when`` expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, fresh, let, parts, save, whole, words

#: Statistics that conditions may test, as ratios so that they do not depend on length.
TESTED = {
    "mean_word_chars": lambda: F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    "symbols_per_word": lambda: F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1)),
    "dup_line_share": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    "repeat_word_share": lambda: F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
    "distinct_word_share": lambda: F.col("n_distinct_words") / F.greatest(F.col("n_words"), F.lit(1)),
    "capital_share": lambda: F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
    "marks_per_word": lambda: F.col("n_marks") / F.greatest(F.col("n_words"), F.lit(1)),
}


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def repeated_window_words(hashes: Column, width: int) -> Column:
    """Words that lie in a window found twice or more, from the array of window hashes.

    Most texts repeat no window, which one distinct count tells; only the others are sorted by (hash, place).
    """
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = let(
        pairs,
        lambda s: F.filter(
            F.transform(
                s,
                lambda e, k: F.when(
                    F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)),
                    e["i"],
                ),
            ),
            lambda p: p.isNotNull(),
        ),
    )
    covered = let(
        F.sort_array(places),
        lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))),
            F.lit(0),
            lambda a, x: a + x,
        ),
    )
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(F.lit(0)).cast("long")


def statistics(docs: DataFrame, text_col: str = "text", window: int = 5, keep: list[str] | None = None) -> DataFrame:
    """``doc`` (docs' columns, or those of keep, as one struct) and the statistics of each whole text beside it.

    A null text counts as empty: every count is 0. Repeated rows each get their own; an empty table gives an empty
    result. Columns of docs keep their names and values inside ``doc``, whatever they are called.
    """
    with_words = docs.select(whole(docs.columns if keep is None else keep), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    with_words = with_words.withColumn("w", words(F.col("text")))
    with_lines = with_words.withColumn("h", F.transform("w", lambda w: F.xxhash64(w))).withColumn(
        "l", F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    )
    hashes = F.when(
        F.size("h") >= window,
        F.transform(F.slice("h", F.lit(1), F.size("h") - (window - 1)), lambda h, i: F.xxhash64(h, *(F.get(F.col("h"), i + k) for k in range(1, window)))),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = with_lines.withColumn("x", hashes).select(
        "doc",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("x"), window).alias("n_repeat_words"),
        F.size(F.array_distinct("h")).cast("long").alias("n_distinct_words"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit("[.,;:!?]")).cast("long").alias("n_marks"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumns({name: make() for name, make in TESTED.items()})


def _foil_gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def _cuts(rows: DataFrame, names: list[str], bins: int) -> dict[str, list[float]]:
    """Thresholds to try: quantiles of all values, of the values over 0 and of the values of bad rows. A statistic that
    is 0 for most rows has few quantiles of its own, and what parts good from bad lies between the others."""
    share = [k / bins for k in range(bins + 1)]
    views = {"all": lambda c: F.col(c), "some": lambda c: F.when(F.col(c) > 0, F.col(c)), "bad": lambda c: F.when(F.col("bad"), F.col(c))}
    got = rows.agg(*(F.percentile_approx(of(c), share, 10_000).alias(f"{c} {v}") for c in names for v, of in views.items())).first()
    return {c: sorted({x for v in views for x in got[f"{c} {v}"] or []}) for c in names}


def learn_rules(
    stats: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    bins: int = 16,
    max_rules: int = 6,
    max_conditions: int = 3,
    min_precision: float = 0.85,
    min_cover: int = 5,
) -> list[Rule]:
    """Rules that reject, in order, from the labelled rows that pass the base rule. stats: as statistics() gives them.

    The class to find is label 0. Labels that are null or contradict each other for one document are left out; a
    repeated row counts as often as it occurs. Without labels of both classes there are no rules. Equal gains go to the
    first statistic by name, then to the lower threshold.
    """
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    one = one.agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi")).where("lo = hi").select("id", (F.col("lo") == 0).alias("bad"))
    names = sorted(TESTED)
    # Written before it is filtered: Spark would push the filter into the expressions that make the statistics.
    slim = save(stats.select(F.col(f"doc.`{id_col}`").alias("id"), "base_failed", *names), "slim")
    rows = save(slim.where("NOT base_failed").join(one, "id").withColumn("prune", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(3)) == 0), "labelled")
    drop_saved(slim)
    cuts = _cuts(rows, names, bins)
    if not any(cuts.values()):
        return []
    # The bin of a value: how many cuts lie below it.
    bins_of = F.array(*(F.struct(F.lit(c).alias("f"), sum((F.col(c) > v).cast("int") for v in cuts[c]).alias("b")) for c in names))
    binned = save(rows.select("bad", "prune", *names, bins_of.alias("bins")), "binned")
    drop_saved(rows)
    rules: list[Rule] = []
    left = binned
    for _ in range(max_rules):
        rule: Rule = ()
        while len(rule) < max_conditions:
            counts = left.where(~F.col("prune") & holds(rule)).select("bad", F.explode("bins").alias("x")).groupBy("x.f", "x.b")
            found = counts.agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            best = _best_condition(found, cuts)
            if best is None:
                break
            rule = (*rule, best[0])
            if best[1] == 0:
                break
        if not rule:
            break
        rule = _pruned(left, rule)
        p, n = _cover(left.where("prune"), rule)
        if p < min_cover or p / (p + n) < min_precision:
            break
        rules.append(rule)
        left = left.where(~holds(rule))
    drop_saved(binned)
    return rules


def _best_condition(found: list, cuts: dict[str, list[float]]) -> tuple[Condition, int] | None:
    """The condition of greatest gain and the wrong rows it still covers, from counts by (statistic, bin)."""
    best, gain = None, 1e-9
    for f in sorted(cuts):
        at = {r["b"]: (r["p"], r["n"]) for r in found if r["f"] == f}
        p0, n0 = (sum(v[k] for v in at.values()) for k in (0, 1))
        if not p0:
            return None
        below_p = below_n = 0
        for b, threshold in enumerate(cuts[f]):
            p, n = at.get(b, (0, 0))
            below_p, below_n = below_p + p, below_n + n
            for above, (cp, cn) in ((False, (below_p, below_n)), (True, (p0 - below_p, n0 - below_n))):
                if (cp, cn) != (p0, n0) and (g := _foil_gain(cp, cn, p0, n0)) > gain:
                    best, gain = (Condition(f, above, threshold), cn), g
    return best


def _cover(rows: DataFrame, rule: Rule) -> tuple[int, int]:
    r = rows.where(holds(rule)).agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).first()
    return r["p"], r["n"]


def _pruned(rows: DataFrame, rule: Rule) -> Rule:
    """The prefix of the rule with the best (p - n) / (p + n) on the pruning rows; the shorter of equals."""
    prefixes = [rule[: k + 1] for k in range(len(rule))]
    sums = [x for k, r in enumerate(prefixes) for x in (F.count_if(holds(r) & F.col("bad")).alias(f"p{k}"), F.count_if(holds(r) & ~F.col("bad")).alias(f"n{k}"))]
    got = rows.where("prune").agg(*sums).first()
    worth = [(got[f"p{k}"] - got[f"n{k}"]) / max(1, got[f"p{k}"] + got[f"n{k}"]) for k in range(len(rule))]
    return prefixes[max(range(len(rule)), key=lambda k: (worth[k], -k))]


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, the text of the rule that fired or null): the list as ordered conditional expressions."""
    kept, fired = F.when(F.col("base_failed"), F.lit(False)), F.when(F.col("base_failed"), F.lit("base"))
    for rule in rules:
        kept, fired = kept.when(holds(rule), F.lit(False)), fired.when(holds(rule), F.lit(" and ".join(map(str, rule))))
    return kept.otherwise(F.lit(True)), fired.otherwise(F.lit(None).cast("string"))


def judge(docs: DataFrame, labels: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """docs with ``kept`` and ``fired_rule``; a row's verdict depends on its own text and the rules alone.

    Texts are read twice, for the rules and for the verdicts, and no copy of them is written. A null or empty text fails
    the base rule; repeated rows share their verdict; an empty table gives an empty result; without labels the base rule
    judges alone. If docs has columns of the new names, those stay as they are and the new ones get an underscore.
    """
    stats = statistics(docs, text_col)
    rules = learn_rules(stats, labels, **how)
    kept, fired = verdict(rules)
    used = sorted({c.statistic for rule in rules for c in rule})
    # Spark pushes a filter on ``kept`` into the expressions that make the statistics, but not below a generator.
    judged = stats.select("doc", F.explode(F.array(F.struct("base_failed", *used))).alias("s")).select("doc", "s.*")
    return judged.select(*parts(docs.columns), kept.alias(fresh(docs.columns, "kept")), fired.alias(fresh(docs.columns, "fired_rule")))


def kept_rows(docs: DataFrame, labels: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that judge() keeps, with docs' columns as they were: nulls, repeated rows, empty tables and
    clashing names as there."""
    return judge(docs, labels, text_col, **how).where(F.col(fresh(docs.columns, "kept"))).select(*(F.col(f"`{c}`") for c in docs.columns))
