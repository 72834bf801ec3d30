"""Quality rules as a learned decision list, in DataFrame functions only.

Features of every text are counted by built-in functions. Rules are learned by sequential covering from counts of
labelled rows: a rule grows, one threshold at a time, by the condition of highest information gain among the quantiles
of all features, is then cut back to the prefix that is best on rows it did not grow on, and is taken if enough rows
support it there and it is precise. Its rows leave, and the next rule is sought. The list becomes one CASE expression in
that order. Every step groups (feature, bin) counts, so the driver sees a few hundred numbers whatever the table's size.

Defined results: a null or empty text has no words and fails the base rule; without labels of both kinds the list is empty and
the base rule decides; rows with several labels count once, as bad if any label is; repeated rows are rows of their own;
an empty table gives no rows; a text of any length is counted whole in one task, in memory in proportion to its words;
other columns of docs stay, but for those with names of features or results, which are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, unused, whole_rows

WORD = r"([^\x20\x09-\x0D]+)"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
FEATURES = ("symbols_per_word", "dup_line_share", "repeat_share", "mean_word", "capital_share", "bangs_per_word", "digit_share", "n_words")
BINS = 32
#: Rules that fail on the rows kept for pruning, in a row, before the search ends.
PATIENCE = 3
LEAST_SUPPORT = 5
LEAST_PRECISION = 0.9


@dataclass(frozen=True)
class Condition:
    feature: str
    #: True: above the threshold; False: at most the threshold.
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _once(value: Column, body) -> Column:
    """body(value), with value worked out once for each row."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside windows of three words that occur twice or more in the text."""

    def covered(pos: Column) -> Column:
        reach = F.transform(pos, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(pos, i + 1) - p, F.lit(3))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(s: Column) -> Column:
        twice = lambda x, i: (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return _once(F.sort_array(F.transform(F.filter(s, twice), lambda x: x["p"])), covered)

    def count(h: Column) -> Column:
        # most texts repeat no window, which a hash set tells without a sort
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_once(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), places))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_once(hashes, count))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts and shares that rules use; columns of these names are replaced."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    words, filled = unused(docs, "quality_words"), unused(docs, "quality_lines")
    out = docs.withColumns({words: F.regexp_extract_all(t, F.lit(WORD), F.lit(1)), filled: lines})
    chars = F.length(t)
    out = out.withColumns({
        "n_words": F.size(words).cast("long"), "word_chars": _without(t, SPACES).cast("long"), "n_symbols": (chars - _without(t, SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(filled) - F.size(F.array_distinct(filled))).cast("long"), "n_repeat_words": _repeat_words(F.col(words)), "n_lines": F.size(filled).cast("long"),
        "n_capitals": (chars - _without(t, CAPITALS)).cast("long"), "n_bangs": (chars - _without(t, "!")).cast("long"), "n_digits": (chars - _without(t, DIGITS)).cast("long"),
    }).drop(words, filled)
    per = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return out.withColumns({
        "symbols_per_word": per("n_symbols", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"), "mean_word": per("word_chars", "n_words"),
        "capital_share": per("n_capitals", "word_chars"), "bangs_per_word": per("n_bangs", "n_words"), "digit_share": per("n_digits", "word_chars"),
    })


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(holds(rule), i) if out is None else out.when(holds(rule), i)
    return out if out is not None else F.lit(None).cast("int")


def _gain(p: float, n: float, all_p: float, all_n: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(all_p / (all_p + all_n))) if p > 0 else 0.0


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many of the cuts the value is above."""
    if not cuts:
        return F.lit(0)
    return F.aggregate(F.array(*[F.lit(float(c)) for c in cuts]), F.lit(0), lambda a, c: a + (value > c).cast("int"))


def learn(rows: DataFrame, bad: str = "bad", key: str = "key", features: tuple[str, ...] = FEATURES, max_rules: int | None = None, max_conditions: int | None = None, patience: int = PATIENCE) -> list[Rule]:
    """Rules for rows with the features, bad (int) and key (long, spread evenly; a third of keys is kept for pruning).

    Covering ends by itself: a rule grows while a condition gains, and rules are sought while one is found whose support
    and precision hold; where one does not, the next best first condition is tried, `patience` times in a row. Limits on
    rules and conditions are for those who want a shorter list. Ties go to the feature listed first, then the lower cut.
    """
    cuts = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), [i / BINS for i in range(1, BINS)], 10_000).alias(f) for f in features]).first()
    cuts = {f: sorted(set(cuts[f] or [])) for f in features}
    binned = {f: _bin(F.col(f), cuts[f]) for f in features}
    rows = rows.select(bad, key, *features, F.array(*[F.struct(F.lit(f).alias("feature"), binned[f].alias("bin")) for f in features]).alias("bins"))
    rows = materialise(rows, "rule-rows")
    grow, prune, rules = F.pmod(F.col(key), F.lit(3)) < 2, F.pmod(F.col(key), F.lit(3)) == 2, []
    left, failed = F.lit(True), []
    while (max_rules is None or len(rules) < max_rules) and len(failed) < patience:
        rule: Rule = ()
        while max_conditions is None or len(rule) < max_conditions:
            counts = rows.where(left & grow & holds(rule)).select(bad, F.explode("bins").alias("b")).groupBy("b.feature", "b.bin").agg(F.sum(bad).alias("p"), F.sum(1 - F.col(bad)).alias("n")).collect()
            by: dict[str, dict[int, tuple[int, int]]] = {}
            for r in counts:
                by.setdefault(r.feature, {})[r.bin] = (r.p, r.n)
            total = [sum(x[i] for x in by.get(features[0], {}).values()) for i in (0, 1)]
            if not total[0] or not total[1]:
                break
            best = (0.0, None)
            for f in features:
                p = n = 0
                for i, cut in enumerate(cuts[f]):
                    p, n = p + by[f].get(i, (0, 0))[0], n + by[f].get(i, (0, 0))[1]
                    for above, a, b in ((False, p, n), (True, total[0] - p, total[1] - n)):
                        gain = _gain(a, b, *total)
                        if gain > best[0] + 1e-9 and a >= LEAST_SUPPORT and (rule or Condition(f, above, float(cut)) not in failed):
                            best = (gain, Condition(f, above, float(cut)))
            if best[1] is None:
                break
            rule += (best[1],)
        if not rule:
            break
        prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
        got = rows.where(left & prune).agg(*[F.sum(F.when(holds(r), F.col(bad) if want else 1 - F.col(bad)).otherwise(0)).alias(f"{'pn'[not want]}{k}") for k, r in enumerate(prefixes) for want in (True, False)]).first()
        worth = [((got[f"p{k}"] or 0) - (got[f"n{k}"] or 0)) / ((got[f"p{k}"] or 0) + (got[f"n{k}"] or 0) + 2) for k in range(len(prefixes))]
        k = max(range(len(prefixes)), key=lambda i: (worth[i], -i))
        p, n = got[f"p{k}"] or 0, got[f"n{k}"] or 0
        if p < LEAST_SUPPORT or p < LEAST_PRECISION * (p + n):
            failed.append(rule[0])
            continue
        failed = []
        rules.append(prefixes[k])
        left = left & ~holds(prefixes[k])
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[DataFrame, list[Rule]]:
    """docs (without the text) with features, base_failed, rule and kept, and the rules learned from labels."""
    packed = docs.select(whole_rows(docs, (text,)).alias("doc"), docs[id_col].alias("id"), docs[text].alias("text"))
    rows = materialise(with_features(packed, "text").drop("text"), "quality-features")
    made = [c for c in rows.columns if c not in ("doc", "id")]
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg(F.max(F.when(F.col(label) > 0, 0).otherwise(1)).alias("bad"))
    learned = rows.drop("doc").join(known, F.col("id") == F.col("labelled")).where(~base_failed()).withColumn("key", F.xxhash64(F.col("id").cast("string"), F.lit("quality")))
    rules = learn(learned.select("bad", "key", *FEATURES))
    out = rows.withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    made += ["base_failed", "rule", "kept"]
    return out.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c not in (text, *made)], *made), rules


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, _ = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
