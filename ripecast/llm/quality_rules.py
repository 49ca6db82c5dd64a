"""Quality rules as learned decision lists.

Text statistics are plain Spark expressions, computed in the row. From labelled rows, sequential
covering learns rules that reject: a rule grows threshold by threshold (the literal with the best information
gain over quantile bins), is pruned on rows it was not grown on, and takes the rows it covers out of the
next round. The list becomes one ordered CASE expression. Each step is one aggregation by feature and bin, so the
driver sees a few hundred counts, never the rows.

The labelled sample is bounded by MAX_LABELS rows (those smallest by a hash of the id); the statistics
and the verdicts cover every document.

Defined results: a null or empty text has no words and fails the base rules; rows without label teach
nothing; repeated label rows count repeatedly; an empty label table, or one with a single class, gives an empty list that rejects
nothing beyond the base rules; an empty document table gives no rows. Other input columns are
kept, those with the names of ours replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripecast.llm import text
from ripecast.sources.files import materialize

SYMBOLS = "#*$%&|<>"  # fixed value
MAX_LABELS = 20_000
BINS = 24
MAX_RULES = 8
MAX_LITERALS = 3
LEAST_ROWS = 5         # rejected rows that a rule must cover, grown and pruned rows together
LEAST_PRECISION = 0.97  # on the rows kept back for pruning

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_word(name: str) -> str:
    return f"IF(n_words > 0, {name} / n_words, 0D)"


#: What rules may test, as SQL over the statistics.
FEATURES = {
    "words": "CAST(n_words AS double)",
    "chars_per_word": _per_word("word_chars"),
    "symbols_per_word": _per_word("n_symbols"),
    "dup_lines_per_word": _per_word("n_dup_lines"),
    "repeat_share": _per_word("n_repeat_words"),
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds STATISTICS and base_failed.

    Words in repeated three-word windows: window hashes with their places are sorted, equal neighbours mark their
    places, and the marked places are measured as a union of runs of three. The sort runs only in
    rows that have a repeated window.
    """
    text.require(docs, "text")
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tmp = [f"__{x}" for x in ("body", "words", "windows", "lines", "pairs", "places")]
    b, w, t, ln, p, q = tmp
    rows = docs.drop(*STATISTICS, "base_failed").withColumn(b, body)
    rows = rows.withColumns({
        w: text.words(F.col(b)),
        ln: F.filter(F.split(b, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    rows = rows.withColumn(t, F.when(F.size(w) >= 3, F.slice(F.transform(
        w, lambda x, i: F.xxhash64(x, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))))
    rows = rows.withColumns({
        "n_words": F.size(w).cast("bigint"),
        "word_chars": F.length(F.translate(b, " \t\n\x0b\x0c\r", "")).cast("bigint"),
        "n_symbols": (F.length(b) - F.length(F.translate(b, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("bigint"),
        p: F.when(F.size(t) > F.size(F.array_distinct(t)), F.sort_array(F.transform(
            t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    }).drop(b, w, t, ln)
    rows = rows.withColumn(q, F.sort_array(F.transform(F.filter(
        p, lambda x, k: (F.get(F.col(p), k - 1)["h"] == x["h"]) | (F.get(F.col(p), k + 1)["h"] == x["h"])), lambda x: x["i"]))).drop(p)
    covered = F.aggregate(F.transform(q, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(F.col(q), k + 1), x + 3) - x)),
                          F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop(q)
    # Filters are not pushed below a generator; below, they would repeat the word arrays in every element's expression.
    rows = rows.withColumn("__found", F.explode(F.array(F.struct(*STATISTICS)))).drop(*STATISTICS)
    return rows.withColumns({n: F.col(f"__found.{n}") for n in STATISTICS}).drop("__found").withColumn(
        "base_failed", F.expr(BASE_FAILED))


@dataclass(frozen=True)
class Literal:
    feature: str
    at_least: bool
    threshold: float

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.at_least else '<'} {self.threshold!r}D"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds rejects, none keeps."""
    rules: tuple[tuple[Literal, ...], ...] = field(default=())

    def rule_number(self) -> Column:
        """1-based number of the first rule that holds, null if none does: an ordered CASE over the statistics."""
        cases = "".join(f" WHEN {' AND '.join(x.sql() for x in r)} THEN {n}" for n, r in enumerate(self.rules, 1))
        return F.expr(f"CASE{cases} END") if cases else F.lit(None).cast("int")

    def apply(self, rows: DataFrame) -> DataFrame:
        """Adds `rule` and `kept` to rows that have the statistics."""
        ruled = rows.withColumn("rule", self.rule_number())
        return ruled.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """Statistics, features and label (1: reject) of a bounded number of labelled documents."""
    text.require(labels, "doc_id", "quality")
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(
        "doc_id IS NOT NULL AND quality IS NOT NULL")
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "quality").limit(max_labels)
    # At most max_labels pairs of numbers: safe to broadcast.
    rows = text.only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rated = with_statistics(rows).filter("NOT base_failed")
    return rated.select(
        (F.col("quality") == 0).cast("int").alias("reject"),
        (F.pmod(F.crc32(F.concat(F.lit("fold"), F.col("doc_id")).cast("binary")), F.lit(3)) == 0).alias("held"),
        *(F.expr(sql).alias(name) for name, sql in FEATURES.items()))


def learn(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DecisionList:
    sample = materialize(labelled_sample(docs, labels, max_labels), "labelled-statistics")
    names = list(FEATURES)
    spots = [k / BINS for k in range(BINS)]
    # Thresholds from the rejected rows and from all rows, so that a rare class has its own.
    cut = sample.agg(*(F.percentile(n, spots).alias(f"a_{n}") for n in names),
                     *(F.percentile(F.when(F.col("reject") == 1, F.col(n)), spots).alias(f"r_{n}") for n in names)).first()
    edges = {n: sorted({round(v, 9) for v in [*(cut[f"a_{n}"] or []), *(cut[f"r_{n}"] or [])]}) for n in names}

    def bin_of(name: str) -> Column:
        if not edges[name]:
            return F.lit(0)
        return F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges[name])), lambda e: e <= F.col(name)))

    binned = sample.groupBy("reject", "held", *(
        bin_of(n).alias(n) for n in names)).agg(F.count("*").alias("weight"))
    binned = materialize(binned, "labelled-bins")

    def counts(rows: DataFrame) -> dict[str, dict[int, list[int]]]:
        """Rows by feature, bin and label: at most features x bins x 2 counts."""
        long = rows.select("reject", "weight", F.explode(F.array(*(
            F.struct(F.lit(n).alias("feature"), F.col(n).alias("bin")) for n in names))).alias("f")).groupBy(
                "f.feature", "f.bin", "reject").agg(F.sum("weight").alias("weight"))
        out: dict[str, dict[int, list[int]]] = {n: {} for n in names}
        for r in long.collect():
            out[r.feature].setdefault(r.bin, [0, 0])[r.reject] += r.weight
        return out

    def totals(rows: DataFrame) -> tuple[int, int]:
        got = rows.agg(F.sum(F.when(F.col("reject") == 0, F.col("weight"))), F.sum(F.when(F.col("reject") == 1, F.col("weight")))).first()
        return got[0] or 0, got[1] or 0

    def holds(rule: list[tuple[str, bool, int]]) -> Column:
        cond = F.lit(True)
        for n, at_least, b in rule:
            cond = cond & (F.col(n) >= b if at_least else F.col(n) < b)
        return cond

    def entropy_gain(p: int, n: int, p0: int, n0: int) -> float:
        return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else float("-inf")

    rules: list[tuple[Literal, ...]] = []
    left = binned
    while len(rules) < MAX_RULES:
        rule: list[tuple[str, bool, int]] = []
        n0, p0 = totals(left.filter("NOT held"))
        while p0 and n0 and len(rule) < MAX_LITERALS:
            best = None
            for feature, bins in sorted(counts(left.filter("NOT held").filter(holds(rule))).items()):
                below = [0, 0]
                for b in range(1, len(edges[feature]) + 1):
                    got = bins.get(b - 1, [0, 0])
                    below = [below[0] + got[0], below[1] + got[1]]
                    for at_least, (n, p) in ((True, (n0 - below[0], p0 - below[1])), (False, tuple(below))):
                        gain = entropy_gain(p, n, p0, n0)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, feature, at_least, b, n, p)
            if best is None:
                break
            rule.append(best[1:4])
            n0, p0 = best[4], best[5]
        if not rule:
            break
        # Prune from the end as long as the rows kept back don't get worse.
        worth = {k: totals(left.filter("held").filter(holds(rule[:k]))) for k in range(1, len(rule) + 1)}
        score = {k: (p - n) / (p + n) if p + n else -1.0 for k, (n, p) in worth.items()}
        size = max(score, key=lambda k: (score[k], -k))
        rule = rule[:size]
        n, p = totals(left.filter(holds(rule)))
        held_n, held_p = worth[size]
        if p < LEAST_ROWS or held_p == 0 or held_p / (held_p + held_n) < LEAST_PRECISION:
            break
        rules.append(tuple(Literal(f, at_least, float(edges[f][b - 1])) for f, at_least, b in rule))
        left = left.filter(~holds(rule))
    return DecisionList(tuple(rules))


def judge(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """Documents with STATISTICS, base_failed, rule and kept."""
    return learn(docs, labels, max_labels).apply(with_statistics(docs))
