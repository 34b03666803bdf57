"""Quality rules: text statistics as native expressions, and a decision list learned from labels.

Statistics and rules are DataFrame expressions only. Repeated 8-word windows are found inside each row:
word hashes are combined pairwise three times (1, 2, 4, 8 words), and only rows whose windows repeat
are sorted by hash to mark covered words, so a row costs n log n and nothing is shuffled.

The list is learned on the driver from at most MAX_LABELLED labelled rows, chosen by a hash of doc_id:
rules for the rarer (low) class grow by information gain on two thirds of the rows, are pruned on the
other third, and are kept while they are precise there; what a rule covers is then taken away. The
rules become one ordered CASE expression.

A null or empty text has no words. Without labels there are no rules. Repeated labels of a doc_id count once (the
greatest). Literals of equal gain go in the order of FEATURES and cuts. Repeated rows each get a row. Very long texts are counted whole. An empty table
gives an empty result. Extra columns are ignored, whatever their names.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that rules are learned from.
MAX_LABELLED = 20_000
MAX_RULES = 8
MAX_LITERALS = 4
CUTS = 24
MIN_PRECISION = 0.9
WHITE = " \t\n\x0b\x0c\r"
#: The symbols counted.
SYMBOLS = "#*$%&|<>"

FEATURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
    "log_words": "ln(n_words + 1)",
    "stop_share": "n_stops / greatest(n_words, 1)",
}


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the kept columns, the base counts and what the features need."""
    empty = "cast(array() as array<int>)"
    d = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("t", F.btrim("text", F.lit(WHITE)))
    d = d.withColumn("w", F.when(F.col("t") == "", F.array().cast("array<string>")).otherwise(F.split("t", r"[ \t-\r]+")))
    d = d.withColumn("lines", F.expr("filter(split(text, '\\n', -1), x -> btrim(x, '" + WHITE + "') <> '')"))
    d = d.withColumn("n_lines", F.size("lines").cast("bigint"))
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"))
    d = d.withColumn("joined", F.array_join("w", ""))
    plain = F.col("joined")
    for s in SYMBOLS:
        plain = F.replace(plain, F.lit(s), F.lit(""))
    d = d.withColumn("word_chars", F.length("joined").cast("bigint")).withColumn("n_symbols", F.col("word_chars") - F.length(plain))
    d = d.withColumn("stops", F.length("joined") - F.length(F.replace(F.replace("joined", F.lit("."), F.lit("")), F.lit(","), F.lit(""))))
    d = d.select("doc_id", *keep, "n_lines", "n_dup_lines", "word_chars", "n_symbols", F.col("stops").cast("bigint").alias("n_stops"),
                 F.expr("transform(w, x -> xxhash64(x))").alias("h1"))
    pair = "zip_with(slice({0}, 1, greatest(size({0}) - {1}, 0)), slice({0}, {1} + 1, greatest(size({0}) - {1}, 0)), (a, b) -> xxhash64(a, b))"
    d = d.withColumn("n_words", F.size("h1").cast("bigint")).withColumn("n_distinct", F.size(F.array_distinct("h1")).cast("bigint"))
    d = d.withColumn("h2", F.expr(pair.format("h1", 1))).withColumn("h4", F.expr(pair.format("h2", 2))).withColumn("h8", F.expr(pair.format("h4", 4)))
    d = d.withColumn("s", F.expr("CASE WHEN size(array_distinct(h8)) < size(h8) THEN array_sort(transform(h8, (x, i) -> struct(x as x, i as i))) END"))
    d = d.withColumn("p", F.expr(f"""CASE WHEN s IS NOT NULL THEN array_sort(array_distinct(flatten(zip_with(
        slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (a, b) -> CASE WHEN a.x = b.x THEN array(a.i, b.i) ELSE {empty} END)))) END"""))
    d = d.withColumn("n_repeat_words", F.expr("""CASE WHEN p IS NULL THEN 0L ELSE aggregate(zip_with(p, slice(p, 2, size(p)),
        (a, b) -> least(8, coalesce(b - a, 8))), 0L, (acc, x) -> acc + x) END"""))
    return d.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_stops")


def features(stats: DataFrame) -> DataFrame:
    return stats.withColumns({k: F.expr(v).cast("double") for k, v in FEATURES.items()})


@dataclass(frozen=True)
class Literal:
    feature: str
    at_least: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.cut if self.at_least else F.col(self.feature) < self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.cut:.6g}"


Rule = tuple[Literal, ...]


def _bits(flags) -> int:
    return int("".join("1" if f else "0" for f in flags) or "0", 2)


def learn(rows: list[tuple], names: list[str]) -> list[Rule]:
    """Rules for low quality from (features..., label) rows. Coverage is kept in bit sets."""
    rows = [r for r in rows if r[-1] is not None and all(v is not None and math.isfinite(v) for v in r[:-1])]
    if not rows:
        return []
    low = _bits(r[-1] == 0 for r in rows)
    grow = _bits(i % 3 != 0 for i in range(len(rows)))
    prune = _bits(i % 3 == 0 for i in range(len(rows)))
    literals: dict[Literal, int] = {}
    for k, name in enumerate(names):
        values = sorted(r[k] for r in rows)
        distinct = sorted({values[len(values) * q // (CUTS + 1)] for q in range(1, CUTS + 1)} | {v for v in [values[-1], *values[-max(2, len(values) // 50) :: max(1, len(values) // 400)]]})
        for cut in distinct:
            if cut > values[0]:
                literals[Literal(name, True, cut)] = above = _bits(r[k] >= cut for r in rows)
                literals[Literal(name, False, cut)] = ~above & ((1 << len(rows)) - 1)
    rules: list[Rule] = []
    everything = (1 << len(rows)) - 1
    left = everything
    cover = lambda rule, of: _cover(rule, literals, of)
    while len(rules) < MAX_RULES:
        rule: Rule = ()
        held = left & grow
        while len(rule) < MAX_LITERALS:
            p0, n0 = (held & low).bit_count(), (held & ~low).bit_count()
            if not p0 or not n0:
                break
            base = math.log2(p0 / (p0 + n0))
            best, gain = None, 1e-9
            for lit, bits in literals.items():
                p = (held & bits & low).bit_count()
                if p:
                    g = p * (math.log2(p / (held & bits).bit_count()) - base)
                    if g > gain:
                        best, gain = lit, g
            if best is None:
                break
            rule += (best,)
            held &= literals[best]
        worth = lambda r: _worth(cover(r, left & prune), low)
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        got = cover(rule, left & prune) if rule else 0
        if not rule or not got or (got & low).bit_count() < MIN_PRECISION * got.bit_count() or (got & low).bit_count() < 3:
            break
        rules.append(rule)
        left &= ~cover(rule, everything)
    return rules


def _cover(rule: Rule, literals: dict, of: int) -> int:
    for lit in rule:
        of &= literals[lit]
    return of


def _worth(covered: int, low: int) -> float:
    p, n = (covered & low).bit_count(), (covered & ~low).bit_count()
    return (p - n) / (p + n) if p + n else -1.0


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[tuple]:
    """At most `most` labelled feature rows, by hash of doc_id."""
    picks = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = features(statistics(docs.select("doc_id", "text").join(F.broadcast(picks), "doc_id"), "quality"))
    kept = rows.select(*FEATURES, F.col("quality").cast("int")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return [tuple(r) for r in kept.collect()]


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(keep, number of the rule that fired or 0) as one ordered conditional each."""
    keep, fired = F.lit(True), F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        test = rule[0].column()
        for lit in rule[1:]:
            test = test & lit.column()
        keep, fired = F.when(test, False).otherwise(keep), F.when(test, i).otherwise(fired)
    return keep, fired


def apply_rules(docs: DataFrame, rules: list[Rule], min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    keep, fired = verdict(rules)
    return features(statistics(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & keep).alias("kept"), fired.alias("rule"))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return apply_rules(docs, learn(labelled_rows(docs, labels), list(FEATURES)))
