"""Quality rules as learned decision lists: threshold conjunctions over text statistics, emitted as ordered Spark conditions.

All in DataFrame functions. Statistics are expressions on one row's text. Rules are learned by sequential covering from labelled
rows: candidate thresholds are quantiles of each statistic; one grouping counts the rows that fall between the same ones; from these counts
each step adds the threshold of best precision gain; a rule is pruned on held-back rows and kept if it is precise there; what it covers is set aside
and the next one is grown. At most SAMPLE labelled rows are used (those of smallest hashed doc_id); statistics and
verdicts cover all rows.

Null text has no words and fails the base rules. Rows that repeat are judged alike, each comes back. Without labelled
rows (or with too few bad ones for a rule to be trusted) the list is empty and only the base rules decide. Null labels are no labels. Further columns pass
through. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from brinewatch.llm.tables import saved

SAMPLE = 20_000
WINDOW = 5
SHARES = [0.005, 0.01, 0.02, *(i / 24 for i in range(1, 24)), 0.98, 0.99, 0.995]
MOST_RULES = 6
MOST_LITERALS = 3
PRECISION = 0.99  # a rule grows until it is this precise
TRUST = 0.95  # of bad rows among those a rule covers on rows it wasn't grown on, and of all it covers and one more
LEAST = 5  # bad rows that it covers there
BLANKS = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where body names it in an inner function."""
    return F.transform(F.array(value), body)[0]


def _repeated(h: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more, by the words' hashes."""

    def windows(h: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return F.when(F.size(h) >= WINDOW, made).otherwise(F.array().cast("array<bigint>"))

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = F.filter(s, lambda e, j: (F.get(s, j - 1)["x"].eqNullSafe(e["x"])) | (F.get(s, j + 1)["x"].eqNullSafe(e["x"])))
            at = F.array_sort(F.transform(same, lambda e: e["i"]))
            start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("end"))
            step = lambda a, p: F.struct((a["n"] + (p + WINDOW - F.greatest(p, a["end"])).cast("bigint")).alias("n"), (p + WINDOW).alias("end"))
            return F.aggregate(at, start, step)["n"]

        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(let(ordered, twice))

    return let(windows(h), covered)


def statistics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_capitals, n_stops of a text."""
    t = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            let(F.transform(w, lambda x: F.xxhash64(x)), _repeated).alias("n_repeat_words"),
            F.regexp_count(t, F.lit(r"[A-Z]")).cast("bigint").alias("n_capitals"),
            F.regexp_count(t, F.lit(r"[!?]")).cast("bigint").alias("n_stops"),
        )

    return let(F.filter(F.split(t, BLANKS), lambda x: x != ""), of_words)


def measures(s: Column) -> dict[str, Column]:
    """What rules may set thresholds on. Of equally good thresholds the first measure's is taken, so signs of junk come before mere shape."""
    words = F.greatest(s["n_words"], F.lit(1)).cast("double")
    return {
        "symbols_a_word": s["n_symbols"] / words,
        "dup_lines": s["n_dup_lines"].cast("double"),
        "repeated_share": s["n_repeat_words"] / words,
        "words": s["n_words"].cast("double"),
        "word_length": s["word_chars"] / words,
        "capitals_a_word": s["n_capitals"] / words,
        "stops_a_word": s["n_stops"] / words,
    }


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


@dataclass(frozen=True)
class Literal:
    """measure >= threshold, or below it."""

    measure: str
    above: bool
    threshold: float

    def holds(self, of: dict[str, Column]) -> Column:
        return (of[self.measure] >= self.threshold) if self.above else (of[self.measure] < self.threshold)

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.above else '<'} {self.threshold:g}"


Rule = tuple[Literal, ...]


def _all(rule: Rule, of: dict[str, Column]) -> Column:
    out = F.lit(True)
    for x in rule:
        out = out & x.holds(of)
    return out


@dataclass(frozen=True)
class Trial:
    """A rule, and what it covers of the rows that no earlier rule covers, of those it wasn't grown on: bad ones, good ones, and its share of all bad ones."""

    rule: Rule
    bad: int
    good: int
    recall: float


#: Labelled rows that fall in the same bins of all measures: (number, bad, grown on, bin of each measure).
Cell = tuple[int, bool, bool, tuple[int, ...]]


def _covered(cells: list[Cell], rule: Rule, place: dict[str, int], limits: dict[str, list[float]]) -> list[Cell]:
    """Bin k of a measure holds values from its k-th limit (counted from 1) up to below the next."""
    bounds = [(place[x.measure], x.above, limits[x.measure].index(x.threshold)) for x in rule]
    return [c for c in cells if all((c[3][m] > k) == above for m, above, k in bounds)]


def _counted(cells: list[Cell]) -> tuple[int, int]:
    """How many are good, and how many are bad."""
    bad = sum(n for n, b, _, _ in cells if b)
    return sum(n for n, *_ in cells) - bad, bad


def _best(cells: list[Cell], limits: dict[str, list[float]]) -> Literal | None:
    """The literal of the largest information gain: positives covered times the gain of their log precision. Ties go to the first measure and limit."""
    good, bad = _counted(cells)
    best, gain = None, 0.0
    if not bad:
        return None
    now = math.log2(bad / (good + bad))
    for m, (name, marks) in enumerate(limits.items()):
        bins = [[0, 0] for _ in range(len(marks) + 1)]
        for n, b, _, at in cells:
            bins[at[m]][b] += n
        below = [0, 0]
        for k, t in enumerate(marks):
            below = [below[0] + bins[k][0], below[1] + bins[k][1]]
            for above, (g, b) in ((False, below), (True, [good - below[0], bad - below[1]])):
                if b and (x := b * (math.log2(b / (g + b)) - now)) > gain + 1e-9:
                    best, gain = Literal(name, above, t), x
    return best


def _trusted(good: int, bad: int) -> bool:
    """Whether that many good and bad rows, and one more good one, leave a rule precise enough."""
    return bad >= TRUST * (bad + good + 1)


def covering(cells: list[Cell], limits: dict[str, list[float]]) -> list[Trial]:
    """Sequential covering: a rule is grown literal by literal on two thirds of the rows; on the last third its literals go one by one as long as that
    doesn't make it less precise there; it is kept if it covers at least LEAST bad rows there at a precision of TRUST, and is trusted over all rows."""
    place = {name: m for m, name in enumerate(limits)}
    every = sum(n for n, b, grown, _ in cells if b and not grown)
    trials: list[Trial] = []
    for _ in range(MOST_RULES):
        rule: Rule = ()
        inside = grown = [c for c in cells if c[2]]
        while len(rule) < MOST_LITERALS and (x := _best(inside, limits)) is not None:
            rule = (*rule, x)
            inside = _covered(grown, rule, place, limits)
            good, bad = _counted(inside)
            if bad >= PRECISION * (good + bad):
                break
        held = [c for c in cells if not c[2]]
        worth = lambda r: (lambda g, b: (b - g) / (b + g) if b + g else -1.0)(*_counted(_covered(held, r, place, limits)))
        while len(rule) > 1:
            shorter = max((rule[:k] + rule[k + 1 :] for k in range(len(rule) - 1, -1, -1)), key=worth)
            if worth(shorter) < worth(rule):
                break
            rule = shorter
        if not rule:
            break
        good, bad = _counted(_covered(held, rule, place, limits))
        if bad < LEAST or bad < TRUST * (good + bad) or not _trusted(*_counted(_covered(cells, rule, place, limits))):
            break
        trials.append(Trial(rule, bad, good, bad / every))
        gone = set(map(id, _covered(cells, rule, place, limits)))
        cells = [c for c in cells if id(c) not in gone]
    return trials


def _reached(limits: list[float], name: str) -> Column:
    """How many limits a measure reaches."""
    return F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x <= F.col(name)))


def learn(labelled: DataFrame) -> list[Trial]:
    """Rules for bad rows from (doc_id, bad int, s struct), in the order they apply.

    Spark bins the rows' measures at their quantiles and counts equal rows, in one grouping; no more than SAMPLE counts come back, whatever the table's size.
    """
    names = list(measures(F.col("s")))
    table = saved(labelled.select("bad", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0).alias("grown"), *(c.alias(n) for n, c in measures(F.col("s")).items())), "labelled")
    marks = table.agg(*(F.percentile(n, F.array(*map(F.lit, SHARES))).alias(n) for n in names)).first()
    if marks[names[0]] is None:
        return []
    limits = {n: sorted({float(x) for x in marks[n]} | {float(x) * 1.0000001 + 1e-9 for x in marks[n]}) for n in names}
    rows = table.groupBy("bad", "grown", *(_reached(limits[n], n).alias(f"{n}_bin") for n in names)).agg(F.count("*").alias("n")).collect()
    cells = sorted((r.n, bool(r.bad), r.grown, tuple(r[f"{n}_bin"] for n in names)) for r in rows)  # in an order of their own, so two runs learn the same
    return covering(cells, limits)


def decision(rules: list[Rule], s: Column) -> Column:
    """The first rule that holds, as text; null if none does."""
    of = measures(s)
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(_all(rule, of), F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Trial]:
    """Rules, with what they are worth on rows they weren't grown on, from docs(doc_id, text) and labels(doc_id, quality: 0 is bad), over at most sample labelled rows."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return learn(rows.select("doc_id", (F.col("quality") == 0).cast("int").alias("bad"), statistics(F.col("text")).alias("s")))


#: The columns that judged adds.
ADDED = ("_s", "_rule", "_base_failed", "_kept")


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with _s (statistics), _rule (the rule that rejects, or null), _base_failed and _kept added; columns of docs of these names are replaced."""
    rules = [t.rule for t in learned(docs, labels, sample)]
    out = docs.drop(*ADDED).withColumn("_s", statistics(F.col("text")))
    out = out.withColumn("_base_failed", base_failed(F.col("_s"))).withColumn("_rule", decision(rules, F.col("_s")))
    return out.withColumn("_kept", ~F.col("_base_failed") & F.col("_rule").isNull())
