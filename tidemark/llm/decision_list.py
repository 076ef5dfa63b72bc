"""Quality rules as a learned decision list of threshold conjunctions.

Statistics of each text are Spark expressions. Rules are learned by sequential covering from labelled
rows: a rule grows by the condition with the largest information gain until it covers no good row,
is pruned on rows held back, and the rows it covers are set aside before the next one. All counting
is done by Spark over a table of cells: labelled rows with the same quantile bin in every statistic
are one row with counts, and each step of growth is one aggregate over it. The driver sees the
chosen thresholds only. The list is applied as one ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import let, written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


def _windows(words: Column, n: Column) -> Column:
    def at(i: Column) -> Column:
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), at)).otherwise(
        F.array().cast("array<string>")
    )


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more: a window's words reach to the next such
    window's start, and three words at most."""
    placed = F.array_sort(
        F.transform(windows, lambda text, i: F.struct(text.alias("text"), i.alias("i")))
    )

    def repeated(sorted_: Column) -> Column:
        def twice(one: Column, k: Column) -> Column:
            before = F.get(sorted_, k - 1)["text"]
            after = F.get(sorted_, k + 1)["text"]
            return F.coalesce(one["text"] == before, F.lit(False)) | F.coalesce(
                one["text"] == after, F.lit(False)
            )

        return F.sort_array(F.transform(F.filter(sorted_, twice), lambda one: one["i"]))

    def total(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.least(F.coalesce(F.get(at, k + 1), i + 3) - i, F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return F.when(
        F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)
    ).otherwise(let(let(placed, repeated), total))


def _repeated_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return let(lines, lambda kept: F.size(kept) - F.size(F.array_distinct(kept)))


def _count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``stats`` of counts, in place of any column of that name; null text
    counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def of_words(w: Column) -> Column:
        counts = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": _count_of(text, SYMBOL),
            "n_dup_lines": _repeated_lines(text),
            "n_repeat_words": let(let(F.size(w), lambda n: _windows(w, n)), _covered),
            "n_upper": _count_of(text, "[A-Z]"),
            "n_lower": _count_of(text, "[a-z]"),
            "n_marks": _count_of(text, "[!?]"),
            "n_digits": _count_of(text, "[0-9]"),
            "n_breaks": _count_of(text, "\n"),
        }
        return F.struct(*[c.cast("long").alias(n) for n, c in counts.items()])

    return docs.withColumn("stats", let(words, of_words))


def features() -> dict[str, Column]:
    """What conditions are about: counts set against the size of the text, from ``stats``."""
    count = lambda name: F.col(f"stats.{name}").cast("double")
    chars = F.greatest(count("word_chars"), F.lit(1.0))
    words = F.greatest(count("n_words"), F.lit(1.0))
    letters = F.greatest(count("n_upper") + count("n_lower"), F.lit(1.0))
    return {
        "words": count("n_words"),
        "word_length": count("word_chars") / words,
        "symbol_share": count("n_symbols") / chars,
        "upper_share": count("n_upper") / letters,
        "mark_share": count("n_marks") / words,
        "digit_share": count("n_digits") / chars,
        "repeat_share": count("n_repeat_words") / words,
        "dup_line_share": count("n_dup_lines") / (count("n_breaks") + 1.0),
        "line_words": count("n_words") / (count("n_breaks") + 1.0),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def describe(rules: list[Rule]) -> list[str]:
    return [f"bad if {' and '.join(map(str, rule))}" for rule in rules] + ["good otherwise"]


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out &= c
    return out


def learn(
    labelled: DataFrame,
    bad: Column,
    bins: int = 24,
    max_rules: int = 8,
    max_conditions: int = 4,
    min_rows: int = 5,
    min_precision: float = 0.9,
) -> list[Rule]:
    """Rules for rows where ``bad``, from rows with a struct ``features`` and an id ``doc_id``.

    One row in three, by a hash of the id, is held back for pruning. Rows with a null label are left
    out. A rule is kept if ``min_precision`` of what it covers there is bad; learning ends at the
    first rule that is not, or when no bad row is left.
    """
    names = labelled.schema["features"].dataType.names
    rows = written(
        labelled.where(bad.isNotNull()).select(
            "features",
            bad.cast("long").alias("bad"),
            (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"),
        )
    )
    steps = [k / bins for k in range(1, bins)]
    cut = rows.agg(
        *[F.percentile_approx(f"features.{n}", steps, 10_000).alias(n) for n in names]
    ).first()
    if cut is None or cut[names[0]] is None:
        return []
    cuts = {n: sorted(set(cut[n])) for n in names}

    def bin_of(n: str) -> Column:
        """The number of cut points below the value."""
        points = F.array(*[F.lit(float(c)) for c in cuts[n]])
        return F.size(F.filter(points, lambda c: F.col(f"features.{n}") > c))

    cells = written(
        rows.select(F.struct(*[bin_of(n).alias(n) for n in names]).alias("bin"), "bad", "held")
        .groupBy("bin", "held")
        .agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
    )

    def within(c: Condition) -> Column:
        at = cuts[c.feature].index(c.threshold)
        return F.col(f"bin.{c.feature}") > at if c.above else F.col(f"bin.{c.feature}") <= at

    def counts(left: DataFrame) -> tuple[int, int]:
        got = left.agg(F.sum("bad"), F.sum("good")).first()
        return int(got[0] or 0), int(got[1] or 0)

    def best(left: DataFrame, bad_now: int, good_now: int) -> Condition | None:
        """The condition with the largest gain, from cumulative counts per statistic and bin."""
        per_bin = (
            left.select(
                F.inline(
                    F.array(
                        *[
                            F.struct(F.lit(n).alias("name"), F.col(f"bin.{n}").alias("at"))
                            for n in names
                        ]
                    )
                ),
                "bad",
                "good",
            )
            .groupBy("name", "at")
            .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        )
        seen: dict[str, dict[int, tuple[int, int]]] = {}
        for r in per_bin.collect():  # at most bins rows per statistic
            seen.setdefault(r["name"], {})[r["at"]] = (r["bad"], r["good"])
        before = log2(bad_now / (bad_now + good_now))
        found: tuple[float, Condition] | None = None
        for name in names:
            low_bad = low_good = 0
            for at, threshold in enumerate(cuts[name]):
                b, g = seen.get(name, {}).get(at, (0, 0))
                low_bad, low_good = low_bad + b, low_good + g
                for above in (False, True):
                    p = bad_now - low_bad if above else low_bad
                    n = good_now - low_good if above else low_good
                    if p < min_rows or p + n == bad_now + good_now:
                        continue
                    gain = p * (log2(p / (p + n)) - before)
                    if gain > 1e-9 and (found is None or gain > found[0]):
                        found = (gain, Condition(name, above, threshold))
        return found[1] if found else None

    rules: list[Rule] = []
    while len(rules) < max_rules:
        uncovered = cells
        for rule in rules:
            uncovered = uncovered.where(~_all(map(within, rule)))
        growing, conditions = uncovered.where("NOT held"), []
        bad_now, good_now = counts(growing)
        while bad_now >= min_rows and good_now and len(conditions) < max_conditions:
            chosen = best(growing, bad_now, good_now)
            if chosen is None:
                break
            conditions.append(chosen)
            growing = growing.where(within(chosen))
            bad_now, good_now = counts(growing)
        if not conditions:
            break
        # Prune: of the rule's beginnings, the one that does best on the rows held back.
        held = uncovered.where("held")
        tried = [tuple(conditions[:k]) for k in range(1, len(conditions) + 1)]
        sums = []
        for k, rule in enumerate(tried):
            inside = _all(map(within, rule))
            sums.append(F.sum(F.when(inside, F.col("bad"))).alias(f"bad{k}"))
            sums.append(F.sum(F.when(inside, F.col("good"))).alias(f"good{k}"))
        got = held.agg(*sums).first()

        def worth(k: int, got=got) -> tuple[float, int]:
            p, n = int(got[f"bad{k}"] or 0), int(got[f"good{k}"] or 0)
            return ((p - n) / (p + n) if p + n else -1.0, -k)

        k = max(range(len(tried)), key=worth)
        if worth(k)[0] < 2 * min_precision - 1:
            break
        rules.append(tried[k])
    return _centred(rows, rules)


def _centred(rows: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The same rules with each threshold in the middle between the values on either side of it."""
    every = [c for rule in rules for c in rule]
    if not every:
        return rules
    value = lambda c: F.col(f"features.{c.feature}")
    sides = []
    for k, c in enumerate(every):
        sides.append(F.max(F.when(value(c) <= c.threshold, value(c))).alias(f"low{k}"))
        sides.append(F.min(F.when(value(c) > c.threshold, value(c))).alias(f"high{k}"))
    got = rows.agg(*sides).first()
    moved = {}
    for k, c in enumerate(every):
        low, high = got[f"low{k}"], got[f"high{k}"]
        middle = c.threshold if low is None or high is None else (low + high) / 2
        moved[c] = Condition(c.feature, c.above, middle)
    return [tuple(moved[c] for c in rule) for rule in rules]


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        holds = _all(c.column() for c in rule)
        out = F.when(holds, F.lit(k)) if out is None else out.when(holds, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def base_failed() -> Column:
    """Too short, or more than half of the words in repeated windows."""
    words, repeated = F.col("stats.n_words"), F.col("stats.n_repeat_words")
    return (words < 50) | (100 * repeated > 50 * words)


def learned(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> list[Rule]:
    """Rules from rows with ``stats`` and from ``labels`` (doc_id, quality), bad where quality is 0.

    Rows repeated in ``labels`` count once, by their lowest quality; rows without an id or a quality
    are left out. Learning looks at the rows that pass the base test, the only ones left to it.
    """
    marks = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").alias("_id"))
        .agg((F.min("quality") == 0).alias("_bad"))
    )
    known = (
        measured.where(~base_failed())
        .select(F.col(id_col).alias("doc_id"), _features_struct())
        .join(marks, F.col("doc_id") == F.col("_id"))
    )
    return learn(known, F.col("_bad"))


def _features_struct() -> Column:
    return F.struct(*[c.alias(n) for n, c in features().items()]).alias("features")


def judged(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows with ``stats``, with ``base_failed``, ``rule`` (the first that holds, 0 if none) and
    ``kept`` added, in place of any columns of these names.

    Null text has no words and fails the base test. Null ids and repeated rows are judged like any
    other. Without rules, as when there are no labels or labels of one kind only, the base test
    decides alone. An empty table gives no rows.
    """
    failed, rule = base_failed(), verdict(rules)
    return measured.withColumns(
        {"base_failed": failed, "rule": rule, "kept": ~failed & (rule == 0)}
    )
