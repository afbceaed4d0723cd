"""Quality rules whose cutoffs are risk-controlled.

Base rules are fixed. The others are one ordered family for each stratum (language): each rule's ratio is measured in its own unit, a
document's score is the largest of them, and a cutoff rejects scores from it on. A cutoff is taken only where labelled documents of good quality
prove it safe: the exact (Clopper-Pearson) upper bound, at confidence 1 - DELTA / strata, of the share of good documents that it rejects must not exceed ALPHA.
Cutoffs are tested from the loosest to the strictest and testing stops at the first that fails (a fixed sequence), so a stratum spends its
share of DELTA once, however many cutoffs and rules there are; strata are corrected by Bonferroni. What is guaranteed: with probability 1 - DELTA over the labelled documents, no
stratum loses more than ALPHA of those good documents that pass the base rules, if labelled ones are drawn like the others. Equal texts count once, so copies prove nothing twice.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, carried, restored, stash

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT = 50
ALPHA = 0.03
DELTA = 0.05
#: Ratios that grow with junk, and their units.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", 0.25),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 1.0),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 1.0),
    "capitals": ("n_capitals / greatest(word_chars, 1)", 0.5),
}
#: A good document that goes outweighs so many junk ones, where several cutoffs are safe.
GOOD_WEIGHT = 10
#: Cutoffs k / GRID are tested.
GRID = 200
#: Strata beyond this many are joined and not broadcast.
MAX_BROADCAST_STRATA = 10_000

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long"


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more, first ones included."""
    grams = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(grams)) == len(grams):
        return 0
    often = {g for g, c in Counter(grams).items() if c > 1}
    total, end = 0, 0
    for i, g in enumerate(grams):
        if g in often:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def counts(text: str) -> tuple[int, ...]:
    """The columns of COUNTS for one whole text."""
    words = text.encode().split()
    chars = len(text) - sum(text.count(c) for c in SPACES)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    capitals = 0 if text.islower() else sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), dup, repeat_words(words), lines, capitals


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, stratum, key (a hash of the text), the counts, base_failed. Null text counts as empty; null language is a stratum of its own. Texts are read whole, however long."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("stratum"), text.alias("text"), F.xxhash64(text).alias("key"))

    def run(batches):
        names = [c.split()[0] for c in COUNTS.split(", ")]
        for b in batches:
            rows = [counts(t.as_py()) for t in b.column(2)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "stratum", "key", *names])

    out = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, stratum string, key long, {COUNTS}")
    return out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words"))


def accepted(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """The rows of ``df`` that the base rules and the cutoffs keep, all columns as they came, whatever their names.

    Each document is measured once, and what is measured is written with its row. Null texts count as empty and fail; null or repeated ids do no harm; rows that repeat stay or go
    together. Very long texts are read whole. An empty table gives an empty result.
    """
    rows = carried(df, text_col, lang_col).select(F.col("rest").alias("doc_id"), F.col("k0").alias("text"), F.col("k1").alias("lang"))
    rows = stash(measured(rows), "quality-rows")
    known = rows.withColumn("doc_id", F.col(f"doc_id.c{df.columns.index(id_col)}"))
    cuts = stash(cutoffs(known, labels, label_col=label_col).coalesce(1), "cutoffs")
    return restored(judged(rows, cuts).where("kept").withColumnRenamed("doc_id", "rest"), df)


def upper_bound(bad: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest p at which ``bad`` or fewer of ``n`` still has probability ``delta``."""
    if n <= 0 or bad >= n:
        return 1.0

    def tail(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(bad + 1)]
        top = max(logs)
        return math.exp(top) * math.fsum(math.exp(x - top) for x in logs)

    lo, hi = bad / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if mid <= 0 or (mid < 1 and tail(mid) > delta):
            lo = mid
        else:
            hi = mid
    return hi


def certified(good: list[int], junk: list[int], alpha: float, delta: float) -> float | None:
    """The cutoff of one stratum, or none. good[k], junk[k]: labelled documents whose score falls in step k of the grid.

    Of the certified cutoffs, the one that rejects most junk for the good it costs; the loosest of equals.
    """
    n, above_good, above_junk = sum(good), 0, 0
    best: tuple[int, int] | None = None
    for k in range(len(good) - 1, 0, -1):
        above_good, above_junk = above_good + good[k], above_junk + junk[k]
        if above_good > alpha * n or upper_bound(above_good, n, delta) > alpha:
            break
        gain = above_junk - GOOD_WEIGHT * above_good
        if gain > 0 and (best is None or gain > best[0]):
            best = (gain, k)
    return None if best is None else best[1] / GRID


#: A rule's ratio in steps of the grid.
STEPS = {n: f"least(cast(floor({e} / {unit} * {GRID}) as int), {GRID})" for n, (e, unit) in RULES.items()}


def cutoffs(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, cut (null where nothing is certified), n_good: the labelled good documents that it rests on.

    ``rows`` comes from ``measured``. Labels that are null or without a document do not count; of equal texts, and of documents labelled more than once, one counts in a stratum, and
    as good if any label says so. Base failures are rejected whatever the cutoffs, so they are left out.
    """
    step = F.expr("greatest(" + ", ".join(STEPS.values()) + ")")
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(f"`{id_col}`").alias("doc_id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("good"))
    marked = rows.where("not base_failed").select("doc_id", "stratum", "key", step.alias("step")).join(known, "doc_id").groupBy("stratum", "key").agg(F.max("good").alias("good"), F.max("step").alias("step"))
    hist = marked.groupBy("stratum", "step").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("junk"))
    n_tests = max(1, hist.select("stratum").distinct().count())

    def pick(pdf):
        import pandas as pd

        good, junk = [0] * (GRID + 1), [0] * (GRID + 1)
        for k, g, j in zip(pdf["step"], pdf["good"], pdf["junk"], strict=True):
            good[k], junk[k] = int(g), int(j)
        cut = certified(good, junk, alpha, delta / n_tests)
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "cut": [float("nan") if cut is None else cut], "n_good": [sum(good)]})

    found = hist.groupBy("stratum").applyInPandas(pick, "stratum string, cut double, n_good long")
    return found.select("stratum", F.nanvl("cut", F.lit(None).cast("double")).alias("cut"), "n_good")


def judged(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` with kept, and failed: the rules that rejected the document. A stratum without a cutoff keeps all but base failures."""
    small = cuts.count() <= MAX_BROADCAST_STRATA
    own = cuts.select("stratum", "cut")
    with_cuts = rows.join(F.broadcast(own) if small else own, "stratum", "left")
    failed = F.expr("filter(array(" + ", ".join(f"if({e} >= round(cut * {GRID}), '{n}', null)" for n, e in STEPS.items()) + "), x -> x is not null)")
    return with_cuts.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("cut", "key")
