"""Exact quantiles by distributed selection, without gathering a column in one task.

The built-in ``percentile`` keeps every distinct value of a group in one
buffer. Here a mergeable sketch first brackets each wanted order statistic.
While a bracket holds more than a fixed number of rows, its rows are counted by
slot, the slot with the wanted rank is sketched again and the bracket narrows.
Then one pass counts the values: those inside a bracket by value, those
between brackets as one number. What is ranked in one task is bounded by
``RANKED`` values a bracket, whatever the number of rows.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F, Window as W

ACCURACY = 100_000
#: The sketch errs by one part in ``accuracy`` of the ranks; four parts leave room for merging sketches.
MARGIN_PARTS = 4
#: From here on the margin spans two ranks at least; smaller groups are ranked as they are.
SKETCHED = 2 * ACCURACY // MARGIN_PARTS
#: Most rows of a bracket that are ranked, copies of a value aside.
RANKED = 50_000
#: A bracket that is sketched again is parted at so many places.
PROBES = 1_000


def exact_quantiles(df: DataFrame, value: str, qs: list[float], by: list[str] = (), accuracy: int = ACCURACY,
                    ranked: int = RANKED) -> DataFrame:
    """Linearly interpolated quantiles per group: columns ``by``, ``q`` and ``quantile``.

    Nulls are ignored. ``by`` names a bounded set of groups, such as
    parameters or neighbour ranks, since each group has brackets of its own.
    """
    counts = bracket_counts(df, value, qs, by, accuracy, ranked)
    group = W.partitionBy(*by)
    ranks = counts.select(
        *by, "_v", F.sum("_c").over(group).alias("_n"), "_c",
        F.sum("_c").over(group.orderBy("_slot", "_v").rowsBetween(W.unboundedPreceding, 0)).alias("_end"))
    return ranks.groupBy(*by).agg(F.array(*[_interpolated(q) for q in sorted({float(q) for q in qs})]).alias("_q")).select(
        *by, F.inline("_q"))


def bracket_counts(df: DataFrame, value: str, qs: list[float], by: list[str] = (), accuracy: int = ACCURACY,
                   ranked: int = RANKED) -> DataFrame:
    """Rows (by, _slot, _v, _c): values inside the final brackets with their counts, and one null value for all those between two brackets."""
    by, qs, margin = list(by), sorted({float(q) for q in qs}), MARGIN_PARTS / accuracy
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    probes = [p for q in qs for p in (max(q - margin, 0.0), min(q + margin, 1.0))]
    sketch = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.array(F.min("_v"), F.max("_v")).alias("ends"),
        F.percentile_approx("_v", probes, accuracy).alias("p")).collect()
    brackets = [(*[r[c] for c in by], *_merged(r["p"] if r["n"] >= 2 / margin else r["ends"])) for r in sketch if r["n"]]
    # a bracket spans twice the margin and what the sketch errs at its ends
    if max((r["n"] for r in sketch), default=0) * (2 * margin + 2 / accuracy) > ranked:
        brackets = _narrowed(rows, brackets, qs, by, accuracy, ranked)

    keyed, width = _with_brackets(rows, brackets, by)
    lo, hi, v = F.col("_lo"), F.col("_hi"), F.col("_v")
    passed, inside = F.lit(0), F.lit(False)
    for i in range(width):
        passed = passed + (hi[i] < v).cast("int")
        inside = inside | ((lo[i] <= v) & (v <= hi[i]))
    slots = keyed.select(*by, (passed * 2 + inside.cast("int")).alias("_slot"), F.when(inside, v).alias("_v"))
    return slots.groupBy(*by, "_slot", "_v").agg(F.count("*").alias("_c"))


def _narrowed(rows: DataFrame, brackets: list[tuple], qs: list[float], by: list[str], accuracy: int, ranked: int) -> list[tuple]:
    """Brackets around the wanted ranks that hold one value or at most ``ranked`` rows each.

    A round counts the rows at both ends of every bracket, inside and between
    brackets. The slots that hold a wanted rank are the new brackets, so a
    bracket that missed its rank costs a round and no more. Slots that are still too large
    are sketched and parted around the rank. A slot leaves the ends of its
    bracket out, so every round narrows, however often a value is repeated.
    """
    while True:
        keyed, width = _with_brackets(rows, brackets, by)
        slot, v = F.lit(0), F.col("_v")
        for i in range(width):
            lo, hi = F.col("_lo")[i], F.col("_hi")[i]
            slot = slot + (v >= lo).cast("int") + (v > lo).cast("int") + (v >= hi).cast("int") + (v > hi).cast("int")
        counted = keyed.select(*by, slot.alias("_slot"), "_v").groupBy(*by, "_slot").agg(
            F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()  # four slots a bracket
        groups: dict[tuple, list] = {}
        for r in sorted(counted, key=lambda r: r["_slot"]):
            groups.setdefault(tuple(r[c] for c in by), []).append((r["c"], r["lo"], r["hi"]))
        held, large = {}, False
        for key, slots in groups.items():
            n, start, held[key] = sum(c for c, *_ in slots), 0, []
            wanted = sorted({k for q in qs for k in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))})
            for c, lo, hi in slots:
                if own := [k - start for k in wanted if start <= k < start + c]:
                    held[key].append((lo, hi, c, own))
                    large |= c > ranked and lo < hi
                start += c
        brackets = [(*key, [lo for lo, *_ in found], [hi for _, hi, *_ in found]) for key, found in held.items()]
        if not large:
            return brackets
        keyed, width = _with_brackets(rows, brackets, by)
        which = F.lit(None).cast("int")
        for i in range(width):
            which = F.when((F.col("_lo")[i] <= v) & (v <= F.col("_hi")[i]), F.lit(i)).otherwise(which)
        steps = [i / PROBES for i in range(PROBES + 1)]
        sketch = keyed.select(*by, which.alias("_at"), "_v").filter(F.col("_at").isNotNull()).groupBy(*by, "_at").agg(
            F.percentile_approx("_v", steps, accuracy).alias("p"))
        parted = {(tuple(r[c] for c in by), r["_at"]): r["p"] for r in sketch.collect()}
        brackets = []
        for key, found in held.items():
            bounds = []
            for i, (lo, hi, c, own) in enumerate(found):
                if c <= ranked or lo == hi:
                    bounds += [lo, hi]
                    continue
                for k in own:
                    at = k / max(c - 1, 1) * PROBES
                    first = math.floor(at - MARGIN_PARTS * PROBES / accuracy)
                    last = math.ceil(at + MARGIN_PARTS * PROBES / accuracy)
                    bounds += [parted[key, i][max(first, 0)], parted[key, i][min(last, PROBES)]]
            brackets.append((*key, *_merged(bounds)))


def _merged(bounds: list[float]) -> tuple[list[float], list[float]]:
    """Brackets of one group as disjoint intervals in ascending order."""
    pairs = sorted(zip(bounds[::2], bounds[1::2]))
    lows, highs = [pairs[0][0]], [pairs[0][1]]
    for lo, hi in pairs[1:]:
        if lo <= highs[-1]:
            highs[-1] = max(highs[-1], hi)
        else:
            lows.append(lo)
            highs.append(hi)
    return lows, highs


def _with_brackets(rows: DataFrame, brackets: list[tuple], by: list[str]) -> tuple[DataFrame, int]:
    """Rows with the bracket arrays of their group, padded to one length."""
    width = max((len(b[-1]) for b in brackets), default=0)
    pad = lambda xs: list(xs) + [math.inf] * (width - len(xs))
    table = [(*b[:-2], pad(b[-2]), pad(b[-1])) for b in brackets]
    if not by:
        lo, hi = table[0] if table else ([], [])
        literal = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
        return rows.withColumns({"_lo": literal(lo), "_hi": literal(hi)}), width
    names = [f"_k{i}" for i in range(len(by))]
    fields = [f"{n} {rows.schema[c].dataType.simpleString()}" for n, c in zip(names, by)]
    right = rows.sparkSession.createDataFrame(table, ", ".join([*fields, "_lo array<double>", "_hi array<double>"]))
    match = [F.col(c).eqNullSafe(F.col(n)) for n, c in zip(names, by)]
    # One row per group, collected above, so its size is known to be small.
    return rows.join(F.broadcast(right), match).drop(*names), width


def _interpolated(q: float) -> Column:
    """Value at fraction ``q`` of the ranks, between the two order statistics around it."""
    rank = F.lit(q) * (F.col("_n") - 1)
    start, end = F.col("_end") - F.col("_c"), F.col("_end")

    def at(k: Column) -> Column:
        return F.max(F.when((start <= k) & (k < end), F.col("_v")))

    below, above = at(F.floor(rank)), at(F.ceil(rank))
    part = F.max(rank - F.floor(rank))
    found = F.when(below.isNull() | above.isNull(), F.raise_error(F.lit("quantile outside its bracket")))
    return F.struct(F.lit(q).alias("q"), found.otherwise(below + (above - below) * part).alias("quantile"))


def quantiles_exact(df: DataFrame, cols: list[str], qs: list[float]) -> DataFrame:
    """Quantiles of several columns: one row per column and fraction."""
    long = df.select(*[F.col(c).cast("double") for c in cols]).unpivot([], list(cols), "column", "_value")
    return exact_quantiles(long, "_value", qs, ["column"])

