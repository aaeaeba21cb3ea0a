"""Phrases whose words occur together more often than their parts suggest, per group of texts.

Each task reads its texts into weighted acyclic automata (``count_automata``)
and cuts them at shared cut points into ranges of paths. Per range the automata
of all tasks are united and their weights summed; what leaves a range are the
phrases that are frequent and the few at its two ends, whose weights other
ranges complete. Candidates then look up the weights of their parts.
"""

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import stage_table
from .count_automata import CountAutomaton, PathReader, sampled_paths, union

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2_000
#: Bytes that end a piece: . , ; : ! ? and line breaks.
SPLIT = b".,;:!?\n\x0b\x0c\r"
#: Words of one automaton of a task.
SHARD_WORDS = 1_000_000
#: Text per range; cut points are read from a bounded sample, which decides on balance and not on results.
RANGE_BYTES = 8 << 20
MAX_RANGES = 1 << 20
SAMPLE_DOCS = 4_000
PATHS_PER_RANGE = 50
CUT_LETTERS = 32
#: Copies of a part's weight; the candidates that ask for it are dealt over them.
SALTS = 16


def _cuts(texts: DataFrame, max_words: int, range_bytes: int) -> list[tuple]:
    """Cut points (group, word, ...) in ascending order that part the paths of a sample evenly."""
    total, n = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    ranges = min(MAX_RANGES, -(-(total or 0) // range_bytes))
    if ranges < 2:
        return []
    share = min(1.0, max(SAMPLE_DOCS, ranges) / n)
    wanted = ranges * PATHS_PER_RANGE
    every = max(1, int(total * share / 6 / wanted))

    def paths(batches):
        reader = PathReader(max_words, SPLIT)
        for batch in batches:
            rows = [(g, *p) for g, t in zip(batch["lang"], batch["text"]) for p in sampled_paths(t, reader, every)]
            yield pd.DataFrame({"path": [[g.encode(), *(w[:CUT_LETTERS] for w in p)] for g, *p in rows]})

    sample = texts.where(F.rand(7) < share).mapInPandas(paths, "path array<binary>").limit(4 * wanted)
    found = sorted(tuple(map(bytes, r.path)) for r in sample.collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)} if found else ())


def _range_parts(texts: DataFrame, cuts: list[tuple], max_words: int, shard_words: int) -> DataFrame:
    """Rows (range, lang, automaton) of every task's automata, cut at ``cuts``."""
    sent = texts.sparkSession.sparkContext.broadcast(cuts)  # at most MAX_RANGES short paths

    def parts(reader: PathReader, cuts: list[tuple]):
        rows = []
        for group, automaton in reader.automata():
            key = (group.encode(),)
            below = bisect_left(cuts, key)
            own = cuts[below:bisect_left(cuts, (key[0] + b"\0",))]
            at = [0, *(automaton.before(c[1:]) for c in own), len(automaton)]
            for i, (low, high) in enumerate(zip(at, at[1:])):
                if low < high:
                    rows.append((below + i, group, automaton.part(low, high).to_bytes()))
                if len(rows) >= 1_000:
                    yield pd.DataFrame(rows, columns=["range", "lang", "automaton"])
                    rows = []
        yield pd.DataFrame(rows, columns=["range", "lang", "automaton"])

    def read(batches):
        reader, points = PathReader(max_words, SPLIT), sent.value
        for batch in batches:
            for group, text in zip(batch["lang"], batch["text"]):
                for _ in reader.add(group, text, shard_words):
                    yield from parts(reader, points)
                    reader.clear()
        yield from parts(reader, points)

    return texts.mapInPandas(read, "range int, lang string, automaton binary")


def phrase_weights(texts: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, range_bytes: int = RANGE_BYTES,
                   shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, size, phrase, f) of all phrases of up to ``max_words`` words with ``f >= min_count``, and size 0 for all words of a group.

    ``texts`` has the columns lang and text without nulls.
    """
    cuts = _cuts(texts, max_words, range_bytes)

    def unite(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for lang, own in group.groupby("lang", sort=False):
            whole = union(CountAutomaton.from_bytes(b) for b in own["automaton"])
            rows.append((lang, 0, "", int(whole.counts.sum())))
            for size in range(1, max_words + 1):
                first, weight = whole.phrases(size)
                stays = weight >= min_count
                if size < max_words:
                    stays[:1] = stays[-1:] = True  # prefixes that ranges beside this one may share
                rows += [(lang, size, whole.text(p, size), w) for p, w in zip(first[stays].tolist(), weight[stays].tolist())]
        return pd.DataFrame(rows, columns=["lang", "size", "phrase", "f"])

    united = _range_parts(texts, cuts, max_words, shard_words).groupBy("range").applyInPandas(
        unite, "lang string, size int, phrase string, f long")
    total = united.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return total.where((F.col("f") >= min_count) | (F.col("size") == 0))


def _joined(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def score(a: str, left: str, right: str) -> Column:
    """floor(1,000,000 a a / (left right)) in whole numbers of up to 38 digits (``a`` below 10^15)."""
    return F.expr(f"(cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)))"
                  f" div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
                 top: int = TOP, **options) -> DataFrame:
    """The ``top`` phrases of each group: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split at ``. , ; : ! ?`` and line breaks into
    pieces, these at spaces and tabs into words. ``a`` counts a phrase of 2 to
    ``max_words`` words, overlaps included, ``n`` all words of the group. Each
    cut of a phrase in two has the counts ``l`` and ``r`` of its parts and the
    score floor(1,000,000 a a / (l r)); the lowest counts, of equal ones the
    earliest cut. Phrases with ``a < min_count`` are no candidates, and those
    within a longer candidate of at least half their count are dropped. Order:
    score, a (both descending), phrase (bytes ascending).

    Null texts are empty, a null group is ``und``. Groups without candidates
    have no rows, nor has an empty table. Repeated rows count as often as they
    occur; other columns are ignored.
    """
    texts = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    weights = stage_table(phrase_weights(texts, max_words, min_count, **options), "phrase-weights")
    return best_phrases(weights, max_words, min_count, top)


def best_phrases(weights: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """Scores, drops and ranks the phrases of a table of weights (``phrase_weights``); see ``collocations``."""
    words = F.split("phrase", " ")
    candidates = weights.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))

    # composition with the weights: every candidate asks for both parts of each of its cuts
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt")
    asked = candidates.select("lang", "phrase", "size", "a", k, salt).select(
        "lang", "phrase", "a", "k", "salt", _joined(words, 1, F.col("k")).alias("left"),
        _joined(words, F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    parts = weights.where(F.col("size").between(1, max_words - 1)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    given = lambda side, name: parts.select("lang", "salt", F.col("phrase").alias(side), F.col("f").alias(name))
    met = asked.join(given("left", "l"), ["lang", "salt", "left"]).join(given("right", "r"), ["lang", "salt", "right"])
    scored = met.groupBy("lang", "phrase", "a").agg(F.min(F.struct(
        score("a", "l", "r").alias("score"), "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")

    if max_words > 2:
        size = F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m")
        inner = candidates.where("size > 2").select("lang", "phrase", "size", "a", size).select(
            "lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1), lambda i: _joined(words, i, F.col("m")))).alias("phrase"))
        around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        scored = scored.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a"))).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each of SALTS shares of a group hold the best of the group, so no task ranks more than SALTS * top rows of it
    shares = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    heads = scored.withColumn("rank", F.row_number().over(shares)).where(F.col("rank") <= top)
    ranked = heads.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = weights.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
