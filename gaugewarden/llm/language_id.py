"""Language identification by nearest centroid.

Texts are TF-IDF vectors of hashed byte trigrams of their letters. Each
language has several centroids, found by spherical k-means in a bounded sample;
document frequencies come from all training rows. A text gets the language of
the centroid with the largest cosine. It is rejected if it lies farther from
every language than all but a stated share of random cuts, as long as the text,
of that language's own sample texts do.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .ngrams import trigram_counts, trigrams

DIMS = 1 << 14
#: Bound of the rows per language that centroids and rejection distances are fitted on.
SAMPLE_PER_LANGUAGE = 600
#: Languages learned at most; each takes a few centroids in every task.
MOST_LANGUAGES = 1_000
#: Stated rate of false rejections: the share of cuts of a language's sample texts that its bound leaves out.
FALSE_REJECTIONS = 1 / 2000
#: Cuts per language and size that each bound is read from.
CUTS = 8_000
#: Trigrams of a cut. Between two sizes the bound is interpolated. A longer text is judged as one of the largest size: cuts of
#: one text differ as much as texts only while they are short, and a few hundred texts do not show a rate of whole ones.
CUT_SIZES = tuple(1 << i for i in range(7))


@dataclass
class LanguageModel:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    bounds: np.ndarray  # least cosine of each centroid's language, by CUT_SIZES

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        norm = np.sqrt((v * v).sum())
        return v / norm if norm > 0 else v

    def recognises(self, cosines: np.ndarray, trigrams: float) -> bool:
        """Whether a text with so many trigrams is near enough to a language; one without a known trigram never is."""
        least = [np.interp(np.log2(max(trigrams, 1)), np.log2(CUT_SIZES), b) for b in self.bounds]
        return bool(((cosines > 0) & (cosines >= least)).any())

    def cut_bounds(self, texts: list[str], lang: str) -> np.ndarray:
        """Cosine to ``lang`` that all but FALSE_REJECTIONS of random cuts of the texts reach, by CUT_SIZES.

        Texts nearer to another language count as mislabelled and are left out, unless all are.
        A size no text has gets the bound of the size before.
        """
        own = np.array([x == lang for x in self.languages])
        known = [h for h in (np.concatenate([*trigrams(t, DIMS, True)]) for t in texts) if len(h)]
        right = [h for h in known if own[np.argmax(self.centroids @ self.vector(np.bincount(h, minlength=DIMS)))]]
        rng, near, bounds = np.random.default_rng(7), self.centroids[own], [0.0]
        for size in CUT_SIZES:
            long = [h for h in right or known if len(h) >= size]
            if long:  # every text gives as many cuts
                cuts = np.sort([h[at:at + size] for i in range(CUTS) for h in [long[i % len(long)]]
                                for at in [rng.integers(len(h) - size + 1)]], axis=1)
                first = np.flatnonzero(np.diff(cuts.astype(np.int64), axis=1, prepend=-1) != 0)
                some = cuts.ravel()[first]
                v = np.log1p(np.diff(first, append=cuts.size)) * self.idf[some]
                starts = np.searchsorted(first, np.arange(CUTS) * size)
                norms = np.sqrt(np.add.reduceat(v * v, starts))
                cosines = np.max([np.add.reduceat(c[some] * v, starts) for c in near], axis=0) / norms
            bounds.append(float(np.quantile(cosines, FALSE_REJECTIONS, method="lower")) if long else bounds[-1])
        return np.array(bounds[1:])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Unit centroids; the first is nearest to the mean, each next one farthest from those before it."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    c = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.sqrt((new * new).sum(axis=1, keepdims=True)), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def fit_languages(train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", centroids: int = 4,
                  sample: int = SAMPLE_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> LanguageModel:
    """Learn from the rows of ``train`` with text and language.

    Document frequencies count every row. The sample of a language is drawn by
    the hash of the key: about ``sample`` rows, all rows if there are fewer, and
    one text of rows that share a key (or have none). Of more than ``most_languages`` values the most
    frequent are learned. Rejection bounds come from a second sample, drawn by another hash.
    The driver gets one row per language and trigram bucket, never texts.
    """
    rows = train.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    sizes = {r.lang: r.n for r in counts.collect()}
    if not sizes:
        return LanguageModel(np.ones(DIMS, np.float32), [], np.zeros((0, DIMS), np.float32), np.zeros((0, len(CUT_SIZES))))

    def frequencies(batches):
        df = np.zeros(DIMS, np.int64)
        for batch in batches:
            for t in batch["text"]:
                df += trigram_counts(t, DIMS, True) > 0
        some = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": some.astype(np.int32), "n": df[some]})

    df = np.zeros(DIMS, np.int64)
    for r in rows.select("text").mapInPandas(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r.bucket] = r.n
    idf = (np.log((1 + sum(sizes.values())) / (1 + df)) + 1).astype(np.float32)
    model = LanguageModel(idf, [], np.zeros((0, DIMS), np.float32), np.zeros((0, len(CUT_SIZES))))

    share = F.create_map(*[F.lit(v) for name, n in sizes.items() for v in (name, min(1.0, sample / n))])

    def drawn(seed: int) -> DataFrame:
        place = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(seed)), F.lit(1 << 30))
        texts = rows.where(place < share[F.col("lang")] * (1 << 30)).groupBy("lang", "key").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        return texts.groupBy("lang")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        counts = [trigram_counts(t, DIMS, True) for t in part.sort_values(["key", "text"])["text"]]
        x = np.stack([model.vector(c) for c in counts if c.any()] or [np.zeros(DIMS)])
        if not x.any():
            return pd.DataFrame({"lang": [], "centroid": []})
        c = spherical_kmeans(x, centroids)
        return pd.DataFrame({"lang": part["lang"].iloc[0], "centroid": [v.astype("<f4").tobytes() for v in c]})

    found = sorted(drawn(7).applyInPandas(fit, "lang string, centroid binary").collect(), key=lambda r: (r.lang, bytes(r.centroid)))
    if not found:
        return model
    model.languages = [r.lang for r in found]
    model.centroids = np.stack([np.frombuffer(r.centroid, "<f4") for r in found])

    def bound(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["key", "text"])
        return pd.DataFrame({"lang": part["lang"].iloc[:1], "bounds": [model.cut_bounds(part["text"].tolist(), part["lang"].iloc[0]).tolist()]})

    known = drawn(8).applyInPandas(bound, "lang string, bounds array<double>").collect()
    bounds = {r.lang: r.bounds for r in known}
    # a language of which the second sample has no row recognises no text by itself
    model.bounds = np.array([bounds.get(x, [np.inf] * len(CUT_SIZES)) for x in model.languages])
    return model


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (the cosine, 0 to 1) and rejected; columns with these names are replaced.

    ``und``, score 0 and rejected: a null text, one without a letter, or any text if nothing was learned.
    A text with letters keeps the nearest language as its prediction even where it is rejected.
    """
    names = ["lang_pred", "score", "rejected"]

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            if t is None or not model.languages:
                out.append(("und", 0.0, True))
                continue
            counts = trigram_counts(t, DIMS, True)
            cosine = model.centroids @ model.vector(counts)
            best = int(np.argmax(cosine))
            score = float(min(1.0, max(0.0, cosine[best])))
            out.append((model.languages[best], score, not model.recognises(cosine, counts.sum())))
        return pd.DataFrame(out, columns=names)

    lettered = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))
    kept = [c for c in docs.columns if c not in names]
    return docs.select(*kept, predict(lettered).alias("__lang")).select(*kept, *(F.col("__lang")[c].alias(c) for c in names))


def recognised(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is recognised, unchanged; learned from the rows that name one."""
    rows = docs.select(F.struct("*").alias("__row"), F.col(text).alias("__text"))
    found = identify_languages(rows, fit_languages(docs, key, text, lang), "__text")
    return found.where("NOT rejected").select("__row.*")
