"""Mixing documents to target weights of domains that each belongs to in part.

A classifier fitted on the labelled table predicts how probable each domain is
for a text. A document's rate says how often it is used. Rates are fitted by
projected-gradient least squares, so that the expected tokens of every domain,
the sum of rate times tokens times probability, match their targets while no
rate is negative.
"""

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage_table

#: Bounds of the labelled rows that the classifier is fitted on, and of the words it looks for.
SAMPLE_ROWS = 4_000
SAMPLE_WORDS = 3_000
#: Words of fewer sample texts say nothing about a domain.
LEAST_TEXTS = 4
WORD = re.compile(r"\w+")
DOMAINS = ("high", "low", "toxic")
#: Shares of the mixture's tokens.
TARGETS = {"high": 0.92, "low": 0.07, "toxic": 0.01}


def domain_of(quality: Column, toxic: Column) -> Column:
    """Domain of a row of the labelled table; null where a label is missing."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "high").when(quality == 0, "low")


@dataclass
class DomainModel:
    domains: tuple[str, ...]
    words: dict[str, int]
    weights: np.ndarray  # (words + cues + 1) x domains
    mean: np.ndarray
    scale: np.ndarray

    def probabilities(self, text: str) -> np.ndarray:
        """By words present and cues of style; a text without words has the probabilities of the constants."""
        at = [self.words[w] for w in set(WORD.findall(text.lower())) if w in self.words]
        n = len(self.words)
        z = self.weights[at].sum(axis=0) + ((cues(text) - self.mean) / self.scale) @ self.weights[n:-1] + self.weights[-1]
        e = np.exp(z - z.max())
        return e / e.sum()


def cues(text: str) -> np.ndarray:
    """Length, and shares of capitals, digits, white space and other signs."""
    n = max(1, len(text))
    raw = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=5)
    return np.array([np.log1p(len(text)), *(kinds[1:] / n)])


_KIND = np.array([1 if chr(b).isupper() else 2 if chr(b).isdigit() else 3 if chr(b).isspace() else 0 if chr(b).isalpha() else 4
                  for b in range(256)], np.uint8)


def telling_words(texts: list[set[str]], y: np.ndarray, n: int) -> dict[str, int]:
    """Up to ``SAMPLE_WORDS`` words whose presence tells most about the domain, by chi-square."""
    count: dict[str, np.ndarray] = {}
    for words, d in zip(texts, y, strict=True):
        for w in words:
            count.setdefault(w, np.zeros(n, np.int32))[d] += 1
    names = sorted(w for w, c in count.items() if c.sum() >= LEAST_TEXTS)
    if not names:
        return {}
    c = np.stack([count[w] for w in names]).astype(float)
    total = np.bincount(y, minlength=n).astype(float)
    present, expected = c.sum(axis=1, keepdims=True), c.sum(axis=1, keepdims=True) * total / total.sum()
    absent = total.sum() - present
    chi = ((c - expected) ** 2 / np.maximum(expected, 1e-9)).sum(axis=1) * (1 + present[:, 0] / np.maximum(absent[:, 0], 1))
    best = np.argsort(-chi, kind="stable")[:SAMPLE_WORDS]
    return {names[i]: k for k, i in enumerate(sorted(best))}


def softmax_regression(x: np.ndarray, y: np.ndarray, n: int, penalty: float = 1e-4, rounds: int = 400) -> np.ndarray:
    """Weights (last row: constants) by accelerated gradient descent on the mean log loss."""
    x = np.c_[x, np.ones(len(x), np.float32)]
    target = np.eye(n, dtype=np.float32)[y]
    probe = np.ones(x.shape[1], np.float32)
    for _ in range(15):
        probe = x.T @ (x @ probe)
        probe /= np.sqrt((probe * probe).sum())
    step = 1 / (0.5 * float(((x @ probe) ** 2).sum()) / len(x) + penalty)
    w = v = np.zeros((x.shape[1], n), np.float32)
    for k in range(rounds):
        z = x @ v
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = v - step * (x.T @ (p - target) / len(x) + penalty * v)
        v, w = new + k / (k + 3) * (new - w), new
    return w


def fit_domains(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", domain: str = "domain",
                sample: int = SAMPLE_ROWS) -> DomainModel | None:
    """Fit on at most ``sample`` labelled texts, drawn by the hash of the key; ``labelled`` has ``key`` and ``domain``.

    Null keys, texts and domains are left out; of a key's several labels the
    smallest counts, of its several texts the one with the smallest hash, so a
    key that many rows share adds one text. None without labelled texts.
    """
    labels = labelled.select(F.col(key).alias("key"), F.col(domain).alias("domain")).where("key IS NOT NULL AND domain IS NOT NULL")
    labels = labels.groupBy("key").agg(F.min("domain").alias("domain"))
    chosen = labels.orderBy(F.xxhash64(F.col("key").cast("string"), F.lit(11)), "key").limit(sample)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    rows = F.broadcast(chosen)  # at most `sample` keys and names
    joined = texts.join(rows, "key").groupBy(F.col("key").cast("string").alias("key"), "domain").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"))

    def described(batches):
        for batch in batches:
            yield pd.DataFrame({"one": 1, "key": batch["key"], "domain": batch["domain"],
                                "words": [sorted(set(WORD.findall(t.lower()))) for t in batch["text"]],
                                "style": [cues(t).tolist() for t in batch["text"]]})

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.iloc[sorted(range(len(part)), key=lambda i: (part["key"].iat[i], part["domain"].iat[i], list(part["words"].iat[i])))]
        names = sorted(part["domain"].unique())
        y = part["domain"].map({d: i for i, d in enumerate(names)}).to_numpy()
        texts = [set(w) for w in part["words"]]
        words = telling_words(texts, y, len(names))
        style = np.stack(part["style"].to_numpy())
        mean, scale = style.mean(axis=0), np.maximum(style.std(axis=0), 1e-6)
        x = np.zeros((len(y), len(words) + style.shape[1]), np.float32)
        for i, present in enumerate(texts):
            x[i, [words[w] for w in present if w in words]] = 1
        x[:, len(words):] = (style - mean) / scale
        w = softmax_regression(x, y, len(names))
        return pd.DataFrame({"names": [names], "words": [list(words)], "weights": [w.astype("<f4").tobytes()],
                             "mean": [mean.tolist()], "scale": [scale.tolist()]})

    # one bounded group: the distinct words of the sample's texts
    rows = joined.mapInPandas(described, "one int, key string, domain string, words array<string>, style array<double>")
    fitted = rows.groupBy("one").applyInPandas(
        fit, "names array<string>, words array<string>, weights binary, mean array<double>, scale array<double>").collect()
    if not fitted:
        return None
    r = fitted[0]
    return DomainModel(tuple(r.names), {w: i for i, w in enumerate(r.words)}, np.frombuffer(r.weights, "<f4").reshape(-1, len(r.names)),
                       np.array(r["mean"]), np.array(r["scale"]))


def domain_posteriors(docs: DataFrame, model: DomainModel | None, domains: tuple[str, ...], text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` (words between white space) and ``posterior``, one probability per domain.

    Without a model all domains are equally probable. Columns with these names are replaced.
    """
    @F.pandas_udf("n_tokens long, posterior array<double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            if model is None:
                p = np.full(len(domains), 1 / len(domains))
            else:
                own = dict(zip(model.domains, model.probabilities(t), strict=True))
                p = np.array([float(own.get(d, 0.0)) for d in domains])
            out.append((len(t.encode().split()), p.tolist()))
        return pd.DataFrame(out, columns=["n_tokens", "posterior"])

    kept = [c for c in docs.columns if c not in ("n_tokens", "posterior")]
    return docs.select(*kept, predict(F.coalesce(F.col(text), F.lit(""))).alias("__p")).select(*kept, "__p.n_tokens", "__p.posterior")


def rate_column(steps: list[tuple[np.ndarray, float]], posterior: str = "posterior") -> Column:
    """Rate after the given steps (weights, momentum): from 1, each adds its weighted posterior and is cut off at 0."""
    if not steps:
        return F.lit(1.0)
    lists = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in s]).alias("w"), F.lit(float(b)).alias("b")) for s, b in steps])

    def step(acc: Column, one: Column) -> Column:
        ahead = acc["r"] + one["b"] * (acc["r"] - acc["before"])
        gain = F.aggregate(F.zip_with(F.col(posterior), one["w"], lambda p, w: p * w), F.lit(0.0), lambda x, y: x + y)
        return F.struct(F.greatest(F.lit(0.0), ahead + gain).alias("r"), acc["r"].alias("before"))

    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("before"))
    return F.aggregate(lists, start, step, lambda acc: acc["r"])


def fit_rates(table: DataFrame, targets: dict[str, float], domains: tuple[str, ...], anchor: str, tolerance: float = 1e-6,
              max_steps: int = 60) -> tuple[list[tuple[np.ndarray, float]], np.ndarray]:
    """Steps of the projected gradient, and the target totals. ``table`` has n_tokens and posterior.

    Minimised is the squared distance of the expected totals to the targets,
    measured by the inverse of G = sum of tokens p p', which makes 1 the right
    step size; deviations of rates count by tokens. The gradient at a document
    is a weighting of its posteriors, so few numbers per step describe all
    rates, and every step, with momentum until that overshoots, is one
    distributed sum. The total of ``anchor`` sets the size of the mixture: its
    target is what the corpus has. Where no rates reach the targets, the
    steps end close to the nearest totals.
    """
    d = len(domains)
    share = np.array([max(0.0, targets.get(k, 0.0)) for k in domains])
    p = [F.element_at("posterior", i + 1) for i in range(d)]

    def totals(steps) -> np.ndarray:
        used = F.col("__rate") * F.col("n_tokens")
        row = table.withColumn("__rate", rate_column(steps)).agg(*[F.sum(used * c) for c in p]).first()
        return np.array([v or 0.0 for v in row])

    got = totals([])
    if share.sum() == 0 or got.sum() == 0:
        return [], got
    gram = table.agg(*[F.sum(F.col("n_tokens") * p[i] * p[j]) for i in range(d) for j in range(d)]).first()
    inverse = np.linalg.pinv(np.array(gram, float).reshape(d, d), rcond=1e-9)
    at = domains.index(anchor)
    size = got[at] / share[at] if share[at] > 0 and got[at] > 0 else got.sum() / share.sum()
    target = np.where(got > 0, share * size, 0.0)  # a domain of which there is nothing can have no tokens
    distance = lambda t: float((target - t) @ inverse @ (target - t))
    steps: list[tuple[np.ndarray, float]] = []
    before, momentum, errors = got, 1.0, [distance(got)]
    while errors[-1] > tolerance ** 2 * float(target @ inverse @ target) and len(steps) < max_steps:
        after = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        b = (momentum - 1) / after
        trial = [*steps, (inverse @ (target - got - b * (got - before)), b)]
        new = totals(trial)
        if distance(new) > errors[-1] and b > 0:
            after, trial = 1.0, [*steps, (inverse @ (target - got), 0.0)]
            new = totals(trial)
        if distance(new) >= errors[-1]:
            break
        steps, before, got, momentum = trial, got, new, after
        errors.append(distance(new))
        if len(errors) > 8 and errors[-1] > 0.98 * errors[-8]:
            break
    return steps, target


def mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, domains: tuple[str, ...] = DOMAINS,
            anchor: str = "high", key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_tokens, posterior (by ``domains``), rate and copies; input columns with these names are replaced.

    ``copies`` is the rate rounded up or down by the hash of key and text, so
    that it is right on average and the same in every run. Null and empty
    texts have no tokens and stay at a rate that moves no total. Repeated rows count each.
    """
    targets = TARGETS if targets is None else targets
    model = fit_domains(docs, labelled, key, text)
    kept = [c for c in keep or docs.columns if c not in ("n_tokens", "posterior", "rate", "copies")]
    chance = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    marked = docs.select(*kept, *[c for c in {text} - {*kept}], chance.alias("__chance"))
    table = stage_table(domain_posteriors(marked, model, domains, text).select(*kept, "__chance", "n_tokens", "posterior"), "posteriors")
    steps, _ = fit_rates(table.select("n_tokens", "posterior"), targets, domains, anchor)
    rated = table.withColumn("rate", rate_column(steps))
    return rated.withColumn("copies", F.floor(F.col("rate") + F.col("__chance")).cast("long")).drop("__chance")


def sampled(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as often as its ``copies`` say, with the same columns whatever their names."""
    rows = docs.select(F.struct("*").alias("__row"), F.col(key).alias("__key"), F.col(text).alias("__text"))
    labelled = labelled.withColumnRenamed(key, "__key")
    mixed = mixture(rows, labelled, key="__key", text="__text", keep=["__row"], **options).where("copies > 0")
    return mixed.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
