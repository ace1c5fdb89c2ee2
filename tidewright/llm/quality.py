"""Quality classifier: document evidence, host and path posteriors, hierarchical empirical Bayes.

Evidence. Two logistic models (good quality, toxicity) over shape features of the text and the
logarithms of the counts of the words and word beginnings that best separate the labelled classes, at most WORDS of
either kind for each class, and no more than one for three labelled rows. They are fitted on at most SAMPLE
labelled rows, chosen by a hash of the id; everything else covers all documents.

Site posteriors. Every document is scored; grouped sums per host and per (host, path) give each site
its mean evidence. A host's mean is shrunk toward the global mean and a path's toward its host's, by
prior strengths estimated from the spread of hosts around the global mean and of paths around their host's
(method of moments of the nested grouping), so sparse sites stay near their priors. A document's final log-odds are
its own evidence plus how far its site, without this document, stands from the global mean. Only sums per site move; a host with a third of all rows is summed where it lies.

Defined cases: null text is empty text; null hosts and paths are sites of their own; null ids are
scored, and cannot be trained on; repeated rows count as often as they occur; with no labels, or one
class only, the evidence is the class share (one half without labels); empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidewright.llm.common import arrow_rows, map_rows, materialize, ship, text_rows

SAMPLE = 8_000
WORDS = 160
PREFIXES = (3, 4, 5, 6)
LEAST_ROWS = 3
RIDGE = 0.3
KEPT_WORDS = 300_000
#: Sites are joined to documents by broadcast up to this many, by a shuffle beyond.
BROADCAST_SITES = 500_000
#: Beyond that, sites with more than this share of all rows are still broadcast; there are fewer of them than that.
HOT = 10_000
TARGETS = ("quality", "toxic")
_EDGE = "%#*$&|!.,;:?()[]\"'"
_SHAPES = 13


def shape(text: str, words: list[str]) -> list[float]:
    """Counts of kinds of bytes and words, as shares and logarithms."""
    octets = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n = max(1, int(octets.sum()))
    distinct = len(set(words))
    m = max(1, len(words))
    symbols = int(octets[[35, 36, 37, 38, 42]].sum())
    return [
        math.log1p(n),
        math.log1p(m),
        octets[65:91].sum() / n,
        octets[97:123].sum() / n,
        octets[48:58].sum() / n,
        octets[128:].sum() / n,
        min(1.0, symbols / m),
        min(1.0, int(octets[124]) / m),
        min(1.0, int(octets[33]) / m),
        min(1.0, int(octets[[44, 46]].sum()) / m),
        min(1.0, int(octets[10]) / m),
        distinct / m,
        math.log(distinct + 1) / math.log(m + 2),
    ]


class Vocabulary(dict):
    """A word as it stands in a lower-cased text -> the numbers of the chosen words and beginnings (^...) that it counts for."""

    def __init__(self, chosen: list[str]):
        super().__init__()
        self.chosen = {w: i for i, w in enumerate(chosen)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        bare = word.strip(_EDGE)
        forms = [bare, *("^" + bare[:n] for n in PREFIXES)] if bare else []
        found = tuple(self.chosen[f] for f in forms if f in self.chosen)
        if len(self) < KEPT_WORDS:
            self[word] = found
        return found


def features(text: str, vocabulary: Vocabulary) -> tuple[list[float], list[int], list[float]]:
    """Shape values, the numbers of the chosen words and beginnings present, and log2(1 + count) of each."""
    words = text.lower().split()
    counts: dict[int, int] = {}
    for word, n in Counter(words).items():
        for i in vocabulary[word]:
            counts[i] = counts.get(i, 0) + n
    found = sorted(counts)
    return shape(text, words), found, [math.log2(1 + counts[i]) for i in found]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton steps for ridge-penalised logistic regression; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Vocabulary, feature scaling and one weight vector per target."""

    def __init__(self, chosen: list[str], rows: list[tuple[str, int, int]]):
        self.vocabulary = vocabulary = Vocabulary(chosen)
        x = np.zeros((len(rows), _SHAPES + len(chosen)))
        for i, (text, _, _) in enumerate(rows):
            values, found, logs = features(text, vocabulary)
            x[i, :_SHAPES] = values
            x[i, [_SHAPES + j for j in found]] = logs
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.mean[_SHAPES:] = 0
        scale = x.std(axis=0) if len(x) else np.ones(x.shape[1])
        scale[_SHAPES:] = 1
        self.scale = np.where(scale > 1e-9, scale, 1)
        self.weights = []
        for target in (1, 2):
            y = np.array([r[target] for r in rows], float)
            if len(y) and 0 < y.sum() < len(y):
                w = fit_logistic((x - self.mean) / self.scale, y, RIDGE)
            else:
                w = np.zeros(x.shape[1] + 1)
                w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
            self.weights.append((w[:-1] / self.scale, float(w[-1] - (w[:-1] * self.mean / self.scale).sum())))

    def log_odds(self, text: str) -> tuple[float, float]:
        values, found, logs = features(text, self.vocabulary)
        at = [_SHAPES + j for j in found]
        return tuple(max(-30.0, min(30.0, float(w[:_SHAPES] @ values + w[at] @ logs + b))) for w, b in self.weights)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, quality, toxic) of at most `sample` labelled documents; the labels, not the texts, are sorted."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int"), F.col("toxic").cast("int"))
        .dropna()
        .groupBy("label_id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    )
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    return text_rows(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).dropDuplicates(["doc_id"]).select("text", "quality", "toxic")


def choose_words(sample: DataFrame, words: int = WORDS) -> list[str]:
    """The words whose presence differs most between the classes, for each target, by a squared z-score."""
    n, good, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    token = F.regexp_replace("word", r"""^[%#*$&|!.,;:?()\[\]"']+|[%#*$&|!.,;:?()\[\]"']+$""", "")
    starts = [F.concat(F.lit("^"), F.substring("word", 1, n)) for n in PREFIXES]
    present = (
        sample.select("quality", "toxic", F.xxhash64("text").alias("id"), F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word"))
        .select("quality", "toxic", "id", token.alias("word"))
        .where("word <> ''")
        .select("quality", "toxic", "id", F.explode(F.array("word", *starts)).alias("word"))
        .distinct()
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))
        .where(F.col("df") >= LEAST_ROWS)
    )

    def z2(hits: Column, total: int) -> Column:
        share = total / max(1, n)
        return F.pow(hits - F.col("df") * share, 2) / (F.col("df") * max(1e-9, share * (1 - share)))

    present = materialize(present.select("word", z2(F.col("good"), good).alias("z_good"), z2(F.col("toxic"), toxic).alias("z_toxic")), "quality-words")
    chosen: dict[str, None] = {}
    for z in ("z_toxic", "z_good"):
        chosen |= dict.fromkeys(r.word for r in present.orderBy(F.desc(z), "word").limit(min(words, n // 3)).collect())
    return list(chosen)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The two models, from the bounded labelled sample."""
    rows = materialize(labelled_sample(docs, labels, sample), "quality-sample")
    return Model(choose_words(rows), [(r.text, r.quality, r.toxic) for r in rows.toLocalIterator()])


def score(docs: DataFrame, model: Model, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, host, path, quality_evidence, toxic_evidence): log-odds of every document's own text."""
    spark = docs.sparkSession
    ship(spark)
    arrow_rows(spark, 512)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            yield [(doc_id, h, p, *sent.value.log_odds(text)) for doc_id, text, h, p in batch]

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col(host).cast("string").alias("host"),
        F.col(path).cast("string").alias("path"),
    )
    return map_rows(rows, "doc_id long, host string, path string, quality_evidence double, toxic_evidence double", run)


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (F.lit(1.0) - p))


def _strength(inside: float, spread: float) -> float:
    """Prior strength in documents: the variance inside paths over the variance between sites."""
    return min(1e6, max(inside, 1e-9) / spread) if spread > 0 else 1e6


def strengths(m: Row, target: str) -> tuple[float, float]:
    """(of hosts around the global mean, of paths around their host), by moments of the nested grouping."""
    inside = (m[f"ss_{target}"] - m[f"paths_{target}"]) / max(1.0, m["n"] - m["k"])
    within = m["n"] - m["same_path"]
    path = (m[f"paths_{target}"] - m[f"hosts_{target}"] - (m["k"] - m["hosts"]) * inside) / within if within > 1e-6 else 0.0
    across = m["n"] - m["same_host"] / m["n"]
    host = m[f"hosts_{target}"] - m[f"s_{target}"] ** 2 / m["n"] - (m["hosts"] - 1) * inside - max(0.0, path) * (m["same_path"] - m["squares"] / m["n"])
    return _strength(inside, host / across if across > 1e-6 else 0.0), _strength(inside, path)


def _site_rows(scored: DataFrame) -> DataFrame:
    """One row a path: its documents and sums of each target, and those of its host."""
    p = {t: _sigmoid(F.col(f"{t}_evidence")) for t in TARGETS}
    sums = [x for t in TARGETS for x in (F.sum(p[t]).alias(f"s_{t}"), F.sum(p[t] * p[t]).alias(f"ss_{t}"))]
    paths = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *sums), "quality-paths")
    hosts = paths.groupBy(F.col("host").alias("host_key")).agg(F.sum("n").alias("host_n"), *(F.sum(f"s_{t}").alias(f"host_s_{t}") for t in TARGETS))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("host_key"))).drop("host_key")
    return materialize(joined.withColumnsRenamed({"host": "site_host", "path": "site_path"}), "quality-sites")


def _with_sites(scored: DataFrame, sites: DataFrame, paths: int, rows: int) -> DataFrame:
    """scored with its site's columns: by broadcast up to BROADCAST_SITES paths; beyond, only of paths with more than a HOT-th of all rows (fewer than HOT)."""
    at = F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path"))
    if paths <= BROADCAST_SITES:
        return scored.join(F.broadcast(sites), at)
    large = F.col("n") > rows / HOT
    hot = F.broadcast(sites.where(large))
    return scored.join(hot, at).unionByName(scored.join(hot, at, "left_anti").join(sites.where(~large), at))


def classify(docs: DataFrame, model: Model, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, quality_score, toxic_score, host_quality, path_quality, keep for every row.

    A host's share of good documents is drawn toward the global one and a path's toward its host's, the stronger the fewer
    documents it has; a document's score is its own evidence moved by what the others of its site say, itself left out.
    keep: good quality and no toxicity, each at posterior one half.
    """
    scored = materialize(score(docs, model, host, path), "quality-scores")
    sites = _site_rows(scored)
    n, host_n = F.col("n"), F.col("host_n")
    moments = [F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(n * n.cast("double")).alias("squares"), F.sum(n / host_n).alias("hosts"),
               F.sum(n * n.cast("double") / host_n).alias("same_path"), F.sum(n * host_n.cast("double")).alias("same_host")]
    for t in TARGETS:
        s, host_s = F.col(f"s_{t}"), F.col(f"host_s_{t}")
        moments += [F.sum(s).alias(f"s_{t}"), F.sum(f"ss_{t}").alias(f"ss_{t}"), F.sum(s * s / n).alias(f"paths_{t}"), F.sum(n / host_n * host_s * host_s / host_n).alias(f"hosts_{t}")]
    m = sites.agg(*moments).first()
    out = _with_sites(scored, sites, m["k"], m["n"] or 0)
    for t in TARGETS:
        mean = m[f"s_{t}"] / m["n"] if m["n"] else 0.5
        a, b = strengths(m, t) if m["n"] else (1.0, 1.0)
        own = _sigmoid(F.col(f"{t}_evidence"))
        of_host = lambda less, one: (F.col(f"host_s_{t}") - less + a * mean) / (host_n - one + a)  # noqa: B023, E731
        of_path = lambda less, one: (F.col(f"s_{t}") - less + b * of_host(less, one)) / (n - one + b)  # noqa: B023, E731
        shift = _logit(of_path(own, 1)) - _logit(F.lit(mean))
        none = F.lit(0.0)
        out = out.withColumns({f"{t}_score": _sigmoid(F.col(f"{t}_evidence") + shift), f"host_{t}": of_host(none, 0), f"path_{t}": of_path(none, 0)})
    keep = (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5)
    return out.select("doc_id", "quality_score", "toxic_score", "host_quality", "path_quality", keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rejected ids; all columns stay. Rows without an id stay.

    An id goes if any of its rows is rejected. The rejected ids are broadcast up to a million of
    them and joined by a shuffle beyond.
    """
    verdict = materialize(classify(docs, fit(docs, labels)).where("not keep").select(F.col("doc_id").alias("__gone")).distinct(), "quality-rejects")
    gone = F.broadcast(verdict) if verdict.count() <= 1_000_000 else verdict
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
