"""Language identification as a mixture: proportions by expectation-maximisation, languages by penalised likelihood.

Each language is a character trigram model of words (lower-cased letter runs between word edges), with
add-half smoothing, fitted on at most SAMPLE documents per language. A document is a bag of words; the
likelihood of its words under every language is fixed, and expectation-maximisation finds the
proportions, in rounds until none moves by more than TOLERANCE (the likelihood has one maximum, so
rounds end). Languages are ranked by their proportion under all of them; of the nested sets of the
first one, two, ... the one with the largest log-likelihood less PENALTY log(words) per further
language is selected and refitted. The prediction is the largest proportion of that set, and the score
is that proportion.

Defined cases: null texts and texts without a letter are `und` with score 0; equal proportions take
the smaller language name; null ids are predicted, never learned from and not held out; repeated rows
are predicted row by row; no learned language makes every document `und`; an empty table gives no
rows; other columns are ignored; texts and words of any length are read whole. Letters are Unicode letters
and the marks that follow them; other numbers and signs are none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import arrow_rows, map_rows, materialize, ship

SAMPLE = 1_500
PENALTY = 2.0
TOLERANCE = 1e-4
KEPT_WORDS = 300_000
KEPT_LETTERS = 40
BROADCAST_ROWS = 1_000_000
# Below U+02B0 the word characters but these and the decimal digits are letters, and there are no marks.
_NEAR = re.compile("[\0-\u02af]*")
_WORD = re.compile(r"[^\W\d_²³¹¼½¾]+")
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: str) -> list[str]:
    low = text.lower()
    return (_WORD if _NEAR.fullmatch(low) else _LETTERS).findall(low)


def _grams(word: str) -> list[str]:
    edged = f"  {word} "
    return [edged[i : i + 3] for i in range(len(edged) - 2)]


class Model:
    """log P(third character | first two) per language, from trigram counts."""

    def __init__(self, languages: list[str], counts: dict[str, list[int]]):
        self.languages = languages
        k = len(languages)
        alphabet = max(1, len({g[2] for g in counts}))
        pairs: dict[str, np.ndarray] = {}
        for g, c in counts.items():
            pairs[g[:2]] = pairs.get(g[:2], np.zeros(k)) + c
        # One table of log-probabilities: known trigrams, then unseen thirds after known pairs, then the rest.
        self.grams = {g: i for i, g in enumerate(counts)}
        self.pairs = {p: len(counts) + i for i, p in enumerate(pairs)}
        known = [np.log((np.asarray(c) + 0.5) / (pairs[g[:2]] + 0.5 * alphabet)) for g, c in counts.items()]
        known += [np.log(0.5 / (c + 0.5 * alphabet)) for c in pairs.values()]
        self.logs = np.array([*known, np.full(k, -np.log(alphabet))])
        self.kept: dict[str, int] = {}
        self.rows = np.empty((1024, k))

    def words(self, new: list[str]) -> np.ndarray:
        """Log-likelihoods of words under every language, one row each."""
        rows: list[int] = []
        starts = []
        grams, pairs, last = self.grams.get, self.pairs.get, len(self.logs) - 1
        for word in new:
            starts.append(len(rows))
            for g in _grams(word):
                at = grams(g)
                rows.append(pairs(g[:2], last) if at is None else at)
        return np.add.reduceat(self.logs[rows], starts, axis=0)

    def table(self, distinct: list[str]) -> np.ndarray:
        """Log-likelihoods of words, one row each; common words are kept between calls."""
        get = self.kept.get
        at = np.fromiter((get(w, -1) for w in distinct), np.int64, len(distinct))
        missing = np.flatnonzero(at < 0)
        out = self.rows[np.maximum(at, 0)]
        if len(missing):
            new = [distinct[i] for i in missing.tolist()]
            out[missing] = values = self.words(new)
            first: dict[str, int] = {}
            for i, w in enumerate(new[: KEPT_WORDS - len(self.kept)]):
                if len(w) <= KEPT_LETTERS:
                    first.setdefault(w, i)
            while len(self.rows) < len(self.kept) + len(first):
                self.rows = np.concatenate((self.rows, np.empty_like(self.rows)))
            for w, i in first.items():
                self.rows[len(self.kept)] = values[i]
                self.kept[w] = len(self.kept)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, proportion) of each text; documents of a batch are fitted side by side."""
        bags = [Counter(words(t)) if t else Counter() for t in texts]
        sizes = np.array([len(b) for b in bags])
        some = np.flatnonzero(sizes)
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not len(some) or not self.languages:
            return out
        n = np.fromiter((c for b in bags for c in b.values()), float)
        logs = self.table([w for b in bags for w in b])
        ends = np.cumsum(sizes[some])
        starts, owner = ends - sizes[some], np.repeat(np.arange(len(some)), sizes[some])
        high = logs.max(axis=1, keepdims=True)
        likely = np.exp(logs - high)
        base = np.add.reduceat(n * high[:, 0], starts)
        total = np.add.reduceat(n, starts)
        k = len(self.languages)

        def fit(allowed: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Proportions over the allowed languages and their log-likelihood, for some of the documents."""
            inside = np.isin(owner, docs) if len(docs) < len(some) else slice(None)
            lengths = (ends - starts)[docs]
            at, of, m, x = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(docs)), lengths), n[inside], likely[inside]
            share = allowed / allowed.sum(axis=1, keepdims=True)
            live, begin, who, much, rows = np.arange(len(docs)), at, of, m, x
            while len(live):
                parts = share[live][who] * rows
                parts *= (much / np.maximum(parts.sum(axis=1), 1e-300))[:, None]
                now = np.add.reduceat(parts, begin, axis=0) / total[docs[live], None]
                moves = np.abs(now - share[live]).max(axis=1) > TOLERANCE
                share[live] = now
                if not moves.all():  # a document is done for itself, whatever the others of its batch do
                    kept = moves[who]
                    live, much, rows = live[moves], much[kept], rows[kept]
                    lengths = np.bincount(who[kept], minlength=len(moves))[moves]
                    begin, who = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(live)), lengths)
            mixed = np.maximum((share[of] * x).sum(axis=1), 1e-300)
            return share, base[docs] + np.add.reduceat(m * np.log(mixed), at)

        everything, most = fit(np.ones((len(some), k)), np.arange(len(some)))
        # Ties between proportions go to the smaller name: the languages are in order of names.
        order = np.argsort(-everything, axis=1, kind="stable")
        chosen = np.zeros((len(some), k))
        np.put_along_axis(chosen, order[:, :1], 1.0, axis=1)
        best = np.take_along_axis(np.add.reduceat(n[:, None] * logs, starts, axis=0), order[:, :1], axis=1)[:, 0]
        step = PENALTY * np.log(total + 1)
        # All languages together explain a document best; where even they gain less than one step, one language stays.
        docs = np.flatnonzero(most - best > step)
        for size in range(2, k + 1):
            if not len(docs):
                break
            allowed = np.zeros((len(docs), k))
            np.put_along_axis(allowed, order[docs, :size], 1.0, axis=1)
            share, value = fit(allowed, docs) if size < k else (everything[docs], most[docs])
            value = value - (size - 1) * step[docs]
            better = value > best[docs]
            best[docs] = np.where(better, value, best[docs])
            chosen[docs[better]] = share[better]
        top = chosen.argmax(axis=1)
        for i, row, t in zip(some.tolist(), chosen, top.tolist(), strict=True):
            out[i] = (self.languages[t], float(min(1.0, row[t])))
        return out


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Trigram models of all languages seen outside the held-out documents.

    At most `sample` documents per language, by a hash of the id: ids are ranked, texts only joined.
    """
    spark = docs.sparkSession
    ship(spark)
    arrow_rows(spark, 512)
    learn = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = learn.select(F.col("doc_id").alias("__id"), F.col("lang").cast("string").alias("__lang"))
    order = [F.xxhash64("__id"), F.col("__id")]
    # First within salted parts of a language, so that the last ranking of a large one sees a bounded number of ids.
    ids = ids.withColumn("__salt", F.pmod(F.xxhash64(F.lit(3), "__id"), F.lit(64)))
    for spec in (Window.partitionBy("__lang", "__salt"), Window.partitionBy("__lang")):
        ids = ids.withColumn("n", F.row_number().over(spec.orderBy(*order))).where(F.col("n") <= sample).drop("n")
    chosen = materialize(ids.select("__id").distinct(), "langid-sample")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    rows = learn.join(chosen, F.col("doc_id") == F.col("__id"), "left_semi").select(F.col("lang").cast("string").alias("lang"), "text")

    def count(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in batch:
                seen = found.setdefault(lang, Counter())
                for word, n in Counter(words(text)).items():
                    for g in _grams(word):
                        seen[g] += n
        yield [(lang, g, n) for lang, seen in found.items() for g, n in seen.items()]

    counted = map_rows(rows, "lang string, gram string, n long", count).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = materialize(counted, "langid-grams").collect()
    languages = sorted({r.lang for r in found})
    place = {lang: i for i, lang in enumerate(languages)}
    counts: dict[str, list[int]] = {}
    for r in found:
        counts.setdefault(r.gram, [0] * len(languages))[place[r.lang]] = r.n
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; the text alone is looked at."""
    spark = docs.sparkSession
    ship(spark)
    arrow_rows(spark, 256)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            found = sent.value.predict([text for _, text in batch])
            yield [(doc_id, *f) for (doc_id, _), f in zip(batch, found, strict=True)]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = map_rows(rows, "doc_id long, lang_pred string, score double", run)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
