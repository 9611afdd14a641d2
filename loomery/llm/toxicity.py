"""Toxicity: a linear-chain conditional random field tags toxic tokens, its marginals score documents.

Tokens are runs of letters, lower-cased. Features of a token are itself and its beginnings and endings of 4 to 6
letters; those that labelled toxic documents hold far more often than clean ones (a likelihood-ratio test) form the
lexicon, and tokens of toxic documents that hold one are the labelled toxic tokens. Two tags, weights for lexicon
features and tag pairs, fitted by gradient ascent on the conditional likelihood. In a whole text only tokens with a
lexicon feature differ from the background, so forward-backward jumps over runs of other tokens by matrix powers:
it is exact over texts of any length.

The log-odds that some lexicon token is toxic are calibrated to document labels by a logistic curve.

Defined results: null and empty texts, like all texts without a lexicon token, score the share of toxic ones among such
labelled documents (at most 0.5), and all texts 0 if there is no toxic or no clean labelled document. Documents labelled
both ways count as toxic. Rows are scored one by one, repeated or not; other columns, whatever their names, pass through
``keep_clean`` unchanged; empty tables give empty results. The bounded part is the fit: at most SAMPLE toxic and
2 * SAMPLE clean documents, by smallest hash, equal texts of one label taken once, and LEXICON features.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import by_slices, held, remainder

SAMPLE, LEXICON = 1000, 4000
#: Twice the log-likelihood ratio and the ratio of shares that a lexicon feature has at least.
EVIDENCE, RATIO = 30.0, 8.0
#: Tokens on either side of a labelled one in training windows, steps and rate of the ascent, weight of the penalty.
AROUND, STEPS, RATE, PENALTY = 8, 80, 0.3, 1e-3
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
#: Words whose weights a tagger keeps, and the longest of them.
WORDS_KEPT, LONGEST_KEPT = 100_000, 40


def words_of(text: str) -> list[str]:
    """The words of a text, each in lower case by itself: lower-casing a whole text may move places."""
    return [w.lower() for w in WORD.findall(text)]


def features(word: str) -> list[str]:
    """The word, its beginnings and its endings."""
    return [word, *(word[:k] + "-" for k in range(4, 7) if len(word) > k), *("-" + word[-k:] for k in range(4, 7) if len(word) > k)]


def lexicon(toxic: list[str], clean: list[str]) -> list[str]:
    """Features that are far more frequent, by document, in ``toxic``."""
    inside, outside = Counter(), Counter()
    for texts, counts in ((toxic, inside), (clean, outside)):
        for text in texts:
            counts.update({f for w in set(words_of(text)) for f in features(w)})
    n, m = len(toxic), len(clean)

    def evidence(a: int, b: int) -> float:
        share = (a + b) / (n + m)
        terms = ((a, n * share), (n - a, n * (1 - share)), (b, m * share), (m - b, m * (1 - share)))
        return 2 * sum(x * math.log(x / y) for x, y in terms if x)

    found = [(evidence(a, outside[f]), f) for f, a in inside.items() if a >= 3 and a * (m + 1) >= RATIO * (outside[f] + 0.5) * (n + 1)]
    return [f for _, f in sorted(((e, f) for e, f in found if e >= EVIDENCE), key=lambda x: (-x[0], x[1]))[:LEXICON]]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(emission: np.ndarray, transition: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded windows: tag marginals [b, t, 2], summed pair marginals [2, 2], log partitions."""
    size, steps, _ = emission.shape
    ahead, back = np.zeros_like(emission), np.zeros_like(emission)
    ahead[:, 0] = emission[:, 0]
    for t in range(1, steps):
        step = _log_sum(ahead[:, t - 1, :, None] + transition, 1) + emission[:, t]
        ahead[:, t] = np.where(used[:, t, None], step, ahead[:, t - 1])
    for t in range(steps - 2, -1, -1):
        step = _log_sum(transition + (emission[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where(used[:, t + 1, None], step, 0)
    total = _log_sum(ahead[:, -1], 1)
    tags = np.exp(ahead + back - total[:, None, None]) * used[:, :, None]
    pairs = np.exp(ahead[:, :-1, :, None] + transition + (emission + back)[:, 1:, None, :] - total[:, None, None, None])
    return tags, (pairs * used[:, 1:, None, None]).sum((0, 1)), total


def fit(toxic: list[str], clean: list[str]) -> dict:
    """Weights: ``lexicon`` feature -> weight of the toxic tag, ``bias`` of the toxic tag, ``transition`` [2, 2]."""
    names = lexicon(toxic, clean) if toxic and clean else []
    place = {f: i for i, f in enumerate(names)}
    windows: list[tuple[list[list[int]], list[int]]] = []
    for texts, label in ((toxic, 1), (clean, 0)):
        for text in texts:
            held = [[place[f] for f in features(w) if f in place] for w in words_of(text)]
            marks = [i for i, x in enumerate(held) if x] or ([len(held) // 2] if held else [])
            for i in marks:
                part = held[max(0, i - AROUND) : i + AROUND + 1]
                windows.append((part, [int(bool(x) and label == 1) for x in part]))
    weights = {"lexicon": {}, "bias": 0.0, "transition": [[0.0, 0.0], [0.0, 0.0]], "slope": 1.0, "shift": 0.0, "none": 0.0}
    if not names or not windows:
        return weights
    steps = 2 * AROUND + 1
    used = np.zeros((len(windows), steps), bool)
    tags = np.zeros((len(windows), steps), np.int64)
    rows, columns, places = [], [], []
    for b, (part, labels) in enumerate(windows):
        used[b, : len(part)] = True
        tags[b, : len(part)] = labels
        for t, held in enumerate(part):
            rows += [b] * len(held)
            columns += [t] * len(held)
            places += held
    rows, columns, places = (np.array(x, np.int64) for x in (rows, columns, places))
    theta = np.zeros(len(names) + 5)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    pairs_seen = np.zeros((2, 2))
    np.add.at(pairs_seen, (tags[:, :-1][used[:, 1:]], tags[:, 1:][used[:, 1:]]), 1)
    for step in range(1, STEPS + 1):
        emission = np.zeros((*used.shape, 2))
        np.add.at(emission[:, :, 1], (rows, columns), theta[places])
        emission[:, :, 1] += theta[-5]
        found, pairs, _ = marginals(emission, theta[-4:].reshape(2, 2), used)
        gap = (tags - found[:, :, 1]) * used
        slope = np.concatenate([np.bincount(places, gap[rows, columns], len(names)), [gap.sum()], (pairs_seen - pairs).ravel()])
        slope = slope / len(windows) - PENALTY * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights |= {"lexicon": dict(zip(names, theta[: len(names)].tolist(), strict=True)), "bias": float(theta[-5]), "transition": theta[-4:].reshape(2, 2).tolist()}
    return weights | calibrated(weights, toxic, clean)


def calibrated(weights: dict, toxic: list[str], clean: list[str]) -> dict:
    """``slope`` and ``shift`` of a logistic curve from the log-odds that some token is toxic to the document's label,
    and ``none``, the share of toxic ones among documents without a lexicon token."""
    tagger = Tagger(weights)
    found = [(tagger.odds(text), label) for texts, label in ((toxic, 1), (clean, 0)) for text in texts]
    bare = [y for z, y in found if z is None]
    z, y = np.array([(z, y) for z, y in found if z is not None], float).reshape(-1, 2).T
    x, beta = np.stack([z, np.ones_like(z)]), np.array([1.0, 0.0])
    for _ in range(30):  # Newton's method, held towards the identity
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        slope = x @ (y - p) - (beta - [1.0, 0.0])
        beta += np.linalg.solve((x * (p * (1 - p))) @ x.T + np.eye(2), slope)
    return {"slope": float(max(beta[0], 0.05)), "shift": float(beta[1]), "none": min(0.5, (sum(bare) + 0.5) / (len(bare) + 1))}


class Tagger:
    """Exact marginals of the lexicon tokens of texts of any length."""

    def __init__(self, weights: dict):
        self.lexicon, self.bias, self.none = weights["lexicon"], weights["bias"], weights["none"]
        self.slope, self.shift = weights["slope"], weights["shift"]
        self.step = np.exp(np.array(weights["transition"]))
        self.background = self.step * np.exp([0.0, self.bias])
        self.words: dict[str, float | None] = {}

        @lru_cache(4096)
        def power(k: int) -> np.ndarray:
            """The background matrix to the k-th power, scaled."""
            out = np.linalg.matrix_power(self.background / self.background.sum(), k) if k < 64 else power(k // 2) @ power(k - k // 2)
            return out / out.sum()

        self.power = power

    def weight(self, word: str) -> float | None:
        """Summed weights of the word's lexicon features, in whatever case it is written; None without any."""
        if word in self.words:
            return self.words[word]
        found = [self.lexicon[f] for f in features(word.lower()) if f in self.lexicon]
        weight = sum(found) if found else None
        if len(word) <= LONGEST_KEPT:
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            self.words[word] = weight
        return weight

    def odds(self, text: str) -> float | None:
        """Log-odds that some lexicon token of the text is toxic, None without such tokens."""
        none, spans = self.chain(text)
        return math.log(-math.expm1(none)) - none if spans else None

    def tag(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """(score, (begin, end, marginal) of the lexicon tokens) of a text; offsets are in its characters."""
        none, spans = self.chain(text)
        if not spans:
            return self.none, []
        odds = self.slope * (math.log(-math.expm1(none)) - none) + self.shift
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))), spans

    def chain(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """(log-probability that no lexicon token is toxic, (begin, end, marginal) of the lexicon tokens)."""
        words = WORD.findall(text) if self.lexicon else []
        weigh = self.weight
        hits = [(i, w) for i, x in enumerate(words) if (w := weigh(x)) is not None]
        if not hits:
            return 0.0, []
        ahead, matrices = [], []
        last, row = -1, None
        for i, w in hits:
            gap = i - last - 1
            end = self.step * np.exp([0.0, min(60.0, w + self.bias)])
            if row is None:
                start = np.array([1.0, math.exp(self.bias)])
                row = np.array([1.0, math.exp(min(60.0, w + self.bias))]) if i == 0 else start @ self.power(i - 1) @ end
            else:
                matrix = self.power(gap) @ end if gap else end
                matrices.append(matrix)
                row = row @ matrix
            row = row / row.sum()
            ahead.append(row)
            last = i
        rest = len(words) - 1 - last
        back = self.power(rest) @ np.ones(2) if rest else np.ones(2)
        spans, none = [], 0.0
        for k in range(len(hits) - 1, -1, -1):
            both = ahead[k] * back
            p = float(both[1] / both.sum())
            spans.append((hits[k][0], p))
            p = min(max(p, 1e-12), 1 - 1e-12)
            none += math.log1p(-p)
            if k:
                back = matrices[k - 1] @ back
                back = back / back.sum()
        places = [m.span() for m in WORD.finditer(text)]
        return none, [(*places[i], p) for i, p in reversed(spans)]


def tagger(weights: dict) -> Tagger:
    """The tagger of these weights, made once in each Python worker."""
    return held("toxicity", repr(weights), lambda: Tagger(weights))


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """Weights fitted to the labelled rows of ``docs``."""
    marks = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    ids = docs.filter(F.length("text") > 0).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    hashed = ids.join(marks, "doc_id").withColumn("h", F.xxhash64("doc_id"))
    chosen = hashed.filter("toxic = 1").orderBy("h", "doc_id").limit(SAMPLE).unionByName(hashed.filter("toxic = 0").orderBy("h", "doc_id").limit(2 * SAMPLE))
    # 3 * SAMPLE ids bound what is broadcast, and as many texts what reaches the driver.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") > 0).join(F.broadcast(chosen), "doc_id").select("toxic", "h", "text").collect()
    kept: dict[tuple[str, int], tuple] = {}
    for row in sorted(rows, key=lambda r: (r["h"], r["text"])):
        kept.setdefault((row["text"], row["toxic"]), row)
    return fit(*([r["text"] for r in kept.values() if r["toxic"] == mark] for mark in (1, 0)))


TAGGED = "score double, spans array<struct<begin:int,end:int,p:double>>"


def tag(text: Column, weights: dict) -> Column:
    """struct<score, spans> of each text; spans are its lexicon tokens with their marginals."""
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    @F.arrow_udf(TAGGED)
    def tagged(texts: pa.Array) -> pa.Array:
        found = tagger(weights)

        def scored(part: list[str | None]) -> pa.Array:
            rows = [found.tag(t or "") for t in part]
            spans = pa.array([[{"begin": a, "end": b, "p": p} for a, b, p in x] for _, x in rows], pa.list_(span))
            return pa.StructArray.from_arrays([pa.array([s for s, _ in rows], pa.float64()), spans], ["score", "spans"])

        return by_slices(texts, scored)

    return tagged.asNondeterministic()(text)


def training(docs: DataFrame) -> DataFrame:
    """The rows that labels may be learned from."""
    return docs.filter(remainder(F.col("doc_id"), 3) != 1)


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the toxic spans of every document."""
    rows = docs.select("doc_id", "text", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"))
    weights = learn(training(docs), labels)
    found = rows.select("doc_id", "held_out", tag(F.col("text"), weights).alias("x"))
    return found.select("doc_id", "held_out", F.col("x.score").alias("score"), (F.col("x.score") >= THRESHOLD).cast("int").alias("predicted"), F.expr("filter(x.spans, s -> s.p >= 0.5)").alias("spans"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns kept, that score below THRESHOLD."""
    found = docs.withColumn("__loomery_tox", tag(F.col("text"), learn(training(docs), labels)))
    return found.filter(F.col("__loomery_tox.score") < THRESHOLD).drop("__loomery_tox")
