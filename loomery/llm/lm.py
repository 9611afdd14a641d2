"""Language-model scoring: causal self-attention over subword ids, mixed word by word with corpus counts.

Words are lower-cased (A-Z) and cut into subwords of a public byte-level vocabulary; a unit is a subword and whether it
ends its word. The CLASSES classes are the most frequent units, an end of text, and shared classes for all other units,
inside which units have add-one shares of their corpus counts. A one-layer causal self-attention model, written in
numpy, predicts the next unit's class. It is trained once on every unit of every training document, in consecutive
windows of WIDTH units: documents are dealt out to ROUNDS rounds by hash, in each of which tasks descend side by side, in
batches that grow, and their weights are averaged by units. For scoring, windows of WIDTH units overlap by half, so that each unit is scored
once with at least half a window before it, in batches of masked attention.

The attention gives the class of a word's first unit; within that class a word has its corpus share among the words that
begin so, mixed with the product of its units, which any word has. The weight of corpus shares is what Good and Turing
leave to known words: all but the part of the training words that occur once. All counts (words, units, tokens) come from
all training documents. The HEAD most frequent words are looked up in each task; occurrences of others take what the
attention says of them to their counts by a shuffle join, and the same formula is applied there.

Defined results: null and empty texts are one end token; without training documents all counts are 0 and units are
uniform; rows are scored one by one, repeated or not, and a null id counts as an empty text.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import held, remainder, slices, written

CLASSES, SHARED = 128, 16
WIDTH, DEPTH = 32, 16
#: Windows of a step: BATCH at first, twice as many after every SETTLE steps, up to MOST_BATCH.
ROUNDS, BATCH, SETTLE, MOST_BATCH, RATE = 3, 16, 64, 64, 0.01
#: Most frequent words that every task holds; words that a task counts, and others whose units it keeps, before it lets go.
HEAD, WORDS_KEPT, UNITS_KEPT = 200_000, 200_000, 250_000
#: Windows scored in one step, and units whose shares of all classes are at once in the processor's cache.
WINDOWS_AT_ONCE, UNITS_AT_ONCE = 256, 1024
END, START = CLASSES - 1, CLASSES
#: Bounds of the weight of corpus shares.
LEAST, MOST = 0.5, 0.97
SHAPES = {"embed": (CLASSES + 1, DEPTH), "place": (WIDTH, DEPTH), "query": (DEPTH, DEPTH), "key": (DEPTH, DEPTH), "value": (DEPTH, DEPTH), "out": (DEPTH, CLASSES), "bias": (CLASSES,)}


def words_of(text: str | None) -> list[bytes]:
    """The words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def encoding(path: str) -> tiktoken.Encoding:
    """The public tokenizer of this vocabulary, made once in each process that uses it."""

    def made() -> tiktoken.Encoding:
        import public_tokenizers

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        return tiktoken.Encoding("lm", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return held("lm encoding", path, made, 3)


def vocabulary(path: str) -> int:
    """Ids of the tokenizer."""
    return encoding(path).max_token_value + 1


def split(texts: pa.Array | list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """(the words of the texts, one text after the other; words of each)."""
    if isinstance(texts, pa.Array):
        lists = [(text or b"").lower().split() for text in texts.cast(pa.binary()).to_pylist()]
    else:
        lists = [words_of(text) for text in texts]
    return list(chain.from_iterable(lists)), np.array([len(x) for x in lists], np.int64)


def spellings(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(units of the words one after the other, how many each has); a unit: subword id * 2 + (is it the last).

    The public pattern ends a piece before a space that a letter, digit or sign follows, so words are encoded in one call;
    those with white space of their own beyond ASCII are encoded alone."""
    tokenizer, texts = encoding(path), [word.decode("utf-8", "surrogatepass") for word in words]
    if " ".join(texts).split() != texts:
        found = [np.array(tokenizer.encode_ordinary(" " + x), np.int32) for x in texts]
        sizes = np.array([len(x) for x in found], np.int64)
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
    else:
        flat = np.array(tokenizer.encode_ordinary(" " + " ".join(texts)) if texts else [], np.int32)
        sizes = np.diff(np.flatnonzero(_begins(path)[flat]), append=len(flat))
    units = flat * 2
    units[np.cumsum(sizes) - 1] += 1
    return units, sizes


def _begins(path: str) -> np.ndarray:
    """Which ids begin with a space."""

    def made() -> np.ndarray:
        tokenizer = encoding(path)
        out = np.zeros(vocabulary(path), bool)
        for token in tokenizer.token_byte_values():
            out[tokenizer.encode_single_token(token)] = token[:1] == b" "
        return out

    return held("lm begins", path, made, 3)


def units_of(words: list[bytes], path: str) -> list[np.ndarray]:
    """Units of each word."""
    flat, sizes = spellings(words, path)
    return np.split(flat, np.cumsum(sizes)[:-1]) if words else []


class Lexicon:
    """Units of words, and their counts if they are in the head (else -1): one look-up a word, then arrays.

    ``head`` are its words, their counts, units and how many units each has; these are never let go."""

    def __init__(self, path: str, head: tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray] | None = None):
        words, counts, units, sizes = head or ([], np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.path, self.fixed = path, len(words)
        self.ids: dict[bytes, int] = dict(zip(words, range(len(words)), strict=True))
        self.begin, self.seen, self.units = np.append(0, np.cumsum(sizes)), counts, units

    def clear(self) -> None:
        self.ids = dict(islice(self.ids.items(), self.fixed))
        self.begin, self.seen = self.begin[: self.fixed + 1], self.seen[: self.fixed]
        self.units = self.units[: self.begin[-1]]

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in ``begin`` and ``seen``; words that are new are learned."""
        if len(self.ids) - self.fixed > UNITS_KEPT:
            self.clear()
        found = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            fresh = list({words[i] for i in missing.tolist()})
            units, sizes = spellings(fresh, self.path)
            self.ids.update(zip(fresh, range(len(self.ids), len(self.ids) + len(fresh)), strict=True))
            found[missing] = [self.ids[words[i]] for i in missing.tolist()]
            self.units = np.concatenate([self.units, units])
            self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(sizes))
            self.seen = np.append(self.seen, np.full(len(fresh), -1))
        return found

    def spelled(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(units of texts of ``counts`` words each, -1 after each text, where words and ends begin, where texts do)."""
        ends = np.cumsum(counts) + np.arange(len(counts))
        sizes = np.ones(len(ids) + len(counts), np.int64)
        is_word = np.ones(len(sizes), bool)
        is_word[ends] = False
        sizes[is_word] = self.begin[ids + 1] - self.begin[ids]
        begin = np.cumsum(sizes) - sizes
        flat = np.full(int(sizes.sum()), -1, np.int32)
        flat[np.repeat(is_word, sizes)] = self.units[_ranges(self.begin[ids], sizes[is_word])]
        return flat, begin, begin[ends - counts]


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs of ``sizes`` from ``begin`` on, one run after the other."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Classes:
    """Class and log10 share of every unit; ``counts`` has the units seen."""

    def __init__(self, counts: dict[int, int], firsts: dict[int, int], ends: int, vocabulary: int):
        alone = CLASSES - SHARED - 1
        common = sorted(counts, key=lambda u: (-counts[u], u))[:alone]
        every = np.arange(2 * vocabulary)
        self.of = (alone + every % SHARED).astype(np.int16)
        self.of[common] = np.arange(len(common))
        seen = np.zeros(2 * vocabulary)
        seen[list(counts)] = list(counts.values())
        members = np.bincount(self.of, minlength=CLASSES)
        totals = np.bincount(self.of, seen, CLASSES)
        share = np.log10((seen + 1) / (totals + members)[self.of])
        self.share = np.where(np.isin(every, common), 0.0, share).astype(np.float32)
        self.begins = np.bincount(self.of[list(firsts)], list(firsts.values()), CLASSES) if firsts else np.zeros(CLASSES)
        totals[END] = ends
        self.prior = np.log((totals + 1) / (totals.sum() + CLASSES)).astype(np.float32)


def start_weights(prior: np.ndarray) -> dict[str, np.ndarray]:
    """Small random weights; the bias starts at the classes' log shares."""
    random = np.random.default_rng(11)
    out = {k: (random.normal(size=s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    out["bias"] = prior.astype(np.float32)
    return out


PARTS = np.arange((CLASSES + 1) * DEPTH).reshape(-1, DEPTH)
MASK = np.where(np.tril(np.ones((WIDTH, WIDTH), bool)), 0, -1e9).astype(np.float32)


def log_shares(w: dict[str, np.ndarray], classes: np.ndarray, used: np.ndarray, target: np.ndarray, since: int) -> np.ndarray:
    """Natural log-probability of ``target`` classes at positions from ``since`` on."""
    kind, size = w["out"].dtype, len(classes)
    x = w["embed"].take(classes, axis=0)
    x += w["place"]
    late = np.ascontiguousarray(x[:, since:])
    asks = (late.reshape(-1, DEPTH) @ (w["query"] / kind.type(math.sqrt(DEPTH)))).reshape(late.shape)
    keys, values = ((x.reshape(-1, DEPTH) @ w[k]).reshape(x.shape) for k in ("key", "value"))
    weights = asks @ keys.transpose(0, 2, 1)
    mask, part = np.broadcast_to(MASK[since:], weights.shape), np.flatnonzero(~used.all(1))
    if len(part):
        mask = mask.copy()
        mask[part] += np.where(used[part], kind.type(0), kind.type(-1e9))[:, None, :]
    _exponentiate(weights, mask)
    total = (weights.reshape(-1, WIDTH) @ np.ones(WIDTH, kind)).reshape(size, -1, 1)
    heard = weights @ values
    heard /= np.maximum(total, kind.type(1e-30))
    late += heard
    seen, goal = _with_one(late), target.ravel()
    ends, out = np.concatenate([w["out"], w["bias"][None]]), np.empty(len(goal), kind)
    for a in range(0, len(goal), UNITS_AT_ONCE):
        logits = seen[a : a + UNITS_AT_ONCE] @ ends
        line = out[a : a + UNITS_AT_ONCE]
        line[:] = logits[np.arange(len(logits)), goal[a : a + UNITS_AT_ONCE]]
        line -= _exponentiate(logits)
        line -= np.log(logits @ np.ones(CLASSES, kind))
    return out.reshape(target.shape)


def _with_one(x: np.ndarray) -> np.ndarray:
    """One row a unit, with a 1 after its components, which takes the bias."""
    out = np.ones((x.size // DEPTH, DEPTH + 1), x.dtype)
    out[:, :DEPTH] = x.reshape(-1, DEPTH)
    return out


def _exponentiate(x: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray | np.float32:
    """exp in place, after ``mask`` is added, which leaves some value of each row that counts as it is; rows are shifted, by
    what is returned, only if some value could overflow or all of a row vanish."""
    shift = np.float32(0)
    near = x.max() <= 40 and x.min() >= -40
    if mask is not None:
        x += mask
    if not near:
        top = x.max(-1)
        if top.max() > 40 or top.min() < -40:
            shift = top
            x -= top[..., None]
    np.exp(x, out=x)
    return shift


def gradient(w: dict[str, np.ndarray], classes: np.ndarray, target: np.ndarray, used: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Slopes of the mean cross-entropy of whole windows, and that mean; ``used`` are the first places of each."""
    size, kind, root = len(classes), w["out"].dtype, w["out"].dtype.type(math.sqrt(DEPTH))
    x = w["embed"].take(classes, axis=0)
    x += w["place"]
    flat = x.reshape(-1, DEPTH)
    asks, keys, values = ((flat @ a).reshape(x.shape) for a in (w["query"] / root, w["key"], w["value"]))
    shares = asks @ keys.transpose(0, 2, 1)
    _exponentiate(shares, MASK)  # places that are not used come last, so no other looks at them
    shares /= (shares.reshape(-1, WIDTH) @ np.ones(WIDTH, kind)).reshape(size, WIDTH, 1)
    heard = shares @ values
    heard += x
    seen = _with_one(heard)
    goal, real, n = target.ravel(), used.ravel(), max(1, int(used.sum()))
    ends, out = np.concatenate([w["out"], w["bias"][None]]), np.ascontiguousarray(w["out"].T)
    back, to_ends, loss = np.empty(flat.shape, kind), np.zeros(ends.shape, kind), 0.0
    for a in range(0, len(goal), UNITS_AT_ONCE):
        here = slice(a, a + UNITS_AT_ONCE)
        p = seen[here] @ ends
        _exponentiate(p)
        total, rows = p @ np.ones(CLASSES, kind), np.arange(len(p))
        hit = p[rows, goal[here]]
        loss -= np.log(hit / total + 1e-30)[real[here]].sum()
        p[rows, goal[here]] = hit - total
        scale = (real[here] / (kind.type(n) * total)).astype(kind)[:, None]  # of the few components, not of all classes
        runs = math.gcd(len(p) // WIDTH, 4) * WIDTH  # a sum over few rows at a time stays in the cache
        to_ends += ((seen[here] * scale).reshape(-1, runs, DEPTH + 1).transpose(0, 2, 1) @ p.reshape(-1, runs, CLASSES)).sum(0)
        np.multiply(p @ out, scale, out=back[here])
    slope, back = {"out": to_ends[:DEPTH], "bias": to_ends[DEPTH]}, back.reshape(x.shape)
    to_shares, to_values = back @ values.transpose(0, 2, 1), shares.transpose(0, 2, 1) @ back
    to_shares -= np.einsum("bij,bij->bi", to_shares, shares)[:, :, None]
    to_shares *= shares
    for name, move in (("query", to_shares @ keys / root), ("key", to_shares.transpose(0, 2, 1) @ asks), ("value", to_values)):
        move = move.reshape(-1, DEPTH)
        slope[name] = flat.T @ move
        back += (move @ w[name].T).reshape(back.shape)
    slope["place"] = back.sum(0)
    slope["embed"] = np.bincount(PARTS.take(classes, axis=0).ravel(), back.ravel(), (CLASSES + 1) * DEPTH).reshape(-1, DEPTH).astype(kind)
    return slope, float(loss / n)


class Descent:
    """Adam over the weights, which lie one after the other in ``flat``."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.flat = np.concatenate([w[k].ravel() for k in SHAPES])
        self.w, at = {}, 0
        for k, s in SHAPES.items():
            self.w[k] = self.flat[at : at + math.prod(s)].reshape(s)
            at += math.prod(s)
        self.first, self.second, self.step = np.zeros_like(self.flat), np.zeros_like(self.flat), 0

    def take(self, classes: np.ndarray, target: np.ndarray, used: np.ndarray) -> float:
        """One step; returns the loss before it."""
        slope, loss = gradient(self.w, classes, target, used)
        self.step += 1
        g = np.concatenate([slope[k].ravel() for k in SHAPES])
        self.first = 0.9 * self.first + 0.1 * g
        self.second = 0.99 * self.second + 0.01 * g * g
        move = (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.99**self.step)) + 1e-8)
        self.flat -= (RATE * move).astype(np.float32)
        return loss


def training_windows(groups: Iterator[pa.Array | list[str | None]], path: str, of: np.ndarray, head: tuple | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(classes of WIDTH units and the one before, how many are real) of consecutive windows that hold every unit of every
    text; those of a group of texts in an order by chance, so that a batch is not of one text."""
    words, random = Lexicon(path, head), np.random.default_rng(13)
    for group in groups:
        every, counts = split(group)
        flat, _, begin = words.spelled(words.look_up(every), counts)
        goal = np.where(flat < 0, END, of[flat]).astype(np.int16)
        before = np.empty_like(goal)
        before[1:] = goal[:-1]
        before[begin] = START
        sizes = np.diff(begin, append=len(flat))
        each = -(-sizes // WIDTH)
        at = _ranges(np.zeros_like(each), each) * WIDTH
        real = np.minimum(np.repeat(sizes, each) - at, WIDTH)
        at += np.repeat(begin, each)
        lines = np.zeros((len(at), WIDTH + 1), np.int16)
        lines[:, 0] = before[at]
        inside = np.arange(WIDTH) < real[:, None]
        lines[:, 1:][inside] = goal  # windows follow one another, so do their units
        order = random.permutation(len(at))
        yield lines[order], real[order]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all documents; tasks count before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return batch

        for batch in batches:
            for part in slices(batch, "text"):
                seen.update(split(part.column(0))[0])
                if len(seen) > WORDS_KEPT:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def unit_counts(counts: DataFrame, path: str) -> tuple[dict[int, int], dict[int, int]]:
    """Corpus counts of units, and of those that begin a word; the vocabulary bounds their number."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 2 * vocabulary(path)
        total = np.zeros(2 * size, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                found, sizes = spellings(part.column(0).to_pylist(), path)
                times = part.column(1).to_numpy()
                np.add.at(total, found, np.repeat(times, sizes))
                np.add.at(total, found[np.cumsum(sizes) - sizes] + size, times)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["u", "c"])

    rows = counts.select("word", "c").mapInArrow(counted, "u long, c long").groupBy("u").agg(F.sum("c").alias("c")).collect()
    size = 2 * vocabulary(path)
    return {r["u"]: r["c"] for r in rows if r["u"] < size}, {r["u"] - size: r["c"] for r in rows if r["u"] >= size}


def fit(docs: DataFrame, classes: Classes, path: str, head: Broadcast) -> dict[str, np.ndarray]:
    """Weights trained by every unit of ``docs`` (doc_id, text), whose rows are dealt out to the rounds by hash; ``head``
    spares the tasks the spelling of its words."""
    spark = docs.sparkSession
    weights = start_weights(classes.prior)
    for turn in range(ROUNDS):
        dealt = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == turn)
        shared = spark.sparkContext.broadcast((weights, classes.of))

        def descended(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now, of = shared.value
            descent, seen = Descent(now), 0
            rest, left = np.zeros((0, WIDTH + 1), np.int16), np.zeros(0, np.int64)
            groups = (part.column(0) for batch in batches for part in slices(batch, "text"))

            def step(lines: np.ndarray, real: np.ndarray) -> None:
                lines = lines.astype(np.int64)
                descent.take(lines[:, :-1], lines[:, 1:], np.arange(WIDTH) < real[:, None])

            for lines, real in training_windows(groups, path, of, head.value):
                seen += int(real.sum())
                lines, real = np.concatenate([rest, lines]), np.concatenate([left, real])
                at = 0
                while at + (size := min(MOST_BATCH, BATCH << descent.step // SETTLE)) <= len(lines):
                    step(lines[at : at + size], real[at : at + size])
                    at += size
                rest, left = lines[at:], real[at:]
            if len(rest):
                step(rest, left)
            flat = descent.flat.astype(np.float64)
            rows = np.arange(len(flat)) if seen else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(flat[: len(rows)] * seen), pa.array(np.full(len(rows), seen))], ["i", "x", "n"])

        # One row a weight reaches the driver, however many tasks there are.
        rows = dealt.select("text").mapInArrow(descended, "i long, x double, n long").groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
        flat = np.zeros(sum(math.prod(s) for s in SHAPES.values()))
        for r in rows:
            flat[r["i"]] = r["x"] / r["n"]
        if rows:
            at = 0
            for k, s in SHAPES.items():
                weights[k] = flat[at : at + math.prod(s)].reshape(s).astype(np.float32)
                at += math.prod(s)
        shared.unpersist()
    return weights


class Scorer:
    """Scores texts by attention windows and the head of the word counts, which a Lexicon has."""

    def __init__(self, weights: dict[str, np.ndarray], classes: Classes, tokens: int, kinds: int, once: int, ends: int, path: str):
        self.weights, self.classes, self.path = weights, classes, path
        self.all, self.ends = tokens + kinds + 1, ends
        #: Weight of corpus shares: the part of the training words that are not the only ones of their kind.
        self.mix = min(MOST, max(LEAST, 1 - once / (tokens - ends) if tokens > ends else 0))
        with np.errstate(divide="ignore"):
            self.per_begin = np.where(classes.begins > 0, 1 / classes.begins, 0)

    def unit_scores(self, flat: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each unit of texts that begin at ``begins``: its class, log10 of the class's probability and of the unit's
        share in it; -1 is the end of a text."""
        half = WIDTH // 2
        target = np.where(flat < 0, END, self.classes.of[flat]).astype(np.int16)
        extra = np.where(flat < 0, 0, self.classes.share[flat])
        sizes = np.diff(begins, append=len(flat))
        each = -(-sizes // half)
        owner = np.repeat(np.arange(len(sizes)), each)
        first = _ranges(np.zeros_like(each), each) * half
        out, done = np.empty(len(flat), np.float32), 0
        for a in range(0, len(owner), WINDOWS_AT_ONCE):
            who, spot = owner[a : a + WINDOWS_AT_ONCE], first[a : a + WINDOWS_AT_ONCE]
            place = spot[:, None] + np.arange(-half, half)  # of the unit that each position predicts
            used = (place >= 0) & (place < sizes[who][:, None])
            at = begins[who][:, None] + place
            before = np.where(place == 0, START, target.take(at - 1, mode="clip"))
            goal = target.take(at[:, half:], mode="clip")
            found = log_shares(self.weights, np.where(used, before, 0), used, goal, half)[used[:, half:]]
            out[done : done + len(found)] = found  # windows follow one another, so do the units they score
            done += len(found)
        return target, out / np.float32(math.log(10)), extra

    def score(self, texts: pa.Array | list[str | None], words: Lexicon) -> tuple[list, ...]:
        """(tokens, known head tokens, base of head tokens, score without the mixtures of other words, these words as they
        occur, the corpus share that one count is to each, their spelled probabilities) of the texts."""
        every, counts = split(texts)
        ids = words.look_up(every)
        flat, begin, texts_begin = words.spelled(ids, counts)
        kind, line, extra = self.unit_scores(flat, texts_begin)
        ends = np.cumsum(counts) + np.arange(len(counts))  # among words and ends
        is_word = np.ones(len(begin), bool)
        is_word[ends] = False
        seen = np.full(len(begin), self.ends, np.int64)
        seen[is_word] = words.seen[ids]
        first = line[begin].astype(np.float64)
        spelled = 10.0 ** np.maximum(np.add.reduceat(line + extra, begin, dtype=np.float64) - first, -300)
        per_count = self.per_begin[kind[begin]]
        mixed = self.mix * np.maximum(seen, 0) * per_count + (1 - self.mix) * spelled
        mixed[ends] = 1.0  # the end is alone in its class
        inside = seen >= 0
        total = first + np.where(inside, np.log10(mixed), 0)
        base = np.where(inside, np.log10(np.maximum(seen, 0) + 1.0) - math.log10(self.all), 0)
        starts = ends - counts
        rest = np.flatnonzero(~inside)
        of_text = np.searchsorted(ends, rest)
        cuts = np.cumsum(np.bincount(of_text, minlength=len(counts)))[:-1]
        lists = [[every[i] for i in part.tolist()] for part in np.split(rest - of_text, cuts)]
        sums = [np.add.reduceat(x, starts).tolist() for x in ((inside & (seen > 0)).astype(np.int64), base, total)]
        return (counts + 1).tolist(), *sums, lists, np.split(per_count[rest], cuts), np.split(spelled[rest], cuts)


def head_of(counts: DataFrame) -> tuple[DataFrame, dict[bytes, int]]:
    """(the rarer words, the at most HEAD most frequent ones), divided at a count read off a histogram of log steps."""
    step = F.floor(F.log2("c") * 8)
    bars = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for s, n in bars:
        total += n
        if total > HEAD:
            break
        least = s
    if least is None:
        return counts, {}
    return counts.filter(step < least), {bytes(r["word"]): r["c"] for r in counts.filter(step >= least).collect()}


def score(docs: DataFrame, path: str, model: Scorer, head: Broadcast, rest: DataFrame) -> DataFrame:
    """``docs`` (id columns and text) scored by ``model``; ``rest`` are the (word, c) that ``head`` does not have."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, n_tokens long, n_head long, base_head double, score_head double, words array<binary>, per_count array<double>, spelled array<double>"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = shared.value, Lexicon(path, head.value)
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        for batch in batches:
            for part in slices(batch, "text"):
                arrays = [pa.array(c, k) for c, k in zip(model.score(part.column("text"), words), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *arrays], ["doc_id", "held_out", "n_tokens", "n_head", "base_head", "score_head", "words", "per_count", "spelled"])

    main = written(docs.select("doc_id", "held_out", "text").mapInArrow(scored, schema)).withColumn("row", F.monotonically_increasing_id())
    kept = written(main)
    each = kept.select("row", F.explode(F.arrays_zip("words", "per_count", "spelled")).alias("x")).select("row", F.col("x.words").alias("word"), "x.per_count", "x.spelled")
    met = each.join(rest, "word", "left")
    c = F.coalesce("c", F.lit(0))
    mixed = F.lit(model.mix) * c * F.col("per_count") + F.lit(1 - model.mix) * F.col("spelled")
    tail = met.groupBy("row").agg(F.count_if(c > 0).alias("n_rest"), F.sum(F.log10(c + 1.0) - F.lit(math.log10(model.all))).alias("base_rest"), F.sum(F.log10(mixed)).alias("score_rest"))
    return kept.drop("words", "per_count", "spelled").join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_rest", F.lit(0))).alias("n_known"),
        (F.col("base_head") + F.coalesce("base_rest", F.lit(0.0))).alias("base_score"), (F.col("score_head") + F.coalesce("score_rest", F.lit(0.0))).alias("score"),
    )


def predict(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"))
    train = held.filter(~F.col("held_out"))
    counts = written(word_counts(train))
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    ends = train.count()
    tokens, kinds = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    classes = Classes(*unit_counts(counts, path), ends, vocabulary(path))
    rest, head = head_of(counts)
    words = sorted(head, key=lambda x: (-head[x], x))  # frequent ones lie side by side in memory
    shared = docs.sparkSession.sparkContext.broadcast((words, np.array([head[x] for x in words], np.int64), *spellings(words, path)))
    model = Scorer(fit(train, classes, path, shared), classes, tokens, kinds, sums["once"], ends, path)
    return score(held, path, model, shared, rest).withColumn("train_tokens", F.lit(tokens).cast("long"))
