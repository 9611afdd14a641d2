"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language gives, at every place of a text, how far it can be read as a
substring of that language's sample; the whole text is cut greedily into such longest matches, and the language that
needs the fewest phrases, each weighed by the bits that name a place in its sample, wins. An automaton is a flat
transition table with the phrase count of each step in its low bits. Segments of long texts are read side by side from
a phrase's beginning; then each is read again from the state that the one before ended in, until both readings agree,
which gives exactly the parse of the whole text.

Defined results: a null text and a text without a letter are ``und`` with score 0, as is every text if there is no
labelled text; equal bits go to the first language by name; rows are judged one by one, repeated or not, and other
columns, whatever their names, pass through ``keep_identified`` unchanged; empty tables give empty results. The samples
are the one bounded part: at most SAMPLE characters a language, from the documents with the smallest hashes in each of
BUCKETS buckets; a slice of such a text begins wherever its hash says.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.bpe import portions
from loomery.llm.common import by_slices, held, remainder

SAMPLE, BUCKETS, SLICE = 16_384, 64, 2048
SYMBOLS, SEGMENT = 96, 256
#: Bits of evidence that halve a rival's share of the score.
TEMPERATURE = 4.0
LETTER = regex.compile(r"\p{L}")


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings of ``text``; state 0 is the empty one."""
    moves, link, length, last = [{}], [-1], [0], 0
    for symbol in text:
        new, p = len(moves), last
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and symbol not in moves[p]:
            moves[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = moves[p][symbol]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[new] = twin
                while p >= 0 and moves[p].get(symbol) == q:
                    moves[p][symbol] = twin
                    p = link[p]
        last = new
    return moves


class Model:
    """Automata of all languages in one table; ``samples`` are (language, text)."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.languages = [x for x, _ in samples]
        common = [x for x, _ in Counter("".join(t for _, t in samples)).most_common(SYMBOLS - 2)]
        #: Symbol 0 is any other character, the last one the filling of short segments.
        self.symbol = np.zeros(0x110000, np.uint8)
        for i, letter in enumerate(common):
            self.symbol[ord(letter)] = i + 1
        parts, self.roots, base = [], [], 0
        for _, text in samples:
            moves = suffix_automaton(self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist())
            for x in moves:
                x.pop(0, None)
            root = np.zeros(SYMBOLS, np.int64)
            for symbol, to in moves[0].items():
                root[symbol] = to
            # Where no move exists a phrase ends; the symbol begins the next, or is a phrase by itself.
            table = np.tile((base + root * SYMBOLS) << 2 | np.where(root > 0, 1, 2), (len(moves), 1))
            table[0] = (base + root * SYMBOLS) << 2 | (root == 0)
            for state, out in enumerate(moves):
                for symbol, to in out.items():
                    table[state, symbol] = (base + to * SYMBOLS) << 2
            table[:, -1] = (base + np.arange(len(moves)) * SYMBOLS) << 2
            parts.append(table.ravel())
            self.roots.append(base)
            base += table.size
        wide = np.int32 if base < 1 << 29 else np.int64  # places are shifted by two bits
        self.table = np.concatenate([x.astype(wide) for x in parts]) if parts else np.zeros(0, wide)
        self.place_bits = np.array([math.log2(max(2, len(t))) for _, t in samples])

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text in each language."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = self.symbol[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        each = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), each)
        begin = np.repeat(np.cumsum(sizes) - sizes, each) + SEGMENT * (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each))
        stop = np.minimum(begin + SEGMENT, np.repeat(np.cumsum(sizes), each))
        steps = np.full((len(owner), SEGMENT), SYMBOLS - 1, np.uint8)
        steps[np.arange(SEGMENT) < (stop - begin)[:, None]] = codes
        roots = np.array(self.roots, self.table.dtype)[:, None]
        at = np.repeat(roots, len(owner), 1)
        count = np.zeros(at.shape, np.int32)
        read = np.empty((SEGMENT, *at.shape), self.table.dtype)
        for found, column in zip(read, np.ascontiguousarray(steps.T), strict=True):
            np.take(self.table, at + column, out=found)
            count += found & 3
            at = found >> 2
        goes_on = np.append(owner[1:] == owner[:-1], False)
        self._carry(steps, read, at, count, goes_on, roots)
        count += (at != roots) & ~goes_on
        return np.array([np.bincount(owner, x, len(texts)) for x in count]).T

    def _carry(self, steps: np.ndarray, read: np.ndarray, end: np.ndarray, count: np.ndarray, goes_on: np.ndarray, roots: np.ndarray) -> None:
        """Corrects the phrase counts and end states of segments that go on from the one before, inside a phrase."""
        fresh = count.copy()
        lang, lane = np.nonzero((end != roots) & goes_on)
        lane = lane + 1
        while len(lane):
            state, change, place = end[lang, lane - 1], np.zeros(len(lane), np.int32), np.arange(len(lane))
            open_lang, open_lane = lang, lane
            for t in range(SEGMENT):
                found, first = self.table[state + steps[open_lane, t]], read[t, open_lang, open_lane]
                change[place] += ((found & 3) - (first & 3)).astype(np.int32)
                apart = found >> 2 != first >> 2
                state, place, open_lang, open_lane = (found >> 2)[apart], place[apart], open_lang[apart], open_lane[apart]
                if not len(place):
                    break
            count[lang, lane] = fresh[lang, lane] + change
            ended = read[-1, lang, lane] >> 2
            ended[place] = state
            # Only where a segment now ends in another state must the next one be read again.
            again = (ended != end[lang, lane]) & goes_on[lane]
            end[lang, lane] = ended
            lang, lane = lang[again], lane[again] + 1

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(language, score) of each text."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        done = 0
        for part in portions([texts[i].lower() for i in known]):
            bits = self.phrases(part) * self.place_bits
            best = bits.argmin(1)
            share = 1 / np.exp2((bits.min(1, keepdims=True) - bits) / TEMPERATURE).sum(1)
            for i, k, s in zip(known[done:], best.tolist(), share.tolist(), strict=False):
                names[i], scores[i] = self.languages[k], s
            done += len(part)
        return names, scores


def model(samples: tuple[tuple[str, str], ...]) -> Model:
    """The model of these samples, built once in each Python worker."""
    return held("langid", samples, lambda: Model(samples))


def learn(labelled: DataFrame) -> tuple[tuple[str, str], ...]:
    """(language, sample) from the rows of ``labelled`` (doc_id, text, lang) with text and language."""
    h = F.xxhash64(F.col("doc_id").cast("string"))
    begin = F.pmod(h, F.greatest(F.length("text") - SLICE, F.lit(0)) + 1) + 1
    rows = labelled.filter(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", h.alias("h"), F.substring("text", begin.cast("int"), F.lit(SLICE)).alias("t"))
    least = rows.groupBy("lang", F.pmod("h", F.lit(BUCKETS)).alias("b")).agg(F.min("h").alias("h")).select("lang", "h")
    found = defaultdict(set)
    # BUCKETS rows a language bound what is broadcast and what reaches the driver.
    for row in rows.join(F.broadcast(least), ["lang", "h"]).dropDuplicates(["lang", "h", "t"]).collect():
        found[row["lang"]].add((row["h"], row["t"]))
    samples = []
    for lang in sorted(found):
        texts = [t for _, t in sorted(found[lang])]
        each = max(256, -(-SAMPLE // len(texts)))
        samples.append((lang, "\n".join(t[:each] for t in texts)[:SAMPLE].lower()))
    return tuple(samples)


def identify(text: Column, samples: tuple[tuple[str, str], ...]) -> Column:
    """struct<lang, score> of each text."""

    @F.arrow_udf("lang string, score double")
    def predicted(texts: pa.Array) -> pa.Array:
        found = model(samples)

        def judged(part: list[str | None]) -> pa.Array:
            names, scores = found.predict(part)
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

        return by_slices(texts, judged)

    return predicted.asNondeterministic()(text)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those not held out."""
    rows = docs.select("doc_id", "text", "lang", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    samples = learn(rows.filter(~F.col("held_out")))
    found = rows.select("doc_id", "held_out", identify(F.col("text"), samples).alias("x"))
    return found.select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, whose language can be told; ``und`` goes."""
    samples = learn(docs.filter(remainder(F.col("doc_id"), 4) != 2))
    return docs.withColumn("__loomery_lang", identify(F.col("text"), samples)).filter(F.col("__loomery_lang.lang") != "und").drop("__loomery_lang")
