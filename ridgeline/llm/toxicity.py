"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, map_rows, remove, small_batches, written

#: Fixed folds: letters that look like Latin ones, and digits and signs that stand for letters. l, 1 and | all fold to i.
LOOKALIKES = {
    "аàáâãäåāăąαɑ@4": "a", "ьβв8": "b", "сçćčϲ¢": "c", "ԁďđ": "d", "еèéêëēėęěєε3€": "e", "ɡģğ9": "g", "һĥ": "h",
    "іìíîïīįıιl1|ł": "i", "јĵ": "j", "κкķ": "k", "мμ": "m", "пñńňη": "n", "оòóôõöøōοσ0": "o", "рρ": "p", "ԛ": "q", "гŕř": "r",
    "ѕśŝšşș5$": "s", "тťțτ7+": "t", "υùúûüūůų": "u", "ѵν": "v", "ѡω": "w", "хχ×": "x", "уýÿγ": "y", "žźżᴢ2": "z",
}
FOLD = {ord(c): ord(to) for cs, to in LOOKALIKES.items() for c in cs} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
FOLD |= {0xFF01 + i: chr(0x21 + i).lower().translate(FOLD) for i in range(94)}

#: The lexicon is learned from this many labelled rows at most, those of least hash.
LABELLED = 60_000
#: A folded word enters the lexicon if it occurs in LEAST toxic rows and its log odds reach WEIGHT; MOST words at most.
LEAST, WEIGHT, MOST = 4, 2.5, 20_000
#: Labelled rows whose words a worker holds at once: each gives some hundreds.
TOGETHER = 64


def folded(text: str) -> str:
    low = text.lower()
    return low.translate(FOLD) if low.isascii() else _text(_folded_codes(low))


def tokens(text: str) -> list[str]:
    """Words of a folded text: maximal runs of letters, digits and marks."""
    if text.isascii():
        return folded(text).translate(_ASCII_GAPS).split()
    x = _folded_codes(text.lower())
    return _text(np.where(_tables()[1][x], x, np.uint32(32))).split()


_ASCII_GAPS = {c: " " for c in range(128) if not chr(c).isalnum()}


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: what it folds to, itself if nothing, 0x110000 if it goes; and whether it is a letter, digit or mark."""
    to = np.arange(0x110000, dtype=np.uint32)
    for c, x in FOLD.items():
        to[c] = 0x110000 if x is None else ord(x) if isinstance(x, str) else x
    return to, np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def _folded_codes(low: str) -> np.ndarray:
    x = _tables()[0][np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")]
    return x[x < 0x110000]


def _text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


#: Beside whole words, the lexicon has beginnings of these lengths, marked by a star, for families of one stem.
STEMS = (4, 5, 6, 7)


def terms(words: list[str]) -> set[str]:
    return {w for w in words if len(w) > 2} | {f"{w[:k]}*" for w in set(words) for k in STEMS if len(w) > k}


@dataclass
class Lexicon:
    """weights: folded word, or beginning of one with a star, to log odds. exceptions: folded phrases of two words in which a word doesn't count.
    at, slope, bias: the logistic curve over the length-normalised sum."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    slope: tuple[float, float] = (0.0, 0.0)
    bias: float = -4.0

    def matcher(self):
        """A function text -> (score, matches)."""
        machine, stems = ahocorasick.Automaton(), {}
        for w, x in self.weights.items():
            machine.add_word(w, (len(w), x, False)) if not w.endswith("*") else stems.update({w[:-1]: x})
        for w in self.exceptions:
            machine.add_word(w, (len(w), 0.0, True))
        for w, x in stems.items():  # a stem that is also a word weighs what the heavier of both does
            machine.add_word(w, (len(w), max(x, self.weights.get(w, 0.0)), None))
        ready = bool(self.weights)
        if ready:
            machine.make_automaton()

        def match(text: str) -> tuple[float, int]:
            total, hits, spared, found = 0.0, 0, [], []
            if ready and text:
                low = folded(text)
                n = len(low)
                for end, (size, weight, exception) in machine.iter(low):
                    start = end - size + 1
                    if (start and low[start - 1].isalnum()) or (exception is not None and end + 1 < n and low[end + 1].isalnum()):
                        continue
                    if exception:
                        spared.append((start, end))
                    else:
                        found.append((start, end, weight))
                heaviest: dict[int, float] = {}  # a word and its stems count once
                for start, end, weight in found:
                    if not any(s <= start and end <= e for s, e in spared):
                        heaviest[start] = max(weight, heaviest.get(start, 0.0))
                total, hits = sum(heaviest.values()), len(heaviest)
            return total, hits

        def score(text: str) -> tuple[float, int]:
            total, hits = match(text)
            x = self.inputs(total, len(text))
            z = self.bias + self.slope[0] * x[0] + self.slope[1] * x[1]
            return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z)))), hits

        score.match = match
        return score

    @staticmethod
    def inputs(total: float, length: int) -> tuple[float, float]:
        """The sum, damped, and the sum to the thousand characters, so that length alone doesn't decide."""
        return math.log1p(total), math.log1p(1000.0 * total / max(length, 200))


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        hess = x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, x.T @ (weight * (y - p)) - ridge * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    """Learns from labelled rows that aren't held out, LABELLED at most; of a key's several labels the largest counts."""
    told = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    told = told.where(~held_out(F.col("key"))).orderBy(F.xxhash64("key"), "key").limit(LABELLED)
    # Keys and labels only, LABELLED at most, are broadcast; the texts stay on the executors, and are picked out once.
    rows = written(docs.select(docs[key].alias("key"), blank(docs[text]).alias("text")).join(F.broadcast(told), "key").select("y", "text"), "labelled")
    with small_batches(rows.sparkSession):
        lexicon = learn(rows)
    remove(rows)
    return lexicon


def learn(rows: DataFrame) -> Lexicon:
    """A lexicon from rows of y and text, which are gone through for words, phrases and the curve. Without toxic or without clean
    rows, empty tables among them, or without telling words, nothing is toxic. Repeated rows count as often as they come."""

    def count():
        def f(part):
            return {"y": [int(y > 0) for y in part["y"]], "words": [sorted(terms(tokens(t))) for t in part["text"]]}

        return f

    n = {r["y"]: r["n"] for r in rows.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Lexicon()
    words = map_rows(rows.select("y", "text"), count, "y int, words array<string>", rows=TOGETHER).select("y", F.explode("words").alias("w"))
    per = words.groupBy("w").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    odds = F.log((F.col("toxic") + 0.1) / (n[1] + 0.2)) - F.log((F.col("clean") + 0.1) / (n[0] + 0.2))
    best = per.where((F.col("toxic") >= LEAST) & (odds >= WEIGHT)).select("w", odds.alias("x")).orderBy(F.desc("x"), "w").limit(MOST).collect()
    weights = {r["w"]: r["x"] for r in best}
    if not weights:
        return Lexicon()
    def listed(w):
        return w in weights or any(f"{w[:k]}*" in weights for k in STEMS)

    def phrase():
        match = Lexicon(weights).matcher().match

        def f(part):
            out = []
            for t in part["text"]:
                words = tokens(t) if match(t)[1] else []  # nearly all rows hold nothing of the lexicon
                out.append(sorted({f"{a} {b}" for a, b in zip(words, words[1:]) if listed(a) or listed(b)}))
            return {"y": [int(y > 0) for y in part["y"]], "words": out}

        return f

    said = map_rows(rows.select("y", "text"), phrase, "y int, words array<string>", rows=TOGETHER).select("y", F.explode("words").alias("w"))
    per = said.groupBy("w").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    spared = per.where((F.col("clean") >= LEAST) & (F.col("toxic") * n[0] < F.col("clean") * n[1])).orderBy(F.desc("clean"), "w").limit(MOST).collect()
    out = Lexicon(weights, frozenset(r["w"] for r in spared))

    def inputs():
        match = out.matcher().match

        def f(part):
            x = [Lexicon.inputs(match(t)[0], len(t)) for t in part["text"]]
            return {"y": [float(y > 0) for y in part["y"]], "a": [v[0] for v in x], "b": [v[1] for v in x]}

        return f

    # Most rows match nothing and are equal: one row with a count for each kind.
    got = map_rows(rows.select("y", "text"), inputs, "y double, a double, b double").groupBy("y", "a", "b").count().toPandas().sort_values(["y", "a", "b"])
    beta = logistic(np.column_stack([np.ones(len(got)), got["a"], got["b"]]), got["y"].to_numpy(), got["count"].to_numpy(np.float64))
    out.bias, out.slope = float(beta[0]), (float(beta[1]), float(beta[2]))
    return out


def score_toxicity(docs: DataFrame, lexicon: Lexicon, carry: list[Column], text: str = "text") -> DataFrame:
    """carry, score (0 to 1) and hits, a row for each row of docs. Nothing but the text enters the score; null texts are
    empty and get the curve's value at no match; repeated rows get equal scores; no rows give no rows."""
    slim = docs.select(*carry, blank(docs[text]).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "__text")

    def make():
        score = lexicon.matcher()

        def f(part):
            got = [score(t) for t in part["__text"]]
            return part | {"score": [x[0] for x in got], "hits": [x[1] for x in got]}

        return f

    carried = [c for c in slim.columns if c != "__text"]
    return map_rows(slim, make, f"{schema}, score double, hits int", carry=carried)

