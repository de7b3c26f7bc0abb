"""Quality rules: rule statistics of whole texts, and an isolation forest over them with a threshold from labelled rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.diagnostics import order_statistics
from .common import blank, map_rows, release, written

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "max_run")
STAT_SCHEMA = ", ".join(f"{c} bigint" for c in STATS)
WINDOW = 8
#: Trees, the number of rows that the share in a node is counted in, and levels that grow before rows are counted.
TREES, PER_TREE, LEVELS = 100, 256, 3
#: No sample is taken any more; callers may still set its size.
SAMPLE = 16_384


def statistics(raw: bytes) -> tuple[int, ...]:
    """The rule statistics of one UTF-8 text, in the order of STATS."""
    words = raw.split()  # splits at space and \\t\\n\\v\\f\\r alone
    n = len(words)
    if not n:
        return (0,) * len(STATS)
    joined = b"".join(words)
    lead = np.frombuffer(joined, np.uint8)
    chars = int(((lead & 0xC0) != 0x80).sum())
    symbols = sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    seen, dup, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeat = 0
    if n >= WINDOW and len(ids) < n:
        # Words occurring once can't be in a repeated window.
        keys = np.zeros(n - WINDOW + 1, np.uint64)
        for j in range(WINDOW):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + mixed(code[j : n - WINDOW + 1 + j].astype(np.uint64))
        once = np.bincount(code) == 1
        bad = np.concatenate([[0], np.cumsum(once[code])])
        at = np.flatnonzero(bad[WINDOW:] == bad[:-WINDOW])
        if len(at) > 1:
            _, inverse, counts = np.unique(keys[at], return_inverse=True, return_counts=True)
            hits = at[counts[inverse] > 1]
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, hits, 1)
            np.add.at(cover, hits + WINDOW, -1) if len(hits) else None
            repeat = int((np.cumsum(cover)[:n] > 0).sum())
    upper = int(((lead >= 65) & (lead <= 90)).sum())
    digits = int(((lead >= 48) & (lead <= 57)).sum())
    return n, chars, symbols, dup, repeat, lines, len(ids), upper, digits, max(map(len, words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def with_statistics(docs: DataFrame, carry: list[Column], text: str = "text") -> DataFrame:
    """carry and one column for each of STATS. Null texts have no words."""
    names = [c.alias(f"c{i}") for i, c in enumerate(carry)]
    slim = docs.select(*names, blank(docs[text]).cast("binary").alias("raw"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name != "raw")

    def make():
        def f(part):
            stats = list(zip(*map(statistics, part["raw"]))) or [[]] * len(STATS)
            return part | dict(zip(STATS, map(list, stats)))

        return f

    return map_rows(slim, make, f"{schema}, {STAT_SCHEMA}")


N_FEATURES = 6


def features(x: np.ndarray) -> np.ndarray:
    """Ratios that don't grow with the length of a text, from STATS by column."""
    s = dict(zip(STATS, x.astype(np.float64).T))
    n, c, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    return np.stack([
        s["word_chars"] / n, np.minimum(s["n_symbols"] / c, 0.2), s["n_dup_lines"] / lines, s["n_repeat_words"] / n,
        np.minimum(s["n_upper"] / c, 0.5), np.minimum(s["n_digits"] / c, 0.2),
    ], axis=1)


def feature_box(stats: DataFrame) -> np.ndarray:
    """Least and greatest value of each feature over all rows, or no rows for none: one aggregation."""
    ends = [f"{end}{i}" for end in ("least", "most") for i in range(N_FEATURES)]

    def make():
        def f(part):
            x = features(np.array([part[c] for c in STATS], np.float64).T.reshape(-1, len(STATS)))
            return dict(zip(ends, [[float(v)] for v in np.concatenate([x.min(0), x.max(0)])]))

        return f

    each = map_rows(stats.select(*STATS), make, ", ".join(f"{e} double" for e in ends), rows=4096)
    found = each.agg(*[F.min(e) if e.startswith("least") else F.max(e) for e in ends]).first()
    return np.array(found, np.float64).reshape(2, -1) if found[0] is not None else np.zeros((0, N_FEATURES))


class IsolationForest:
    """Random axis-parallel splits of small subsamples, as arrays; score 2^(-mean path / expected path), near 1 for anomalies.

    Cuts are drawn over a node's box, which begins as the box of all rows and not of the normal ones: so a value that no
    normal row has leads to an empty branch, and a short path, even where all normal rows agree."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], expected: float):
        self.trees, self.expected = trees, expected

    @staticmethod
    def average_path(n: np.ndarray | float) -> np.ndarray:
        n = np.asarray(n, np.float64)
        big = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1)
        return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))

    @classmethod
    def grow(cls, x: np.ndarray, box: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = 17) -> "IsolationForest":
        """From rows at hand."""
        return cls.grown(lambda forest: forest.reached(x), len(x), np.concatenate([x, box]) if len(x) else box, trees, per_tree, seed)

    @classmethod
    def grown(cls, count: Callable[["IsolationForest"], list[np.ndarray]], total: int, box: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = 17) -> "IsolationForest":
        """A forest whose nodes hold all `total` normal rows: count tells how many reach each node where a tree ends. As cuts come from
        boxes alone, every tree grows LEVELS at a time before its rows are counted; nodes of under 2 rows in per_tree end there."""
        size = min(per_tree, total)
        expected = float(cls.average_path(size))
        if not size or not len(box):
            return cls([], expected)
        limit = max(1, math.ceil(math.log2(max(size, 2)))) + 8
        grown = [_Tree(box.min(0), box.max(0), np.random.default_rng([seed, t])) for t in range(trees)]
        while any(t.live for t in grown):
            for t in grown:
                t.extend(limit)
            for t, held in zip(grown, count(cls([t.arrays() for t in grown], expected))):
                t.settle(held * (size / total), limit)
        return cls([t.arrays() for t in grown], expected)

    def ends(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree, the node where each row ends."""
        rows = np.arange(len(x))
        for feature, cut, child, _ in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                j = feature[at]
                inner = j >= 0
                if not inner.any():
                    break
                right = (x[rows, np.maximum(j, 0)] > cut[at]).astype(np.int64)
                at = np.where(inner, child[at, right], at)
            yield at

    def reached(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(at, minlength=len(t[0])) for at, t in zip(self.ends(x), self.trees)]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees or not len(x) or self.expected <= 0:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for at, (_, _, _, depth) in zip(self.ends(x), self.trees):
            total += depth[at]
        return 2.0 ** (-total / len(self.trees) / self.expected)


class _Tree:
    """A tree while it grows: nodes in order of making, children after parents, and the live ones, which may be split further."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, rng: np.random.Generator):
        self.rng, self.live = rng, [0]
        self.feature, self.cut, self.child, self.level, self.depth, self.box = [-1], [0.0], [[0, 0]], [0], [0.0], [(lo, hi)]

    def extend(self, limit: int) -> None:
        for _ in range(LEVELS):
            made = []
            for node in self.live:
                lo, hi = self.box[node]
                wide = np.flatnonzero(hi > lo)
                if self.level[node] >= limit or not len(wide):
                    continue
                j = int(wide[self.rng.integers(len(wide))])
                at = lo[j] + self.rng.random() * (hi[j] - lo[j])
                upto, above = hi.copy(), lo.copy()
                upto[j], above[j] = at, at
                self.feature[node], self.cut[node], self.child[node] = j, at, [len(self.feature), len(self.feature) + 1]
                for side in ((lo, upto), (above, hi)):
                    made.append(len(self.feature))
                    self.feature.append(-1), self.cut.append(0.0), self.child.append([made[-1]] * 2), self.level.append(self.level[node] + 1), self.depth.append(0.0), self.box.append(side)
            self.live = made

    def settle(self, mass: np.ndarray, limit: int) -> None:
        """mass: rows in per_tree that end in each node. Nodes of under 2 end the tree, and what is below them is dropped."""
        mass, tip = mass.astype(np.float64), set(self.live)
        for node in range(len(self.feature) - 1, -1, -1):
            if self.feature[node] >= 0:
                mass[node] = mass[self.child[node]].sum()
        kept, new = [0], {}
        for node in kept:
            if mass[node] < 2:
                self.feature[node] = -1
            if self.feature[node] >= 0:
                kept += self.child[node]
        new = {node: i for i, node in enumerate(kept)}
        self.live = [new[n] for n in kept if n in tip and mass[n] >= 2 and self.level[n] < limit and (self.box[n][1] > self.box[n][0]).any()]
        self.child = [[new[c] for c in self.child[n]] if self.feature[n] >= 0 else [new[n]] * 2 for n in kept]
        self.depth = [self.level[n] + float(IsolationForest.average_path(mass[n])) for n in kept]
        for name in ("feature", "cut", "level", "box"):
            setattr(self, name, [getattr(self, name)[n] for n in kept])

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.cut), np.array(self.child), np.array(self.depth)


def _matrix(part: dict[str, list]) -> np.ndarray:
    return features(np.array([part[c] for c in STATS], np.float64).T.reshape(-1, len(STATS)))


def grow_over(normal: DataFrame, box: np.ndarray) -> IsolationForest:
    """The forest of all rows of normal, by a job for every LEVELS levels that counts them at the nodes."""

    def count(forest: IsolationForest) -> list[np.ndarray]:
        first = np.concatenate([[0], np.cumsum([len(t[0]) for t in forest.trees])])

        def run(batches):
            held = np.zeros(first[-1], np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    held += np.concatenate(forest.reached(_matrix({n: part.column(i).to_numpy() for i, n in enumerate(part.schema.names)})))
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["node", "n"])
            release()

        got = normal.select(*STATS).mapInArrow(run, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n")).toPandas()
        held = np.zeros(first[-1], np.int64)
        held[got["node"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
        return np.split(held, first[1:-1])

    return IsolationForest.grown(count, normal.count(), box)


def calibrate(scores: np.ndarray, good: np.ndarray, keep: float = 0.985, price: float = 10.0) -> float:
    """The threshold above which a document is dropped: of those that keep a share `keep` of the good rows, the one with the
    greatest share of bad rows dropped less `price` times the share of good rows dropped. Without good or bad rows, infinite."""
    fine, bad = np.sort(scores[good == 1]), np.sort(scores[good == 0])
    if not len(fine) or not len(bad):
        return math.inf
    at = np.unique(fine)
    lost, caught = 1 - np.searchsorted(fine, at, "right") / len(fine), 1 - np.searchsorted(bad, at, "right") / len(bad)
    return float(at[np.argmax(np.where(lost <= 1 - keep, caught - price * lost, -math.inf))])


def calibrate_over(scored: DataFrame, keep: float = 0.985, price: float = 10.0) -> float:
    """calibrate() over rows (score, good) in Spark. Only the good scores that a threshold may be, a share 1 - keep of the good rows at
    the top, come to the driver; the bad ones are counted between them."""
    n = {r["good"]: r["n"] for r in scored.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return math.inf
    fine, bad = scored.where("good = 1"), scored.where("good = 0")
    least = order_statistics(fine, F.col("score"), lambda k: [max(0, math.floor(keep * k) - 2)])[0]
    top = fine.where(F.col("score") >= F.lit(least)).groupBy("score").agg(F.count("*").alias("n")).toPandas().sort_values("score")
    at, below = top["score"].to_numpy(), n[1] - top["n"].sum()
    upto = below + top["n"].to_numpy().cumsum()

    def make():
        return lambda part: {"slot": np.searchsorted(at, np.array(part["score"], np.float64), "left").tolist()}

    slots = map_rows(bad.select("score"), make, "slot bigint", rows=4096).groupBy("slot").agg(F.count("*").alias("n")).collect()
    held = np.zeros(len(at) + 1, np.int64)
    for r in slots:
        held[r["slot"]] = r["n"]
    lost, caught = 1 - upto / n[1], 1 - np.cumsum(held)[:-1] / n[0]  # a slot holds what is at most its score
    return float(at[np.argmax(np.where(lost <= 1 - keep, caught - price * lost, -math.inf))])


def judge_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", keep: float = 0.985) -> DataFrame:
    """key, STATS, base_failed, anomaly (0 to 1) and kept, a row for each row of docs.

    A document fails the base rules with under 20 words or over 30% of its words in repeated 8-word windows. Of the rest, the
    forest's verdict drops those more anomalous than its threshold. The forest holds every good one (with 2 * PER_TREE or more, those
    of even hash) of the labelled rows that pass the base rules, or with under PER_TREE of those all passing rows, whatever their labels.
    Its cuts are drawn over the box of all passing rows; the threshold comes from all other labelled rows. Null and empty
    texts have no words and fail. Without labels nothing but the base rules drops. Repeated keys are judged row by row; of
    several labels of a key the least counts. No rows give no rows.
    """
    stats = with_statistics(docs, [docs[key]], text).withColumnRenamed("c0", "key")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = written(stats.withColumn("base_failed", failed), "quality")
    passing = stats.where(~F.col("base_failed"))
    least = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(label).cast("int").alias("good"))
    half = (F.pmod(F.xxhash64("key", *STATS), F.lit(2)) == 0) & (F.col("good") == 1)
    marked = written(passing.join(least, "key").select("good", half.alias("half"), *STATS), "labelled")
    # Rows that labels call good describe what is normal; without enough of them, all do.
    # The forest holds half of them, and the threshold comes from the rest, on which scores aren't too low; few serve for both.
    good = marked.where("good = 1").count()
    several = good >= 2 * PER_TREE
    normal = passing if good < PER_TREE else marked.where("half") if several else marked.where("good = 1")
    forest = grow_over(normal, feature_box(passing))

    def scores():
        return lambda part: {"score": forest.score(_matrix(part)).tolist(), "good": part["good"]}

    told = marked.where("not half") if several else marked
    threshold = calibrate_over(written(map_rows(told.select("good", *STATS), scores, "score double, good int", rows=4096), "scores"), keep)

    def make():
        def f(part):
            score = forest.score(_matrix(part))
            return part | {"anomaly": score.tolist(), "kept": [not b and s <= threshold for b, s in zip(part["base_failed"], score)]}

        return f

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema)
    return map_rows(stats, make, f"{schema}, anomaly double, kept boolean", rows=4096).withColumnRenamed("key", key)


