"""Spelling variants: pairs of words at one insertion, deletion or replacement, and the frequent form that each word goes back to.

Of two words at one error, with m code points in the shorter, either the first or the last m // 2 are the same. So words are dealt
to shards by that half, once from the front and once from the back. A shard's words make a minimal acyclic automaton (of the words,
or of the words reversed) whose arcs count the words before them, so that a path's sum is the word's number. The half is matched
exactly, the rest is completed with one error, and numbers give the words back. A shard that would be too large is cut again: what
lies between the matched ends has its error in its own first or last half.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, text_bytes, working_tables, written

#: Words of a shard beyond which it is cut, words that one automaton takes in, and words that a task counts before it hands them on.
SHARD, TOGETHER, COUNTED = 20_000, 20_000, 200_000
_RUN = re.compile("[a-zÀ-ÿ]+")  # A-Z are lower case by then


def typed(texts: DataFrame, least: int, noise: int) -> DataFrame:
    """word, n from id, raw (bytes): runs of letters of at least `least` code points. Where `noise` divides crc32 of `<id>:<run>`,
    the run's code point crc32 % length is left out, a typing error by rule; 0 is for none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for at in range(batch.num_rows):
                name = b"" if (i := batch.column(0)[at].as_py()) is None else str(i).encode()
                start = zlib.crc32(name + b":")
                for w, times in Counter(_RUN.findall(batch.column(1)[at].as_py().lower().decode("utf-8", "replace"))).items():
                    if noise and not (h := zlib.crc32(w.encode(), start)) % noise:
                        w = w[: h % len(w)] + w[h % len(w) + 1 :]
                    if len(w) >= least:
                        found[w] += times
                if len(found) > COUNTED:
                    yield from _shown(found)
                    found.clear()
        yield from _shown(found)
        found.clear()
        release()

    return texts.mapInArrow(run, "word string, n bigint")


def _shown(found: Counter[str]) -> Iterator[pa.RecordBatch]:
    words = list(found)
    for at in range(0, len(words), 20_000):
        some = words[at : at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([found[w] for w in some], pa.int64())], names=["word", "n"])


class Automaton:
    """The minimal acyclic automaton of distinct words in ascending order. A state's arcs have their target and how many of its words
    come before: the sum along a path is the word's number."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._counts: list[int] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, []]]
        before = ""
        for w in [*words, ""]:
            same = 0
            while same < min(len(w), len(before)) and w[same] == before[same]:
                same += 1
            while len(path) > same + 1:  # what the next word doesn't share is complete
                state = path.pop()
                path[-1][1].append((before[len(path) - 1], self._state(state, known)))
            path += [[False, []] for _ in w[same:]]
            path[-1][0] = path[-1][0] or bool(w)
            before = w
        self.root = self._state(path[0], known)

    def _state(self, state: list, known: dict[tuple, int]) -> int:
        key = (state[0], tuple(state[1]))
        if key not in known:
            known[key] = len(self.arcs)
            seen, arcs = int(state[0]), {}
            for c, to in state[1]:
                arcs[c] = (to, seen)
                seen += self._counts[to]
            self.arcs.append(arcs)
            self.final.append(state[0])
            self._counts.append(seen)
        return known[key]

    def number(self, state: int, rest: str, so_far: int) -> int:
        """The number of the word that goes on with `rest` from a state, -1 if there is none."""
        arcs = self.arcs
        for c in rest:
            step = arcs[state].get(c)
            if step is None:
                return -1
            state, so_far = step[0], so_far + step[1]
        return so_far if self.final[state] else -1

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of words that come from a word of the automaton by one code point replaced or inserted after the first `exact`."""
        state = so_far = 0
        state, out = self.root, set()
        for i in range(len(word) + 1):
            if i >= exact:
                for c, (to, more) in self.arcs[state].items():
                    out.add(self.number(to, word[i:], so_far + more))
                    if i < len(word) and c != word[i]:
                        out.add(self.number(to, word[i + 1 :], so_far + more))
            if i < len(word):
                state, more = self.arcs[state][word[i]]
                so_far += more
        out.discard(-1)
        return out


def _searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, near, near_n from rows in order of back and shard: each of two words at one error with the other."""
    held: list[tuple[str, int, int, int]] = []
    last = None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
            back, shard, word, n, m, exact = row
            if last is not None and (back != last[0] or (shard != last[1] and len(held) >= TOGETHER)):
                yield from _paired(held, last[0])
                held = []
            last = (back, shard)
            held.append((word[::-1] if back else word, n, m, exact))
    if held:
        yield from _paired(held, last[0])
    release()


def _paired(held: list[tuple[str, int, int, int]], back: bool) -> Iterator[pa.RecordBatch]:
    count = {w: n for w, n, _, _ in held}
    words = sorted(count)
    automaton = Automaton(words)
    out: set[tuple[str, str]] = set()
    for w, _, m, exact in held:
        if len(w) == m:
            for k in automaton.near(w, exact):
                v = words[k]
                out.add((w, v))
                if len(v) > m:
                    out.add((v, w))
    pairs = list(out)
    for at in range(0, len(pairs), 20_000):
        some = pairs[at : at + 20_000]
        turned = [tuple(x[::-1] for x in p) for p in some] if back else some
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in turned]), pa.array([p[1] for p in turned]), pa.array([count[p[1]] for p in some], pa.int64())], names=["word", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: each pair at one error once in each direction, from distinct words with n."""
    size = F.char_length("word")
    # In class m meet words of m code points, which search, and of m + 1.
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where("m > 0").withColumns({"left": F.lit(0), "right": F.lit(0)})
    rows, done = _halved(rows), None
    while True:
        counts = rows.groupBy("shard").agg(F.count("*").alias("c"))
        large = written(counts.where(F.col("c") > SHARD).select("shard"), "large-shards")
        if large.isEmpty():
            break
        # Where nothing is left to halve, a shard has at most three letters of play and stays as it is.
        over = (F.col("m") - F.col("left") - F.col("right")) >= 2
        rest = rows.join(large, "shard", "left_anti").unionByName(rows.join(large, "shard", "left_semi").where(~over))
        done = rest if done is None else done.unionByName(rest)
        rows = written(_halved(rows.join(large, "shard", "left_semi").where(over)), "shards")
    rows = rows if done is None else done.unionByName(rows)
    exact = F.when(F.col("back"), F.col("right")).otherwise(F.col("left"))
    dealt = rows.select("back", "shard", "word", "n", "m", exact.alias("exact")).repartition("back", "shard").sortWithinPartitions("back", "shard")
    return dealt.mapInArrow(_searched, "word string, near string, near_n bigint").repartition("word").dropDuplicates(["word", "near"])


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: with half of what lies between its matched ends matched too, from the front and from the back."""
    half = F.floor((F.col("m") - F.col("left") - F.col("right")) / 2).cast("int")
    ways = F.array(F.struct(F.lit(False).alias("back"), (F.col("left") + half).alias("left"), F.col("right").alias("right")), F.struct(F.lit(True).alias("back"), F.col("left").alias("left"), (F.col("right") + half).alias("right")))
    each = rows.select("word", "n", "m", F.explode(ways).alias("way")).select("word", "n", "m", "way.*")
    ends = F.expr("substring(word, 1, left)"), F.expr("right(word, right)")
    return each.withColumn("shard", F.xxhash64("back", "m", "left", "right", *ends))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, times: int = 2, factor: int = 10, noise: int = 0) -> DataFrame:
    """word, form, root, n, n_near, form_n for every run of letters (A-Z lower-cased, nothing else) of at least `least` code points that
    occurs `times` times. Near words differ by one code point inserted, deleted or replaced; a word's form is the near word of largest n
    (ties: the least), if that is `factor` times its own n; its root is where forms lead.

    Null and empty texts have no words, and texts of any length are whole. Rows that repeat count each; a null key counts as an empty
    one, which matters to `noise` alone (see typed()). Other columns, whatever their names, are ignored. No rows give no rows.
    """
    with working_tables(docs.sparkSession) as keep:
        texts = docs.select(docs[key].alias("id"), text_bytes(docs[text]).alias("raw"))
        counted = typed(texts, least, noise).groupBy("word").agg(F.sum("n").alias("n"))
        words = written(counted.where(F.col("n") >= times), "words")
        best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
        ample = -F.col("best.less") >= factor * F.col("n")
        joined = words.join(best, "word", "left").select("word", F.when(ample, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(ample, -F.col("best.less")).alias("form_n"))
        formed = written(joined, "forms")
        # Forms of forms: n grows by the factor at each, so a few doublings reach the last.
        roots = written(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
        while True:
            on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
            roots = written(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
            if roots.where("moved").isEmpty():
                break
            roots = roots.drop("moved")
        out = formed.join(roots.drop("moved"), "word", "left")
        return keep(written(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants"))
