"""SimHash fingerprints, and links within a few bits by anchor-point covering.

Anchors are the words of a covering code: every fingerprint lies within the code's radius of one, its home. Fingerprints within t
bits of each other then both lie within radius + t of the home of either, so each is dealt to every anchor that near and compared
there with those at home. The code is a direct sum over blocks of the 64 bits: perfect Golay codes of 23 bits and radius 3, and
repetition codes of an odd number of bits. As distances add up over the blocks, radius + t is kept block by block, which leaves out
anchors that the sum alone would let in: a block may lie e further off than its own radius, and the e add up to t at most.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, fresh, map_rows, release, text_bytes, working_tables, written
from .jaccard import components

#: Bits of the code's blocks, from the lowest: 2 ** 13 anchors, and 2 ** 26 for more fingerprints than FINE_FROM, so that regions stay small.
COARSE, FINE, FINE_FROM = (23, 41), (23, 23, 17, 1), 8_000_000
#: Fingerprints at home, and others, that one comparison of a region holds; a region of more is cut into blocks of these sizes.
HOMES, GUESTS = 1 << 14, 1 << 19
#: Generator of the Golay code of 23 bits, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
_GOLAY, _RADIUS = 0xAE3, 3
_STEP = 1 << 16


def fingerprint(text: bytes, size: int = 3) -> int:
    """64 bits: a bit is 1 if it is set in over half the XXH64 (seed 42) of the text's shingles of `size` words, repeats included, A-Z
    lower-cased, joined by spaces. Fewer words are one shingle; none give zero."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(size, len(words))
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(begins), _STEP):
        h = np.array([digest(line[b:e], 42) for b, e in zip(begins[at : at + _STEP], stops[at : at + _STEP])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(begins), bitorder="little").view(np.uint64)[0])


def _syndrome(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint32)
    for bit in range(22, 10, -1):
        x = np.where(x >> np.uint32(bit) & np.uint32(1), x ^ np.uint32(_GOLAY << (bit - 11)), x)
    return x


@lru_cache(maxsize=None)
def _patterns(t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of 23 bits of weight up to radius + t in order of syndrome, their weight beyond the radius, and where each syndrome begins."""
    words, over = [np.zeros(1, np.uint32)], [np.zeros(1, np.int8)]
    for weight in range(1, _RADIUS + t + 1):
        at = np.array(list(combinations(range(23), weight)), np.uint32)
        words.append((np.uint32(1) << at).sum(axis=1, dtype=np.uint32))
        over.append(np.full(len(at), max(0, weight - _RADIUS), np.int8))
    word, excess = np.concatenate(words), np.concatenate(over)
    s = _syndrome(word)
    order = np.argsort(s, kind="stable")
    return word[order], excess[order], np.searchsorted(s[order], np.arange(2049))


def anchors(x: np.ndarray, blocks: tuple[int, ...], t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, anchor, excess: for each fingerprint the anchors that may be home to another within t bits; excess 0 is its own home."""
    owner, anchor, spent, low = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int8), 0
    for bits in blocks:
        part = (x >> np.uint64(low)) & np.uint64((1 << bits) - 1)
        low += bits
        if bits == 23:
            word, excess, first = _patterns(t)
            s = _syndrome(part).astype(np.int64)[owner]
            many = first[s + 1] - first[s]
            back = np.repeat(np.arange(len(owner)), many)
            at = np.arange(len(back)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[s], many)
            owner, anchor, spent = owner[back], anchor[back], spent[back] + excess[at]
            code = (part[owner].astype(np.uint32) ^ word[at]) >> np.uint32(11)  # the upper 12 bits name the code word
            anchor = anchor << 12 | code.astype(np.int64)
        else:
            ones = np.bitwise_count(part).astype(np.int64)[owner]
            far = np.concatenate([ones, bits - ones]) - bits // 2
            owner, anchor = np.concatenate([owner, owner]), np.concatenate([anchor << 1, anchor << 1 | 1])
            spent = np.concatenate([spent, spent]) + np.maximum(far, 0)
        keep = spent <= t
        owner, anchor, spent = owner[keep], anchor[keep], spent[keep]
    return owner, anchor, spent


def _dealt(blocks: tuple[int, ...], t: int):
    """anchor, guest (0 at home, 1 to be compared with those at home), fp. Of two homes, the lesser one compares."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), 4096):
                x = every[at : at + 4096]
                owner, anchor, excess = anchors(x, blocks, t)
                home = np.zeros(len(x), np.int64)
                home[owner[excess == 0]] = anchor[excess == 0]
                met = anchor <= home[owner]
                owner, anchor = owner[met], anchor[met]
                columns = (np.concatenate([home, anchor]), np.repeat(np.array([0, 1], np.int32), [len(x), len(owner)]), np.concatenate([x, x[owner]]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "guest", "fp"])
        release()

    return run


def links(prints: DataFrame, t: int = 3, blocks: tuple[int, ...] | None = None) -> DataFrame:
    """a, b: of distinct fingerprints (fp long), links within t bits enough to connect what is connected."""
    blocks = blocks or (COARSE if prints.count() <= FINE_FROM else FINE)
    if sum(blocks) != 64 or any(b != 23 and b % 2 == 0 for b in blocks):
        raise ValueError("blocks are of 23 or an odd number of bits and add up to 64")
    rows = prints.select("fp").mapInArrow(_dealt(blocks, t), "anchor bigint, guest int, fp bigint")
    # Large regions are cut in both directions: every part at home meets every part of the guests, each pair in one block.
    sizes = rows.groupBy("anchor").agg(F.sum(1 - F.col("guest")).alias("homes"), F.sum("guest").alias("guests")).where("homes > 0")
    parts = sizes.select("anchor", F.ceil(F.col("homes") / HOMES).cast("int").alias("rows"), F.ceil(F.col("guests") / GUESTS).cast("int").alias("cols"))
    large = written(parts.where("rows > 1 or cols > 1"), "large-anchors")
    if large.isEmpty():
        rows = rows.withColumns({"row": F.lit(0), "col": F.lit(0)})
    else:
        rows = rows.join(large, "anchor", "left").withColumns({c: F.greatest(F.lit(1), F.coalesce(c, F.lit(1))) for c in ("rows", "cols")})
        own = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
        each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        rows = rows.withColumn("row", F.explode(F.when(F.col("guest") == 0, F.array(own("rows"))).otherwise(each("rows"))))
        rows = rows.withColumn("col", F.explode(F.when(F.col("guest") == 1, F.array(own("cols"))).otherwise(each("cols"))))
    rows = rows.select("anchor", "row", "col", "guest", "fp").repartition("anchor", "row", "col").sortWithinPartitions("anchor", "row", "col", "guest")
    return rows.mapInArrow(_compared(t), "a bigint, b bigint")


def _compared(t: int):
    schema = arrow_schema("a bigint, b bigint")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        now, homes, block = None, [], None
        for batch in batches:
            key = [batch.column(i).to_numpy() for i in range(4)]
            fp = batch.column(4).to_numpy().view(np.uint64)
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(fp)]):
                here = tuple(k[lo].item() for k in key[:3])
                if here != now:
                    now, homes, block = here, [], None
                if not key[3][lo]:
                    homes.append(fp[lo:hi])
                elif homes:  # else nobody is at home
                    block = block or _Block(np.sort(np.concatenate(homes)), t)
                    found = block.meet(fp[lo:hi])
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*found)], schema=schema)
        release()

    return run


class _Block:
    """Fingerprints at home, by class as far as the links seen connect them, so that a cluster gives a link for each member and not each pair."""

    def __init__(self, homes: np.ndarray, t: int):
        self.homes, self.t, self.label = homes, t, np.arange(len(homes))

    def meet(self, guests: np.ndarray) -> list[tuple[int, int]]:
        out, step = [], max(1, (1 << 21) // len(self.homes))
        at = np.minimum(np.searchsorted(self.homes, guests), len(self.homes) - 1)
        itself = np.where(self.homes[at] == guests, at, -1)
        for lo in range(0, len(guests), step):
            near = np.bitwise_count(guests[lo : lo + step, None] ^ self.homes[None, :]) <= self.t
            for i in np.flatnonzero(near.sum(axis=1) > (itself[lo : lo + step] >= 0)).tolist():
                those = np.flatnonzero(near[i])
                kinds = self.label[those]
                me = int(itself[lo + i])
                if kinds.min() == kinds.max():
                    if me < 0:
                        out.append((int(guests[lo + i]), int(self.homes[those[0]])))
                    continue
                names, first = np.unique(kinds, return_index=True)
                out += [(int(guests[lo + i]), int(self.homes[those[k]])) for n, k in zip(names, first) if me < 0 or n != self.label[me]]
                self.label[np.isin(self.label, names)] = names[0]
        return out


def simhash_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, t: int = 3, blocks: tuple[int, ...] | None = None) -> DataFrame:
    """key, fingerprint (16 lowercase hex digits) and component_id (the least key reachable by links within t bits), a row for each row.

    Null texts, empty texts and those without words have fingerprint zero, linked like any other. Equal fingerprints, whole copies
    among them, are one from the start. Rows with repeated keys are rows of their own; null keys belong to components, whose least
    key leaves them out; a component of null keys alone is null. Texts of any length are whole; other columns, whatever their names,
    are ignored. No rows give no rows.
    """
    raw, fp = fresh(docs, "raw", "fp")
    with working_tables(docs.sparkSession) as keep:
        kind = docs.schema[key].dataType.simpleString()

        def make():
            return lambda part: {"id": part["id"], "fp": np.array([fingerprint(x, size) for x in part["raw"]], np.uint64).view(np.int64)}

        rows = docs.select(docs[key].alias("id"), text_bytes(docs[text]).alias(raw)).toDF("id", "raw")
        prints = written(map_rows(rows, make, f"id {kind}, fp bigint", rows=128), "prints")
        kinds = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "kinds")
        labels = components(docs.sparkSession, links(kinds, t, blocks))
        linked = written(labels.withColumnRenamed("v", "fp").join(kinds, "fp"), "linked")
        # A component's least key is dealt over salts, as one may hold a third of all fingerprints.
        salts = 16
        least = linked.groupBy("label").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        named = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int")).join(least, ["label", "salt"]).select("fp", "component_id")
        alone = kinds.join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
        out = prints.join(named.unionByName(alone), "fp")
        shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
        return keep(written(out.select(F.col("id").alias(key), shown.alias("fingerprint"), "component_id"), "simhash"))
