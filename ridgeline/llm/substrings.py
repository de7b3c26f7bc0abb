"""Exact removal of repeated byte strings by suffix arrays of shards.

1. Anchors. A window's anchors are its least-hashed grams, so equal windows have equal anchors at equal offsets. Every document
   gives its anchors, each with a digest of its context, the bytes of the windows whose least-hashed gram it is.
2. Anchors whose gram occurs once take no further part. Where all contexts of a gram are equal, all its windows repeat.
3. Contexts of the other grams go to shards by gram, equal contexts as one. A shard's suffix array, by induced sorting, and its
   permuted common prefixes show which windows repeat. A gram with more contexts than a shard should hold is split by where in
   the context windows begin: each half needs less of the context, so contexts become equal or their common core unique.
4. Repeated windows become spans of documents, whose bytes are then taken out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_rows, release, remove, text_bytes, written
from .suffixes import permuted_common_prefixes, suffix_array

#: Bytes of a removable string, and of an anchor gram.
WINDOW, GRAM = 200, 96
#: Bytes of text that are hashed at once, that a suffix array is built of at once, and contexts of a gram that go to one shard.
PIECE, SHARD, TOGETHER = 1 << 20, 1 << 19, 256

_rng = np.random.default_rng(20)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + (PIECE >> 1))
        grow = np.full(size, _BASE)
        shrink = np.full(size, _INVERSE)
        grow[0] = shrink[0] = 1
        _powers[:] = [np.multiply.accumulate(grow), np.multiply.accumulate(shrink)]
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over each run of `width` values, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    return best(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1]) if have < width else out


def anchors(raw: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, gram hashes and context digests of the anchors of documents that end at `ends` in raw; and how far before each its
    windows begin, greatest << 16 | least."""
    n, reach = len(raw), window - gram
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none.astype(np.uint64), none.astype(np.uint64), none
    grow, shrink = _power(n + 1)
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[raw] * grow[:n], out=upto[1:])
    h = _mix((upto[gram:] - upto[:-gram]) * shrink[: n - gram + 1])
    top = np.maximum((h >> np.uint64(32)).astype(np.uint32), 1)  # 0 stands for no window
    least = _slide(top, reach + 1, np.minimum)  # for each window
    starts = np.concatenate([[0], ends[:-1]])
    for s, e in zip(starts.tolist(), ends.tolist()):
        least[max(s, e - window + 1) : e] = 0  # such windows cross into the next document
    # A gram is an anchor if it is the least of some window that holds it: the greatest of those least ones is its own.
    padded = np.concatenate([np.zeros(reach, np.uint32), least, np.zeros(reach, np.uint32)])
    at = np.flatnonzero((_slide(padded, reach + 1, np.maximum) == top) & (top > 0))
    own = np.lib.stride_tricks.sliding_window_view(padded, reach + 1)[at] == top[at, None]  # these windows follow each other
    first = at - reach + own.argmax(1)
    last = first + np.count_nonzero(own, 1) - 1
    lo, hi = first, last + window
    context = (upto[hi] - upto[lo]) * shrink[lo]
    d = _mix(context + (at - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (hi - lo).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return at, h[at], d, (at - first) << 16 | (at - last)


def _pieces(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about PIECE bytes together."""
    at, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > PIECE:
            yield at, i
            at, total = i, 0
        total += n
    if lengths:
        yield at, len(lengths)


def _document_anchors(texts: list[bytes], window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, position << 32 | where its windows begin, hash, digest) over all texts; one longer than a piece is read in
    overlapping parts."""
    for a, b in _pieces([len(t) for t in texts]):
        if b - a == 1 and len(texts[a]) > 2 * PIECE:
            raw, margin = np.frombuffer(texts[a], np.uint8), 2 * window
            for s in range(0, len(raw), PIECE):
                lo, hi = max(0, s - margin), min(len(raw), s + PIECE + margin)
                at, h, d, around = anchors(raw[lo:hi], np.array([hi - lo]), window, gram)
                own = (at + lo >= s) & (at + lo < s + PIECE)
                yield np.full(int(own.sum()), a), at[own] + lo << 32 | around[own], h[own], d[own]
        else:
            ends = np.cumsum([len(t) for t in texts[a:b]])
            at, h, d, around = anchors(np.frombuffer(b"".join(texts[a:b]), np.uint8), ends, window, gram)
            doc = np.searchsorted(ends, at, "right")
            yield doc + a, at - np.concatenate([[0], ends])[doc] << 32 | around, h, d


def _repeated(rows: list[tuple[bytes, int, int, int, int, int]], window: int) -> list[list[tuple[int, int]]]:
    """For each context (bytes, anchor offset, least and greatest+1 bytes before the anchor, key, copies), the runs of window
    starts, relative to the anchor, whose window occurs in another context of the same key at the same place, or that have copies."""
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    at, whole = _trimmed(rows, window)
    for i in whole:  # copies that share nothing with other contexts
        text, off, least, most = rows[i][:4]
        lo, hi = max(least, off + window - len(text)), min(most, off + 1)
        if lo < hi:
            out[i].append((1 - hi, -lo))
    if at:
        for (i, *_), found in zip(at, _by_suffixes([x[1:] for x in at], window)):
            out[i] += found
    return out


def _trimmed(rows: list[tuple], window: int, pieces: int = 8) -> tuple[list[tuple], list[int]]:
    """Contexts without the ends that only windows reach whose core, what an eighth of all window places has in common, occurs
    once among the contexts of the key: such windows can't repeat. Gives (row, context ...) for those that are left, and the rows of
    copies that aren't."""
    off, least, most, key, copies = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3, 4, 5))
    size = np.array([len(r[0]) for r in rows])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    text = np.frombuffer(b"".join(r[0] for r in rows), np.uint8)
    grow, shrink = _power(len(text) + 1)
    upto = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_TABLE[text] * grow[: len(text)], out=upto[1:])
    first, last = np.full(len(rows), 1 << 30), np.full(len(rows), -1)
    for q in range(pieces):
        a, b = least + (most - least) * q // pieces, least + (most - least) * (q + 1) // pieces
        lo, hi = np.maximum(a, off + window - size), np.minimum(b, off + 1)
        some = np.flatnonzero(lo < hi)
        if not len(some):
            continue
        s, e = (begin + off - a)[some], (begin + off - b + 1 + window)[some]
        core = _mix((upto[e] - upto[s]) * shrink[s] + key[some].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        _, which, times = np.unique(core, return_inverse=True, return_counts=True)
        met = some[times[which] > 1]
        first[met], last[met] = np.minimum(first[met], lo[met]), np.maximum(last[met], hi[met])
    kept = []
    for i in np.flatnonzero(last > first).tolist():
        lo, hi = int(first[i]), int(last[i])
        cut = int(off[i]) - hi + 1
        kept.append((i, rows[i][0][cut : int(off[i]) - lo + window], int(off[i]) - cut, lo, hi, int(key[i]), int(copies[i])))
    return kept, np.flatnonzero(copies > 1).tolist()


def _by_suffixes(rows: list[tuple], window: int) -> list[list[tuple[int, int]]]:
    """_repeated() by the suffix array of all contexts."""
    size = np.array([len(r[0]) for r in rows])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    text = np.frombuffer(b"".join(r[0] for r in rows), np.uint8)
    order = suffix_array(text)
    common = permuted_common_prefixes(text, order)[order]
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(common < window)
    off, least, most, key, copies = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3, 4, 5))
    lo = np.maximum(least, off + window - size)  # bytes before the anchor, such that the window lies inside
    hi = np.minimum(most, off + 1)
    count = np.maximum(hi - lo, 0)
    row = np.repeat(np.arange(len(rows)), count)
    x = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[row]
    g = group[begin[row] + off[row] - x]
    span = int(x.max(initial=0)) + 1
    kinds, number = np.unique(key, return_inverse=True)
    place = (g * len(kinds) + number[row]) * span + x  # equal string, key and place
    by = np.argsort(place)
    new = np.concatenate([[True], place[by[1:]] != place[by[:-1]]]) if len(by) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    often = np.bincount(run)[run] > 1 if len(by) else new
    hit = np.zeros(len(x), bool)
    hit[by] = often
    hit |= copies[row] > 1
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    at = np.flatnonzero(hit)
    if len(at):
        cut = np.concatenate([[True], (row[at[1:]] != row[at[:-1]]) | (x[at[1:]] != x[at[:-1]] + 1)])
        firsts = np.flatnonzero(cut)
        lasts = np.append(firsts[1:], len(at)) - 1
        for f, l in zip(at[firsts].tolist(), at[lasts].tolist()):
            out[row[f]].append((-int(x[l]), -int(x[f])))
    return out


def _shards(window: int):
    """Over rows sorted by key: suffix arrays of about SHARD bytes of whole keys."""
    schema = arrow_schema("id binary, lo int, hi int")

    def emit(names: list[bytes], rows: list[tuple]) -> pa.RecordBatch:
        flat = [(i, lo, hi) for i, runs in zip(names, _repeated(rows, window)) for lo, hi in runs]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size, last, number = [], [], 0, None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, i, n, off, content, a, b in zip(*(part.column(c).to_pylist() for c in ("key", "id", "n", "off", "content", "a", "b"))):
                    if key != last:
                        if size >= SHARD:
                            yield emit(names, held)
                            names, held, size = [], [], 0
                            release()  # a worker holds one shard at a time
                        last, number = key, number + 1
                    names.append(i)
                    held.append((content, off, a, b, number, n))
                    size += len(content)
        if held:
            yield emit(names, held)
        names, held = [], []
        release()

    return run


def _bytes(c: str):
    return F.unhex(F.lpad(F.hex(c), 16, "0"))


def _halves(window: int, rows: list[tuple]) -> dict[str, list]:
    """Each context's range of window starts in two: the part of the context that a half reaches, its core, and its digest."""
    out: dict[str, list] = {c: [] for c in ("key", "part", "parent", "n", "off", "content", "a", "b")}
    for parent, n, off, content, a, b in rows:
        mid = (a + b) // 2
        for lo, hi in ((a, mid), (mid, b)):
            first, last = max(lo, off + window - len(content)), min(hi, off + 1)
            if first >= last:
                continue
            core = content[off - lo if off >= lo else 0 : off - hi + 1 + window]
            begin = max(0, off - hi + 1)
            part = content[begin : off - lo + window]
            tag = b"%d %d " % (lo, hi)
            for c, v in zip(out, (xxhash.xxh3_128_digest(tag + core), xxhash.xxh3_128_digest(b"%d " % (off - begin) + part), parent, n, off - begin, part, lo, hi)):
                out[c].append(v)
    return out


def repeated_spans(docs: DataFrame, key: list[str], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The columns of key, and spans: array of start << 32 | end of bytes that windows occurring elsewhere cover; unmerged, and not
    yet cut to the document's end. No row for documents without any. docs: the columns of key, and raw (binary, no nulls). Rows with equal keys must have equal raw."""
    reach = window - gram
    if not 0 <= reach < 1 << 16:
        raise ValueError("a window is at least as long as its gram, and less than 65,536 bytes longer")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*key).schema)
    schema = f"{types}, pos bigint, h bigint, d bigint"

    def make():
        def f(part):
            got = list(_document_anchors(part["raw"], window, gram))
            join = lambda i, t: np.concatenate([x[i] for x in got]).astype(t) if got else np.zeros(0, t)
            doc = join(0, np.int64).tolist()
            return {k: [part[k][i] for i in doc] for k in key} | {"pos": join(1, np.int64), "h": join(2, np.uint64).view(np.int64), "d": join(3, np.uint64).view(np.int64)}

        return f

    every = written(map_rows(docs.where(F.length("raw") >= window), make, schema), "anchors")
    grams = every.groupBy("h").agg(F.count("*").alias("n"), (F.min("d") != F.max("d")).alias("mixed")).where("n > 1").drop("n")
    grams = written(grams, "grams")  # as a table of its own, so that Spark can split a hot gram's rows in the join
    again = written(every.join(grams.hint("shuffle_hash"), "h"), "anchors-again")
    remove(every)
    position = F.shiftright("pos", 32).cast("int").alias("pos")
    first, last = (F.shiftright("pos", 16).bitwiseAND(F.lit(0xFFFF)), F.col("pos").bitwiseAND(F.lit(0xFFFF)))
    plain = again.where("not mixed").select(*key, position, F.array(F.struct((-first).cast("int").alias("lo"), (-last).cast("int").alias("hi"))).alias("runs"))

    # The bytes of one context for each that differs.
    mixed = again.where("mixed")
    kinds = mixed.groupBy("h", "d").agg(F.count("*").alias("n"), F.min(F.struct(*key, "pos")).alias("one"))
    wanted = kinds.select("h", "d", "n", *[F.col(f"one.{k}").alias(f"w_{k}") for k in key], F.col("one.pos").alias("pos"))
    wanted = wanted.groupBy(*[f"w_{k}" for k in key]).agg(F.collect_list(F.struct("h", "d", "n", "pos")).alias("asked"))
    found = docs.join(wanted, [docs[k].eqNullSafe(wanted[f"w_{k}"]) for k in key]).select("raw", "asked")

    def cut():
        def f(part):
            out: dict[str, list] = {c: [] for c in ("h", "d", "n", "off", "content")}
            for raw, asked in zip(part["raw"], part["asked"]):
                for x in asked:
                    at, first, last = x["pos"] >> 32, x["pos"] >> 16 & 0xFFFF, x["pos"] & 0xFFFF
                    for c, v in zip(out, (x["h"], x["d"], x["n"], first, raw[at - first : at - last + window])):
                        out[c].append(v)
            return out

        return f

    contexts = map_rows(found, cut, "h bigint, d bigint, n bigint, off int, content binary", rows=64).dropDuplicates(["h", "d"])
    contexts = contexts.withColumn("id", F.concat(_bytes("h"), _bytes("d")))
    items = written(contexts.select(_bytes("h").alias("key"), "id", "n", "off", "content", F.lit(0).alias("a"), F.lit(reach + 1).alias("b")), "contexts")
    # members: which contexts (h, d) an item stands for.
    members = items.select(F.col("id").alias("root"), "id")
    hits = []
    while True:
        sizes = items.groupBy("key").agg(F.count("*").alias("rows"))
        large = written(sizes.where(F.col("rows") > TOGETHER).select("key"), "large-grams")
        few = items.join(large, "key", "left_anti")
        few = few.repartition("key").sortWithinPartitions("key", "id")
        got = few.mapInArrow(_shards(window), "id binary, lo int, hi int")
        hits.append(written(members.join(got, "id").select("root", "lo", "hi"), "repeats"))
        if large.isEmpty():
            break
        many = items.join(large, "key", "left_semi").select("id", "n", "off", "content", "a", "b")

        def halve():
            return lambda part: _halves(window, list(zip(*(part[c] for c in ("id", "n", "off", "content", "a", "b")))))

        split = written(map_rows(many, halve, "key binary, part binary, parent binary, n bigint, off int, content binary, a int, b int"), "halves")
        members = written(members.join(split.select(F.col("parent").alias("id"), "key", "part"), "id").select("root", "key", F.concat("key", "part").alias("id")), "members")
        # Equal parts of a context are one item from here on.
        kinds = split.groupBy("key", "part").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("off", "content", "a", "b")])
        told = split.groupBy("key").agg(F.sum("n").alias("total"), (F.min("part") == F.max("part")).alias("equal")).where("total > 1").select("key", "equal")
        items = written(kinds.join(told, "key").select("key", F.concat("key", "part").alias("id"), "n", "off", "content", "a", "b", "equal"), "contexts")
        first, last = F.greatest("a", F.col("off") + window - F.length("content")), F.least(F.col("b"), F.col("off") + 1)
        whole = items.where("equal").select("id", (1 - last).alias("lo"), (-first).alias("hi"))
        hits.append(members.join(whole, "id").select("root", "lo", "hi"))
        items = items.where("not equal").drop("equal")
        members = members.drop("key")
    repeats = hits[0]
    for more in hits[1:]:
        repeats = repeats.unionByName(more)
    mixed = mixed.withColumn("root", F.concat(_bytes("h"), _bytes("d")))
    # One row for each context, however many runs it has, before its occurrences come in.
    runs = written(repeats.groupBy("root").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")), "runs")
    found = mixed.join(runs.hint("shuffle_hash"), "root").select(*key, position, "runs").unionByName(plain)
    # Start and end of each span in one number, so that documents' spans move and are read as plain arrays.
    spans = F.flatten(F.transform(F.collect_set(F.struct("pos", "runs")), lambda s: F.transform(s["runs"], lambda r: _packed(s["pos"] + r["lo"], s["pos"] + r["hi"] + window))))
    return found.groupBy(*key).agg(spans.alias("spans"))


def _packed(lo, hi):
    return F.shiftleft(F.greatest(lo, F.lit(0)).cast("long"), 32).bitwiseOR(hi.cast("long"))


def merged(spans: list[int] | None, n: int, window: int) -> list[tuple[int, int]]:
    """Disjoint covered runs within n bytes, from packed spans. Spans of less than a window inside the document cover none."""
    if not spans:
        return []
    x = np.unique(np.array(spans, np.int64))
    lo, hi = x >> 32, np.minimum(x & 0xFFFFFFFF, n)
    keep = hi - lo >= window
    lo, hi = lo[keep], hi[keep]
    if not len(lo):
        return []
    upto = np.maximum.accumulate(hi)
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > upto[:-1]]))
    return list(zip(lo[first].tolist(), upto[np.append(first[1:], len(lo)) - 1].tolist()))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """key, raw (all bytes), kept (binary: the bytes left, in order) and removed (array of start, end), a row for each row of docs.

    A byte goes if a string of `window` bytes that covers it also starts anywhere else, in any document; strings are judged on
    the input. Null and empty texts, and those under a window, lose nothing. Rows that repeat, keys that are null or repeat and
    texts of any length are whole documents of their own. Columns other than key and text are ignored. No rows give no rows.
    """
    slim = docs.select(docs[key].alias("key"), text_bytes(docs[text]).alias("raw")).withColumn("th", F.xxhash64("raw"))
    found = repeated_spans(slim, ["key", "th"], window, gram).withColumnsRenamed({"key": "s_key", "th": "s_th"})
    joined = slim.join(found, slim["key"].eqNullSafe(found["s_key"]) & (slim["th"] == found["s_th"]), "left").select("key", "raw", "spans")

    def make():
        def f(part):
            out = {"key": part["key"], "raw": part["raw"], "kept": [], "removed": []}
            for raw, spans in zip(part["raw"], part["spans"]):
                runs, at, kept = merged(spans, len(raw), window), 0, []
                for lo, hi in runs:
                    kept.append(raw[at:lo])
                    at = hi
                out["kept"].append(b"".join([*kept, raw[at:]]))
                out["removed"].append([{"start": lo, "end": hi} for lo, hi in runs])
            return out

        return f

    kind = slim.schema["key"].dataType.simpleString()
    return map_rows(joined, make, f"key {kind}, raw binary, kept binary, removed array<struct<start:int,end:int>>", rows=256).withColumnRenamed("key", key)


def digest(cleaned: DataFrame, key: str = "doc_id") -> DataFrame:
    return cleaned.select(
        key, F.length("raw").cast("long").alias("n_bytes"), (F.length("raw") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )

