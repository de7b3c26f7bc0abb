"""Secret scans: patterns in whole texts, then corpus-wide ownership frequency of every candidate."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank, fresh, map_rows, written

# Fixed patterns of the base kinds, in the order in which equal starts are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "opaque")
#: A further kind: unspaced runs of mixed characters that look random.
OPAQUE, OPAQUE_LEAST, OPAQUE_BITS = r"[A-Za-z0-9+/_=-]{20,}", 20, 3.5

#: The spans while the rows' own columns are beside them.
SPANS = "spans of secrets"
SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,base:boolean>"


def scanner():
    """A function text -> [(kind, start, end, value, base)] in code points, by start and then kind."""
    # The letter i folds to the dotless and dotted i in Unicode mode, and s to the long s: ASCII mode keeps to A-Z and a-z.
    assign, access, hexes, opaque = re.compile(ASSIGN, re.ASCII), re.compile(ACCESS), re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"]), re.compile(OPAQUE)

    def random_looking(s: str) -> bool:
        if not (any(c.isdigit() for c in s) and any("a" <= c <= "z" for c in s) and any("A" <= c <= "Z" for c in s)):
            return False
        return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) >= OPAQUE_BITS

    def scan(text: str) -> list[tuple]:
        found = [("assign", m.start(), m.end(), m[2], True) for m in assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
        if "AKIA" in text:
            found += [("access", m.start(), m.end(), m[0], True) for m in access.finditer(text) if len(m[0]) >= LEAST["access"]]
        found += [("hex", m.start(), m.end(), m[0], True) for m in hexes.finditer(text)]
        taken = [(s, e) for _, s, e, _, _ in found]
        found += [("opaque", m.start(), m.end(), m[0], False) for m in opaque.finditer(text) if random_looking(m[0]) and not any(s < m.end() and m.start() < e for s, e in taken)]
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))

    return scan


def scan_secrets(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source", carry: list[str] | None = None, copied_repositories: int = 3, copied_owners: int = 2) -> DataFrame:
    """docs' columns, or those in carry, and last `spans`: array of kind, start, end, value, base, repositories, owners, live.

    repositories and owners count the distinct ones in which a value occurs, over the whole corpus; a table without such columns
    lets its documents stand for repositories and their sources for owners. A value is widely copied, an example rather than a
    credential, when it occurs in at least `copied_repositories` repositories of at least `copied_owners` owners; else it belongs
    to an owner, and is live. Base spans stay whichever they are; opaque ones stay only if live. A null repository or owner counts
    as one of its own. Null and empty texts have no spans; texts of any length are whole; repeated rows stay as rows, and count
    once by their repository; a column that is called spans stays, and the operator's own is then `_spans`. No rows give no rows.
    """
    kept = list(docs.columns if carry is None else carry)
    name = fresh(docs.select(*kept), "spans")[0]
    slim = docs.select(F.struct(*[docs[c] for c in kept]).alias("row"), blank(docs[text]).alias("text"), docs[repository].cast("string").alias("repo"), docs[owner].cast("string").alias("own"))

    def make():
        scan = scanner()

        def f(part):
            return part | {"found": [[dict(zip(("kind", "start", "end", "value", "base"), x)) for x in scan(t)] for t in part["text"]]}

        return f

    scanned = map_rows(slim, make, f"row {slim.schema['row'].dataType.simpleString()}, repo string, own string, found array<{SPAN}>")
    return judge(scanned, copied_repositories, copied_owners).withColumnRenamed(SPANS, name)


def judge(scanned: DataFrame, copied_repositories: int, copied_owners: int) -> DataFrame:
    """The fields of row, and spans under the name SPANS, of scanned rows (row, repo, own, found). Rows that repeat stay; no rows give no rows."""
    scanned = written(scanned.withColumn("uid", F.monotonically_increasing_id()), "secrets")
    each = scanned.where(F.size("found") > 0).select("uid", "repo", "own", F.explode("found").alias("f"))
    each = each.withColumn("key", F.sha2(F.col("f.value"), 256))
    # Distinct pairs first, with partial sums on the map side, so that a value in a third of all rows is counted by many tasks.
    count = lambda c, n: each.select("key", F.struct(c).alias("x")).distinct().groupBy("key").agg(F.count("*").alias(n))
    owned = count("repo", "repositories").join(count("own", "owners"), "key")
    copied = (F.col("repositories") >= copied_repositories) & (F.col("owners") >= copied_owners)
    told = each.join(owned, "key").withColumn("live", ~copied).where(F.col("f.base") | F.col("live"))
    by_row = told.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct(
        F.col("f.start").alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), F.col("f.kind")).alias("rank"),
        F.col("f.kind").alias("kind"), F.col("f.end").alias("end"), F.col("f.value").alias("value"), F.col("f.base").alias("base"), "repositories", "owners", "live",
    ))).alias("got"))
    empty = F.array().cast(by_row.schema["got"].dataType)
    # Rows without a candidate, nearly all, take no part in the join.
    some = scanned.where(F.size("found") > 0).join(by_row, "uid", "left").select("row.*", F.coalesce("got", empty).alias(SPANS))
    return scanned.where(F.size("found") == 0).select("row.*", empty.alias(SPANS)).unionByName(some)


def digest(found: DataFrame) -> DataFrame:
    """The counts and spans of scan_secrets(), whose column is the last."""
    spans = F.col(found.columns[-1])
    base = F.filter(spans, lambda s: s["base"])
    count = lambda kind: F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"),
    )


def redact(text: str, spans: list, mark: str = "[SECRET]") -> str:
    """text without the values of live spans; overlapping spans go as one."""
    out, at = [], 0
    for s, e in sorted((x["start"], x["end"]) for x in spans if x["live"]):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])

