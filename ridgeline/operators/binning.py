"""Covariate binning: continuous columns as at most 1001 cell centres, and Gram matrices from sums by cell."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1000


def bin_index(x: Column, lo: float, hi: float, bins: int = BINS) -> Column:
    """The cell of x: (x - lo) over the cell width, rounded half up."""
    width = (hi - lo) / bins
    return F.lit(0) if width <= 0 else F.round((x - F.lit(lo)) / F.lit(width)).cast("int")


def bin_centre(index: Column, lo: float, hi: float, bins: int = BINS) -> Column:
    return F.lit(lo) + index * F.lit((hi - lo) / bins)


def binned_rows(rows, terms: list, profile):
    """rows with every column of over BINS distinct values replaced by its cells' centres; others stay as they are."""
    wide = [t.name for t in terms if profile.unique[t.name] > BINS]
    if hasattr(rows, "columns"):
        made = dict(rows.columns)
        for c in wide:
            lo, width = profile.lo[c], (profile.hi[c] - profile.lo[c]) / BINS
            made[c] = lo + width * np.floor((np.asarray(made[c], np.float64) - lo) / width + 0.5)
        return type(rows)(made)
    centre = {c: bin_centre(bin_index(F.col(c), profile.lo[c], profile.hi[c]), profile.lo[c], profile.hi[c]) for c in wide}
    return type(rows)(rows.df.withColumns(centre) if centre else rows.df, rows.names)


def collapse(data: DataFrame, columns: list[str], y: str, w: str) -> DataFrame:
    """Gaussian rows with equal covariates are exchangeable: one row for each tuple, with sums of w, wy and wy^2."""
    return data.groupBy(*columns).agg(F.sum(w).alias("sw"), F.sum(F.col(w) * F.col(y)).alias("swy"), F.sum(F.col(w) * F.col(y) * F.col(y)).alias("swyy"))


def cell_sums(data: DataFrame, cells: list[str], w: str, z: str) -> DataFrame:
    """Sums of w by every pair of cell columns, and of w and wz by every single one, in one pass of grouping sets."""
    sets = [[c] for c in cells] + [[a, b] for i, a in enumerate(cells) for b in cells[:i]]
    return data.groupingSets(sets, *cells).agg(F.grouping_id(*cells).alias("gid"), F.sum(w).alias("sw"), F.sum(F.col(w) * F.col(z)).alias("swz"))


def gram_from_cells(sums, cells: list[str], bases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'Wz of the blocks, from cell_sums() as a pandas frame and each block's basis by cell."""
    m, size = len(cells), [b.shape[1] for b in bases]
    at = np.concatenate([[0], np.cumsum(size)])
    g, r = np.zeros((at[-1], at[-1])), np.zeros(at[-1])
    for i, c in enumerate(cells):
        own = sums[sums["gid"] == sum(1 << (m - 1 - j) for j in range(m) if j != i)]
        b = bases[i][own[c].to_numpy(int)]
        g[at[i] : at[i + 1], at[i] : at[i + 1]] = b.T @ (b * own["sw"].to_numpy()[:, None])
        r[at[i] : at[i + 1]] = b.T @ own["swz"].to_numpy()
        for k in range(i):
            pair = sums[sums["gid"] == sum(1 << (m - 1 - j) for j in range(m) if j not in (i, k))]
            block = bases[i][pair[c].to_numpy(int)].T @ (bases[k][pair[cells[k]].to_numpy(int)] * pair["sw"].to_numpy()[:, None])
            g[at[i] : at[i + 1], at[k] : at[k + 1]] = block
            g[at[k] : at[k + 1], at[i] : at[i + 1]] = block.T
    return g, r


def cell_eta(cells: list[str], tables: list[np.ndarray]) -> Column:
    """The linear predictor from each cell's value: lookups in literal arrays."""
    parts = [F.element_at(F.array(*[F.lit(float(v)) for v in t]), F.col(c) + 1) for c, t in zip(cells, tables)]
    return reduce(lambda a, b: a + b, parts)


class Cells:
    """A Gaussian problem by sums over cells: one grouping of the rows by every column of a smooth or random effect, and by every
    pair of them. Linear columns are summed within cells. What is kept grows with the cells, not with the rows; all later sums,
    the constraints' and the Gram matrix, read it alone."""

    def __init__(self, rows, terms: list, target: str, weight: str):
        self.names = list(dict.fromkeys(t.name for t in terms if t.kind != "parametric"))
        self.linear = list(dict.fromkeys(t.name for t in terms if t.kind == "parametric"))
        df = rows.df
        # A column may be both in cells and linear: its linear copy has a name of its own.
        x = {c: F.col(f"__x{i}") for i, c in enumerate(self.linear)}
        df = df.select(*self.names, F.col(target).alias("__v"), F.col(weight).alias("__u"), *[F.col(c).alias(f"__x{i}") for i, c in enumerate(self.linear)])
        v, u = F.col("__v"), F.col("__u")
        sums = {"n": F.count("*").cast("double"), "w": F.sum(u), "wy": F.sum(u * v), "wyy": F.sum(u * v * v), "lw": F.sum(F.log(u))}
        for i, c in enumerate(self.linear):
            sums |= {f"wx{i}": F.sum(u * x[c]), f"wxy{i}": F.sum(u * x[c] * v)}
            sums |= {f"wx{i}x{j}": F.sum(u * x[c] * x[d]) for j, d in enumerate(self.linear[: i + 1])}
        self.sums = list(sums)
        sets = [[]] + [[c] for c in self.names] + [list(pair) for pair in combinations(self.names, 2)]
        made = df.groupingSets(sets, *self.names).agg(F.grouping_id(*self.names).cast("int").alias("__set"), *[e.alias(f"__s_{k}") for k, e in sums.items()])
        made = made.persist()
        self.rows = type(rows)(made, ["__set", *self.names, *[f"__s_{k}" for k in self.sums]], made)

    def _picker(self):
        """Takes a grouping's cells and sums out of a batch; the groupings' numbers have a bit set for every column not among them."""
        names, sums = self.names, self.sums

        def at(cols: dict, *wanted: str) -> dict:
            on = cols["__set"] == sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in wanted)
            return {c: cols[c][on] for c in wanted} | {k: cols[f"__s_{k}"][on] for k in sums}

        return at

    def column_sums(self, raw: list) -> tuple[np.ndarray, np.ndarray]:
        """Column sums over rows of the raw bases, and the largest row norm of each."""
        pick = self._picker()

        def kernel(cols):
            total, most = [], []
            for t in raw:
                at = pick(cols, t.name)
                b = t.basis(np.asarray(at[t.name], np.float64))
                total.append(b.T @ at["n"])
                most.append(np.abs(b).sum(1).max(initial=0))
            return np.concatenate(total), np.array(most)

        return self.rows.reduce(kernel)

    def statistics(self, design) -> dict:
        """X'WX, X'Wy, y'Wy, the number of rows and the sum of log weights."""
        pick = self._picker()
        p, where = design.p, list(zip(design.terms, design.slices))
        smooth, linear = [(t, at) for t, at in where if t.kind != "parametric"], [(self.linear.index(t.name), at.start) for t, at in where if t.kind == "parametric"]

        def kernel(cols):
            g, r = np.zeros((p, p)), np.zeros(p)
            all_rows = pick(cols)
            g[0, 0], r[0] = all_rows["w"].sum(), all_rows["wy"].sum()
            for i, a in linear:
                g[0, a], r[a] = all_rows[f"wx{i}"].sum(), all_rows[f"wxy{i}"].sum()
                for j, b in linear:
                    g[min(a, b), max(a, b)] = all_rows[f"wx{max(i, j)}x{min(i, j)}"].sum()
            for k, (t, at) in enumerate(smooth):
                own = pick(cols, t.name)
                b = t.block(np.asarray(own[t.name]))
                g[0, at], r[at] = b.T @ own["w"], b.T @ own["wy"]
                for i, a in linear:
                    with_linear = b.T @ own[f"wx{i}"]
                    if a < at.start:
                        g[a, at] = with_linear
                    else:
                        g[at, a] = with_linear
                for other, before in smooth[: k + 1]:
                    if other.name == t.name:
                        both, left = own, other.block(np.asarray(own[t.name]))
                        right = b
                    else:
                        both = pick(cols, other.name, t.name)
                        left, right = other.block(np.asarray(both[other.name])), t.block(np.asarray(both[t.name]))
                    g[before, at] = left.T @ (right * both["w"][:, None])
            ends = [all_rows["wyy"].sum(), all_rows["n"].sum(), all_rows["lw"].sum()]
            return np.concatenate([g[np.triu_indices(p)], r, ends]), np.zeros(1)

        s = self.rows.reduce(kernel)[0]
        tri = np.triu_indices(p)
        g = np.zeros((p, p))
        g[tri] = s[: len(tri[0])]
        zz, n, lw = s[-3:]
        return {"g": g + np.triu(g, 1).T, "r": s[len(tri[0]) : -3], "zz": float(zz), "n": float(n), "log_weights": float(lw)}

    def release(self) -> None:
        self.rows.release()
