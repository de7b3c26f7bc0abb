"""A Gaussian fit kept up to date over a stream: each micro-batch adds its sums, and the model follows without old rows."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.families import Gaussian
from ..operators import linalg, select
from ..operators.fit import TARGET, WEIGHT, Design, Statistics, prepared
from ..operators.model import GamModel
from ..operators.rows import SparkRows
from ..operators.select import Working


class RunningFit:
    """Begins as a model fitted on first rows, whose knots and constraints stay. A batch that comes twice, by its id, counts once."""

    def __init__(self, model: GamModel):
        if model.fam.name != "gaussian":
            raise ValueError("running sums need a Gaussian model")
        self.model, self.seen = model, set()
        self.sums = Working(model.gram.copy(), model.rhs.copy(), model.zz, model.rows)

    def add(self, batch: DataFrame, batch_id: int | None = None) -> GamModel:
        if batch_id is not None and batch_id in self.seen or batch.isEmpty():
            return self.model
        m = self.model
        data = prepared(batch, m.target, m.terms, m.weight, "omit")
        rows = SparkRows(data, [TARGET, WEIGHT, *dict.fromkeys(t.name for t in m.terms)])
        s = Statistics(rows, Design(m.terms), Gaussian()).at(None)
        w = self.sums = Working(self.sums.g + s["g"], self.sums.r + s["r"], self.sums.zz + s["zz"], self.sums.n + s["n"])
        pen = Design(m.terms).penalties
        rho = select.choose(w, pen, m.method, rho=np.log(m.lam))
        beta, a = w.beta(pen, np.exp(rho)), select.ridged(w.g) + pen.total(np.exp(rho))
        edf, rss = np.diag(linalg.solve(a, w.g)), w.rss(beta)
        scale = rss / max(w.n - edf.sum(), 1e-8)
        self.model = replace(m, beta=beta, lam=np.exp(rho), edf=edf, vcov=scale * linalg.inverse(a), scale=scale, deviance=rss, gram=w.g, rhs=w.r, zz=w.zz, rows=int(w.n))
        if batch_id is not None:
            self.seen.add(batch_id)
        return self.model

    def follow(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts a query that adds every micro-batch."""
        return stream.writeStream.foreachBatch(lambda df, i: self.add(df, i)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
