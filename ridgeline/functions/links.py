"""Link functions. Arguments are clamped first, so that no formula over- or underflows; one place for fitting and scoring."""

from __future__ import annotations

import math

#: Bounds of the linear predictor for log and logit, and of its size for the reciprocal.
ETA_MAX, ETA_LEAST = 20.0, 1e-10


class Link:
    name = "identity"

    def safe_eta(self, o, eta):
        return eta

    def safe_mu(self, o, mu):
        return mu

    def link(self, o, mu):
        return mu

    def inverse(self, o, eta):
        return eta

    def slope(self, o, eta):
        """d mu / d eta."""
        return eta * 0.0 + 1.0

    def derivatives(self, o, mu):
        """g'', g''' and g'''' at mu."""
        return mu * 0.0, mu * 0.0, mu * 0.0


class Log(Link):
    name = "log"

    def safe_eta(self, o, eta):
        return o.least(eta, ETA_MAX)

    def safe_mu(self, o, mu):
        return o.least(o.greatest(mu, math.exp(-ETA_MAX)), math.exp(ETA_MAX))

    def link(self, o, mu):
        return o.log(self.safe_mu(o, mu))

    def inverse(self, o, eta):
        return o.exp(self.safe_eta(o, eta))

    def slope(self, o, eta):
        return o.exp(self.safe_eta(o, eta))

    def derivatives(self, o, mu):
        m = self.safe_mu(o, mu)
        return -1.0 / (m * m), 2.0 / (m * m * m), -6.0 / (m * m * m * m)


class Logit(Link):
    name = "logit"

    def safe_eta(self, o, eta):
        return o.least(o.greatest(eta, -ETA_MAX), ETA_MAX)

    def safe_mu(self, o, mu):
        lo = 1.0 / (1.0 + math.exp(ETA_MAX))
        return o.least(o.greatest(mu, lo), 1.0 - lo)

    def link(self, o, mu):
        m = self.safe_mu(o, mu)
        return o.log(m / (1.0 - m))

    def inverse(self, o, eta):
        return 1.0 / (1.0 + o.exp(-self.safe_eta(o, eta)))

    def slope(self, o, eta):
        mu = self.inverse(o, eta)
        return mu * (1.0 - mu)

    def derivatives(self, o, mu):
        m = self.safe_mu(o, mu)
        q = 1.0 - m
        return 1.0 / (q * q) - 1.0 / (m * m), 2.0 / (q * q * q) + 2.0 / (m * m * m), 6.0 / (q * q * q * q) - 6.0 / (m * m * m * m)


class Reciprocal(Link):
    name = "inverse"

    def safe_eta(self, o, eta):
        return o.where(o.abs(eta) >= ETA_LEAST, eta, o.where(eta < 0, -ETA_LEAST, ETA_LEAST))

    def safe_mu(self, o, mu):
        return self.safe_eta(o, mu)

    def link(self, o, mu):
        return 1.0 / self.safe_mu(o, mu)

    def inverse(self, o, eta):
        return 1.0 / self.safe_eta(o, eta)

    def slope(self, o, eta):
        e = self.safe_eta(o, eta)
        return -1.0 / (e * e)

    def derivatives(self, o, mu):
        m = self.safe_mu(o, mu)
        return 2.0 / (m * m * m), -6.0 / (m * m * m * m), 24.0 / (m * m * m * m * m)


LINKS = {k: c() for c in (Link, Log, Logit, Reciprocal) for k in ((c.name,) if c is not Reciprocal else ("inverse", "reciprocal"))}
