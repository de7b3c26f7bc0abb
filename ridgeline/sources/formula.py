"""Formulas: `y ~ s(x, k=10, bs="cr", pc=0) + re(g) + z`, the response being optional."""

from __future__ import annotations

import ast
import re

from ..operators.terms import BSpline, Cubic, Linear, RandomEffect, Term, ThinPlate

SMOOTHS = {"cr": Cubic, "bs": BSpline, "tps": ThinPlate, "tp": ThinPlate, "re": RandomEffect, "parametric": Linear}


def term(name: str, bs: str = "cr", k: int = 10, pc: float | None = None) -> Term:
    if bs not in SMOOTHS:
        raise ValueError(f"unknown basis {bs!r}; there are {', '.join(SMOOTHS)}")
    if k < 1:
        raise ValueError("k must be positive")
    return SMOOTHS[bs](name, k, pc)


def parse(formula: str) -> tuple[str | None, list[Term]]:
    """The response, if any, and the terms. s() takes k, bs and pc; re() is s(bs="re"); a bare name is a linear term."""
    left, tilde, right = formula.rpartition("~")
    out = []
    for part in _split(right):
        m = re.fullmatch(r"\s*(s|re)\s*\((.*)\)\s*", part, re.S)
        if not m:
            name = part.strip().strip("`")
            if not re.fullmatch(r"[^\W\d]\w*", name):
                raise ValueError(f"can't read the term {part.strip()!r}")
            out.append(Linear(name))
            continue
        args = [a.strip() for a in m[2].split(",") if a.strip()]
        if not args:
            raise ValueError(f"the term {part.strip()!r} names no column")
        options = {}
        for a in args[1:]:
            key, eq, value = a.partition("=")
            if not eq or key.strip() not in ("k", "bs", "pc"):
                raise ValueError(f"can't read the option {a!r}; there are k, bs and pc")
            options[key.strip()] = ast.literal_eval(value.strip())
        if m[1] == "re":
            options["bs"] = "re"
        out.append(term(args[0].strip("`"), **options))
    if not out:
        raise ValueError("the formula has no terms")
    return (left.strip() or None) if tilde else None, out


def _split(text: str) -> list[str]:
    parts, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "+" and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    if depth:
        raise ValueError("unbalanced parentheses")
    return [p for p in parts if p.strip()]
