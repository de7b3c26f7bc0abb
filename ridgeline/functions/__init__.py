"""Per-row formulas, each written once and bound to numpy arrays or to Spark columns."""
