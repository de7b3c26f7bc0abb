"""Ways in and out: frames, formulas and stored models."""
