"""Terms, statistics, fitting and models."""
