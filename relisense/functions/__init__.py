"""Column helpers, quantiles, ordered windows and distribution tails."""
