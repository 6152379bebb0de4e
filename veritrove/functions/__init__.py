"""Scalar building blocks: the predicate language, pattern translation and distribution tails."""
