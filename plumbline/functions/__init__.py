"""Shared building blocks: ranks, ordered series, lag products, tails."""
