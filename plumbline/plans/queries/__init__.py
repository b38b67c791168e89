"""Ready-made questions over the TPC-H-like tables, each with the SQL that answers the same question."""

from __future__ import annotations

from plumbline.plans.queries import cross_section, dates, files, findings, panel, quality, series

MODULES = (quality, cross_section, dates, series, panel, findings, files)


def all_queries() -> dict:
    """name -> (query, SQL or None)."""
    out = {}
    for module in MODULES:
        for name, pair in module.QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} is defined twice")
            out[name] = pair
    return out
