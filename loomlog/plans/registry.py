"""All registered queries: name -> (Spark callable, check SQL or None)."""

from __future__ import annotations

from loomlog.plans import clock, diagnoses, files, live, parsing, reports

MODULES = (parsing, reports, clock, diagnoses, files, live)


def registered() -> dict:
    found = {}
    for module in MODULES:
        for name, pair in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = pair
    return found
