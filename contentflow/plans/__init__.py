"""Named queries, grouped by family; importing a module registers its queries."""

from importlib import import_module
from importlib.util import find_spec

FAMILIES = ["records", "validation", "storage", "queueing", "metrics", "textstats", "corpus", "knowledge",
            "topics", "state", "formats", "landed"]


def load():
    for name in FAMILIES:
        if find_spec(f"contentflow.plans.{name}") is None:
            continue
        import_module(f"contentflow.plans.{name}")
    return import_module("contentflow.plans.registry")
