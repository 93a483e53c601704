"""The queries of this package and their oracles."""

from importlib import import_module

MODULES = ("substring", "url_rules", "pii", "suffix_array", "exact_dedup", "decontaminate", "quality", "mixing", "simhash", "licenses", "alignment", "quality_rules", "search")


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"quillspark.llm.{name}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict:
    return _all("ORACLES")
