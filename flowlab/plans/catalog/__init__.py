"""Registered queries over the given tables, each with equivalent SQL where there is any."""

from importlib import import_module

MODULES = ["preparing", "encoding", "sampling", "evaluation", "learning", "streams"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
