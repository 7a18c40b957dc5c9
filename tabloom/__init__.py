"""Tabloom: a lazy data-manipulation engine on Spark DataFrames."""

from importlib import import_module

_HOMES = {"Session": "session", "View": "plans.view", "VerbError": "errors"}
__all__ = sorted(_HOMES)


def __getattr__(name: str):
    if name in _HOMES:  # on demand, so that Python workers import only what they run
        return getattr(import_module(f".{_HOMES[name]}", __name__), name)
    raise AttributeError(name)
