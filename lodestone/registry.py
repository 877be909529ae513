"""Registry of user extensions by kind and name."""

from __future__ import annotations

from collections.abc import Callable

KINDS = ("script", "collector", "rescorer", "blender", "fetch_task", "field_type", "analyzer", "similarity", "highlighter", "hits_logger", "ingestion", "custom_request", "metrics")
_known: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str) -> Callable[[Callable], Callable]:
    """Decorator that makes ``name`` known as an extension of ``kind``."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of extension: {kind}")

    def put(f: Callable) -> Callable:
        _known[kind, name] = f
        return f

    return put


def lookup(kind: str, name: str) -> Callable:
    try:
        return _known[kind, name]
    except KeyError:
        raise ValueError(f"no {kind} is registered as {name}") from None
