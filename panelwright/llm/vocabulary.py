"""Public tokenizer files inside tasks: read on the driver, loaded once per Python worker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict[Any, Any] = {}


def loaded(key: Any, make: Callable[[], Any]) -> Any:
    """What `make` gives, made once in this process for a key."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def contents(path: str) -> bytes:
    """A vocabulary file, a few MB at most, to be broadcast; so only the driver needs its path."""
    with open(path, "rb") as f:
        return f.read()


def balanced(texts: list[str], most: int) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters in all; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def split(texts: list[str], whole: list[bool]) -> list[list[str]]:
    """Parts of each text: the first, then what follows each single space between characters that aren't white space."""
    parts = [[t] if w else t.split(" ") for t, w in zip(texts, whole, strict=True)]
    odd = {p for own in parts for p in own if not p or p[0].isspace() or p[-1].isspace()}
    if odd:
        parts = [own if w or odd.isdisjoint(own) else _SAFE.split(t) for t, w, own in zip(texts, whole, parts, strict=True)]
    return parts
