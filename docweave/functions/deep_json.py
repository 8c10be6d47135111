"""JSON of any depth: the standard reader and writer, and ones without recursion where those give up."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from typing import Any

_BLANK = re.compile(r"[ \t\n\r]*").match
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?").match
# The words that the standard reader takes.
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def loads(text: str) -> Any:
    """The value of a JSON text; ValueError if it is none.  Depth is bounded by memory only."""
    try:
        return json.loads(text)
    except RecursionError:
        return _loads_flat(text)


def dumps(value: Any) -> str:
    """A value as JSON text in one line, non-ASCII kept."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return _dumps_flat(value)


def _scalar(text: str, at: int) -> tuple[Any, int]:
    if text[at : at + 1] == '"':
        return scanstring(text, at + 1)
    for word, value in _WORDS.items():
        if text.startswith(word, at):
            return value, at + len(word)
    if m := _NUMBER(text, at):
        return (float(m[0]) if m[2] or m[3] else int(m[1])), m.end()
    raise ValueError(f"no JSON value at {at}")


def _loads_flat(text: str) -> Any:
    open_: list[tuple[Any, str | None]] = []  # containers not closed yet, with the key under which the next value goes
    at = _BLANK(text, 0).end()

    def key(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError(f"no key at {at}")
        name, at = scanstring(text, at + 1)
        at = _BLANK(text, at).end()
        if text[at : at + 1] != ":":
            raise ValueError(f"no colon at {at}")
        return name, _BLANK(text, at + 1).end()

    while True:
        sign = text[at : at + 1]
        if sign in ("{", "["):
            at = _BLANK(text, at + 1).end()
            value: Any = {} if sign == "{" else []
            if text[at : at + 1] != ("}" if sign == "{" else "]"):
                name = None
                if sign == "{":
                    name, at = key(at)
                open_.append((value, name))
                continue
            at += 1
        else:
            value, at = _scalar(text, at)
        while open_:  # the value is complete: put it where it belongs
            holder, name = open_[-1]
            if isinstance(holder, dict):
                holder[name] = value
            else:
                holder.append(value)
            at = _BLANK(text, at).end()
            if text[at : at + 1] == ",":
                at = _BLANK(text, at + 1).end()
                if isinstance(holder, dict):
                    name, at = key(at)
                    open_[-1] = (holder, name)
                break
            if text[at : at + 1] != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(f"container not closed at {at}")
            value, at = open_.pop()[0], at + 1
        else:
            if _BLANK(text, at).end() != len(text):
                raise ValueError(f"more text at {at}")
            return value


def _dumps_flat(value: Any) -> str:
    out: list[str] = []
    todo: list[tuple[bool, Any]] = [(False, value)]  # (whether it is finished text, value)
    while todo:
        done, x = todo.pop()
        if done:
            out.append(x)
        elif isinstance(x, (dict, list)) and x:
            parts: list[tuple[bool, Any]] = [(True, "{" if isinstance(x, dict) else "[")]
            for k, item in enumerate(x.items() if isinstance(x, dict) else x):
                parts.append((True, ", " * (k > 0) + (json.dumps(item[0], ensure_ascii=False) + ": " if isinstance(x, dict) else "")))
                parts.append((False, item[1] if isinstance(x, dict) else item))
            todo += [*parts, (True, "}" if isinstance(x, dict) else "]")][::-1]
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)
