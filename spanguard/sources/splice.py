"""Changing strings of a JSON body in place: all other characters of it stay as they are."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_scan = json.decoder.scanstring
_SPACE = re.compile(r"[ \t\r\n]*").match
_OTHER = re.compile(r"[^ \t\r\n,\]}:\"\[{]+").match
_NEXT = re.compile(r'"(?:[^"\\]|\\.)*+"|[\[\]{}]', re.S).finditer
#: Values nested deeper than this are passed over as a whole.
DEPTH = 6

Places = dict[tuple, tuple[int, int]]


def places(body: str) -> Places:
    """Where each value of a JSON text lies, by its path of keys and numbers; of repeated keys the last counts.

    Raises ValueError for what isn't JSON. Values deeper than DEPTH are skipped without a stack.
    """
    out: Places = {}

    def over(i: int) -> int:
        """The end of the object or list that begins at i."""
        depth = 0
        for m in _NEXT(body, i):
            depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(m[0], 0)
            if not depth:
                return m.end()
        raise ValueError("not closed")

    def value(i: int, path: tuple) -> int:
        c = body[i : i + 1]
        if c == '"':
            end = _scan(body, i + 1)[1]
        elif c in ("{", "[") and c:
            end = over(i) if len(path) >= DEPTH else held(i, path, c == "{")
        else:
            m = _OTHER(body, i)
            if not m:
                raise ValueError(f"no value at {i}")
            end = m.end()
        out[path] = (i, end)
        return end

    def held(i: int, path: tuple, named: bool) -> int:
        i, n, close = _SPACE(body, i + 1).end(), 0, "}" if named else "]"
        while body[i : i + 1] != close:
            key = n
            if named:
                if body[i : i + 1] != '"':
                    raise ValueError(f"no key at {i}")
                key, i = _scan(body, i + 1)
                i = _SPACE(body, i).end()
                if body[i : i + 1] != ":":
                    raise ValueError(f"no colon at {i}")
                i = _SPACE(body, i + 1).end()
            i = _SPACE(body, value(i, (*path, key))).end()
            n += 1
            if body[i : i + 1] == ",":
                i = _SPACE(body, i + 1).end()
            elif body[i : i + 1] != close:
                raise ValueError(f"no end at {i}")
        return i + 1

    value(_SPACE(body, 0).end(), ())
    return out


def put(body: str, changes: list[tuple[int, int, str]]) -> str:
    """The body with these ranges, which don't overlap, replaced."""
    out, at = [], 0
    for start, end, text in sorted(changes):
        out += body[at:start], text
        at = end
    return "".join(out) + body[at:]


def quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def put_texts(body: str, texts: dict[str, str], field: str) -> str:
    """Message contents, by `message` or `message/part`, replaced where the body has strings there; bad JSON stays."""
    try:
        found = places(body)
    except (ValueError, RecursionError):
        return body
    changes = []
    for key, text in texts.items():
        message, _, part = key.partition("/")
        place = found.get((field, int(message), "content", *((int(part), "text") if part else ())))
        if place and body[place[0]] == '"' and text is not None and _scan(body, place[0] + 1)[0] != text:
            changes.append((*place, quoted(text)))
    return put(body, changes)


def put_reminder(name: str, body: str, reminder: str) -> str:
    """The body with the reminder at the end of its system prompt, or in a new one.

    Anthropic: the system field, if it is a string, null or missing. OpenAI: the first system message, if its content is
    a string, else, if there is none, a new first message. Other providers, and what isn't JSON, stay as they are.
    """
    block = f"<system-reminder>\n{reminder}\n</system-reminder>"
    try:
        found = places(body)
    except (ValueError, RecursionError):
        return body
    at = lambda path: body[slice(*found[path])] if path in found else ""
    more = lambda path: put(body, [(*found[path], quoted(_scan(body, found[path][0] + 1)[0] + "\n\n" + block))])
    if name == "anthropic" and at(()).startswith("{"):
        if at(("system",)) in ("", "null"):
            if ("system",) in found:
                return put(body, [(*found["system",], quoted(block))])
            start = found[()][0] + 1
            rest = "," if len(found) > 1 else ""
            return put(body, [(start, start, f'"system":{quoted(block)}{rest}')])
        return more(("system",)) if at(("system",)).startswith('"') else body
    if name == "openai" and at(("messages",)).startswith("["):
        roles = [p for p in found if len(p) == 3 and p[0] == "messages" and p[2] == "role" and at(p).startswith('"') and json.loads(at(p)) == "system"]
        if roles:
            content = ("messages", min(p[1] for p in roles), "content")
            return more(content) if at(content).startswith('"') else body
        start = found["messages",][0] + 1
        rest = "," if ("messages", 0) in found else ""
        return put(body, [(start, start, f'{{"role":"system","content":{quoted(block)}}}{rest}')])
    return body


def _each(make: Callable) -> Callable:
    """A function of several columns over Arrow batches, null where the body is null."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([make(*row) for row in zip(*columns)], dtype=object)

    return run


def with_texts(body: Column, texts: Column, field: str = "messages") -> Column:
    """The body with texts put back where chat.entries() found them: a map from `message` or `message/part` to text."""

    def make(text: str | None, new: dict | None) -> str | None:
        return text if text is None or new is None else put_texts(text, dict(new), field)

    return F.pandas_udf(_each(make), "string")(body, texts)


def reminded(name: Column, body: Column, reminder: str) -> Column:
    """The body with the reminder in its system prompt, see put_reminder()."""

    def make(provider: str | None, text: str | None) -> str | None:
        return text if text is None else put_reminder(provider or "", text, reminder)

    return F.pandas_udf(_each(make), "string")(name, body)
