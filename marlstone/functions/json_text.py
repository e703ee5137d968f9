"""JSON that was damaged on its way: read by a scanner with a stack of its own, in time linear in the text."""

from __future__ import annotations

import json
import re

_BLANK = re.compile(r"\s*")
_START = re.compile(r"[\[{]")
_DOUBLE = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
#: The end of a text in single quotes: an apostrophe before what may follow a value; any other is a character of it.
_SINGLE_END = re.compile(r"(?<!\\)'(?=\s*(?:[,:\]}]|\Z))")
_NUMBER = re.compile(r"-?\d+(\.\d+)?([eE][+-]?\d+)?(?![\w.])")
_WORD = re.compile(r"[A-Za-z_$][\w$-]*")
_LITERALS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}
#: Stands for: no value here.
_NOTHING = object()


class _Wrong(Exception):
    """There is no JSON at this place."""


def _string(text: str, at: int) -> tuple[str, int]:
    """The text in quotes that begins at a place, and the place after it; one that does not end goes to the end."""
    if text[at] == '"':
        m = _DOUBLE.match(text, at)
        body, end = (text[at + 1 : m.end() - 1], m.end()) if m else (text[at + 1 :], len(text))
    else:
        m = _SINGLE_END.search(text, at + 1)
        body, end = (text[at + 1 : m.start()], m.end()) if m else (text[at + 1 :], len(text))
        body = body.replace("\\'", "'")
        body = re.sub(r'(\\.)|"', lambda x: x[1] or '\\"', body, flags=re.S)
    try:
        return json.loads(f'"{body}"', strict=False), end
    except ValueError:
        return body, end


def _scalar(text: str, at: int):
    """The value that is no list and no object, and the place after it."""
    if text[at] in "\"'":
        return _string(text, at)
    if m := _NUMBER.match(text, at):
        try:
            return (float if m[1] or m[2] else int)(m[0]), m.end()
        except ValueError:  # more digits than a number may have
            return m[0], m.end()
    if (m := _WORD.match(text, at)) and m[0] in _LITERALS:
        return _LITERALS[m[0]], m.end()
    raise _Wrong


def _parse(text: str, start: int):
    """(the value that begins at start, where it fails or ends, the first list or object inside that is whole).

    Commas too many are skipped; keys may be bare; at the end of the text all that is open is closed, a key without value
    having null.
    """
    stack: list[list] = []  # [list or object, its place, key that waits for its value, whether a comma must come first]
    whole: tuple[int, object] | None = None
    at = start
    try:
        while True:
            at = _BLANK.match(text, at).end()
            c = text[at : at + 1]
            top = stack[-1] if stack else None
            if not c:
                for box, _, key, _ in reversed(stack):
                    if key is not _NOTHING:
                        box[key] = None
                return stack[0][0] or _NOTHING, at, whole
            if top and c in "]}" and top[2] is _NOTHING:
                if (c == "]") != isinstance(top[0], list):
                    raise _Wrong
                box, place, _, _ = stack.pop()
                at += 1
                if not stack:
                    return box, at, whole
                if whole is None or place < whole[0]:
                    whole = place, box
                continue
            if c == "," and top and top[2] is _NOTHING:
                top[3] = False
                at += 1
                continue
            if top and top[3]:
                raise _Wrong
            if top and isinstance(top[0], dict) and top[2] is _NOTHING:
                if c in "\"'":
                    key, at = _string(text, at)
                elif m := _WORD.match(text, at) or _NUMBER.match(text, at):
                    key, at = m[0], m.end()
                else:
                    raise _Wrong
                at = _BLANK.match(text, at).end()
                if at < len(text) and text[at] != ":":
                    raise _Wrong
                top[2] = key
                at += 1
                continue
            if c in "[{":
                value = [] if c == "[" else {}
                new = [value, at, _NOTHING, False]
                at += 1
            else:
                value, at = _scalar(text, at)
                new = None
            if top:
                if isinstance(top[0], list):
                    top[0].append(value)
                else:
                    top[0][top[2]] = value
                top[2], top[3] = _NOTHING, True
            if new:
                stack.append(new)
    except _Wrong:
        return _NOTHING, max(at, start + 1), whole


def decoded(text: str):
    """The value that the text is; else its first list or object, mended where it is damaged; else None.

    A place where no value can be read ends all that is open there, so that none of it is read twice.
    """
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        pass
    at = 0
    while m := _START.search(text, at):
        value, at, whole = _parse(text, m.start())
        if value is not _NOTHING:
            return value
        if whole:
            return whole[1]
    return None


def encoded(value) -> str:
    """As json.dumps writes it, whatever the depth."""
    out: list[str] = []
    todo: list = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, _Raw):
            out.append(x.text)
        elif isinstance(x, list | dict) and x:
            items = list(x.items()) if isinstance(x, dict) else [(None, v) for v in x]
            opened, closed = "{}" if isinstance(x, dict) else "[]"
            todo.append(_Raw(closed))
            for i in range(len(items) - 1, -1, -1):
                key, v = items[i]
                todo += [v, _Raw((", " if i else opened) + (f"{json.dumps(key)}: " if isinstance(x, dict) else ""))]
        else:
            out.append(json.dumps(x))
    return "".join(out)


class _Raw:
    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text


def repaired(text: str | None) -> str | None:
    """The text's value as JSON; null if it has none, or is null."""
    if text is None:
        return None
    value = decoded(text)
    return None if value is None else encoded(value)
