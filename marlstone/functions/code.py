"""Functions in source code: names, parameters and comments, from a pass over the text that tells code from strings and comments.

A file is masked first: strings and comments become blanks of the same length, in one scan. Brackets are matched in one
scan of what is left, and each head of a function is read from the places of its brackets, so that the time is linear in the file.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from inspect import cleandoc
from typing import NamedTuple

_QUOTED = r"""'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?"""
_C_COMMENT = r"(?P<c>//[^\n]*|/\*(?:.*?\*/|.*))"
_BACKTICK = r"`(?:\\.|[^`\\])*`?"
# A slash after one of these begins a regular expression.
_REGEX_LITERAL = r"(?<=[(,=:\[!&|?{};\n])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"
#: What is a string and what a comment (group c) in each language.
_TOKENS = {
    "python": r"""(?P<c>\#[^\n]*)|(?<!\w)[rRbBuUfF]{0,2}(?:'''(?:(?:\\.|.)*?'''|.*)|\"\"\"(?:(?:\\.|.)*?\"\"\"|.*)|""" + _QUOTED + ")",
    "javascript": f"{_C_COMMENT}|{_QUOTED}|{_BACKTICK}|{_REGEX_LITERAL}",
    "typescript": f"{_C_COMMENT}|{_QUOTED}|{_BACKTICK}|{_REGEX_LITERAL}",
    "java": rf'{_C_COMMENT}|"""(?:(?:\\.|.)*?"""|.*)|{_QUOTED}',
    "cpp": rf'{_C_COMMENT}|(?m:^)[ \t]*\#(?:\\.|[^\n\\])*|R"(?P<tag>[^()\s\\]{{0,16}})\((?:.*?\)(?P=tag)"|.*)|(?<![0-9A-Fa-f])' + rf"'(?:\\.|[^'\\\n])*'?" + '|"(?:\\\\.|[^"\\\\\n])*"?',
    "go": rf"{_C_COMMENT}|{_QUOTED}|`[^`]*`?",
    "rust": rf"""{_C_COMMENT}|r(?P<tag>\#*)"(?:.*?"(?P=tag)|.*)|'(?:\\[^\n]|[^'\\\n])'|"(?:\\.|[^"\\])*"?""",
    "ruby": r"(?P<c>\#[^\n]*|(?m:^)=begin\b(?:.*?\n=end[^\n]*|.*))|" + _QUOTED,
}
_TOKENS["c"] = _TOKENS["cpp"]
_NAME = r"[^\W\d]\w*"
_JS_NAME = r"(?:[^\W\d]|\$)[\w$]*"
#: How a function begins, up to its name; where nothing but a type stands before it, any name before a bracket is tried.
_HEADS = {
    "python": rf"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<n>{_NAME})",
    "javascript": rf"(?<![\w$.])function\b\s*\*?\s*(?P<n>{_JS_NAME})",
    "typescript": rf"(?<![\w$.])function\b\s*\*?\s*(?P<n>{_JS_NAME})",
    "go": rf"(?m)^func\s+(?:\([^()]*\)\s*)?(?P<n>{_NAME})",
    "rust": rf"\bfn\s+(?P<n>{_NAME})",
    "ruby": rf"(?m)(?:^|;)[ \t]*def\s+(?:self\.)?(?P<n>{_NAME}[?!=]?)",
    "java": rf"(?<![\w$.])(?P<n>{_JS_NAME})(?=\s*\()",
    "cpp": rf"(?<![\w.])(?P<n>~?{_NAME}(?:::~?{_NAME})*)(?=\s*\()",
}
_HEADS["c"] = _HEADS["cpp"]
LANGUAGES = tuple(_HEADS)
#: The languages of files by the ends of their names.
EXTENSIONS = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "c": "c", "h": "cpp", "cc": "cpp", "cpp": "cpp", "hpp": "cpp"}
# Words before a bracket, or before a name, that make it no function.
_NO_NAME = frozenset("if for while switch catch synchronized return throw new sizeof decltype alignof defined super this assert case do else try static_assert operator".split())
_NO_TYPE = frozenset("return throw new else case goto delete do await yield in instanceof not and or co_return co_await".split())
_ONE_WORD_TYPES = frozenset("void int char bool float double long short unsigned signed auto size_t".split())
_AFTER = {
    "java": re.compile(r"(?:\s*\[\s*\])*\s*(?:throws\s+[\w.,\s<>@]+?)?\s*(?P<end>[{;])"),
    "cpp": re.compile(r"(?:\s|const\b|volatile\b|noexcept\b|override\b|final\b|&)*(?:->[\w\s:<>*&,]+)?(?P<end>[{;:])"),
}
_AFTER["c"] = _AFTER["cpp"]
_COMPILED = {k: re.compile(v, re.S) for k, v in _TOKENS.items()}, {k: re.compile(v) for k, v in _HEADS.items()}
_BRACKETS = re.compile(r"=>|->|[()\[\]{}<>;]")
_SPACE = re.compile(r"\s*")
_COLON = re.compile(r"\s*(?:->[^:\n]*)?:")
_CLOSES = {")": "(", "]": "[", "}": "{", ">": "<"}


class Function(NamedTuple):
    name: str
    parameters: list[str]
    docstring: str


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


def _matches(code: str) -> dict[int, int]:
    """The closing bracket of each opening one; angle brackets that a statement's end or another bracket cuts have none."""
    stack: list[int] = []
    found = {}
    for m in _BRACKETS.finditer(code):
        b = m.group()
        if b in "([{<" and len(b) == 1:
            stack.append(m.start())
            continue
        if b == ">":
            if stack and code[stack[-1]] == "<":
                found[stack.pop()] = m.start()
        elif len(b) == 1:
            while stack and code[stack[-1]] == "<":
                stack.pop()
            if b != ";" and stack and code[stack[-1]] == _CLOSES[b]:
                found[stack.pop()] = m.start()
    return found


def _parts(code: str, start: int, end: int, closes: dict[int, int]) -> list[tuple[int, int]]:
    """The places between commas outside brackets."""
    found, at, begin = [], start, start
    for_next = re.compile(r"[(\[{<,]")
    while m := for_next.search(code, at, end):
        at = m.end()
        if m.group() == ",":
            found.append((begin, m.start()))
            begin = at
        elif closes.get(m.start(), end) < end:
            at = closes[m.start()] + 1
    return [*found, (begin, end)]


def _parameters(code: str, source: str, start: int, end: int, closes: dict[int, int], language: str) -> list[str]:
    spans = [(a, b) for a, b in _parts(code, start, end, closes) if code[a:b].strip()]
    texts = [code[a:b].strip() for a, b in spans]
    if language == "go" and not any(re.match(rf"{_NAME}\s+\S", t) for t in texts):
        return []
    names, in_lambda = [], False
    for text, (a, b) in zip(texts, spans):
        if language == "python":
            # The commas of a default's lambda, up to its colon, part no parameters.
            inside, in_lambda = in_lambda, ":" not in text if in_lambda else bool(re.search(r"\blambda\b[^:]*$", text))
            if inside:
                continue
        if language in ("javascript", "typescript"):
            text = re.sub(r"^(?:@\w+\s*)*(?:(?:public|private|protected|readonly|override)\s+)*\.*\s*", "", text)
            if text[:1] in ("{", "["):
                first = a + code[a:b].index(text[0])
                names.append(" ".join(source[first : closes.get(first, b - 1) + 1].split()))
                continue
            found = re.match(_JS_NAME, text)
        elif language == "rust":
            found = re.match(rf"(?:&\s*(?:'\w+\s*)?)?(?:mut\s+)?({_NAME})", text)
        elif language in ("python", "ruby", "go"):
            found = re.match(rf"[*&]*\s*({_NAME})", text)
        else:
            text = re.sub(r"@\w+(?:\s*\([^()]*\))?", " ", text.partition("=")[0])
            pointer = re.search(rf"\(\s*[*&]+\s*({_NAME})\s*\)", text)
            text = re.sub(r"\[[^\]]*\]", " ", text).strip()
            last = re.search(rf"(?P<type>.*?)({_JS_NAME})$", text, re.S)
            lone = last and (not last["type"].strip() or last["type"].rstrip().endswith("::") or last[2] in _ONE_WORD_TYPES or re.fullmatch(r"(?:(?:const|struct|enum|class|unsigned|signed)\s*)+", last["type"].strip()))
            found = pointer or (None if lone else last)
        if found:
            names.append(found.group(found.lastindex or 0))
    return names


def _comment_text(source: str, spans: list[tuple[int, int]]) -> str:
    lines = []
    for a, b in spans:
        text = source[a:b]
        if text.startswith("/*"):
            lines += [re.sub(r"^\s*\*+ ?", "", x) for x in text[2 : -2 if text.endswith("*/") else None].lstrip("*!").split("\n")]
        elif text.startswith("=begin"):
            lines += text.split("\n")[1:-1]
        else:
            lines.append(re.sub(r"^(?://[/!]*|#+) ?", "", text))
    return cleandoc("\n".join(x.rstrip() for x in lines)).strip()


def functions(source: str | None, language: str) -> list[Function]:
    """The functions of a file in the order of their names' places.

    docstring is Python's, or else the comments right before the function, or else the first one of its body. A null
    source or another language has none; what is not closed runs to the end of the file and is no function.
    """
    if not source or language not in LANGUAGES:
        return []
    tokens, heads = _COMPILED[0][language], _COMPILED[1][language]
    comments, strings = [], {}
    for m in tokens.finditer(source):
        if m.groupdict().get("c") is not None:
            comments.append(m.span())
        else:
            strings[m.start()] = m.end()
    code = tokens.sub(_blank, source)
    closes = _matches(code)
    starts, ends = [a for a, _ in comments], dict(comments)
    lines = [0, *(m.end() for m in re.finditer("\n", code))]
    stops = [m.start() for m in re.finditer("[;{}]", code)]
    blanks = [m.start() for m in re.finditer(r"\n[ \t\r]*(?=\n)", source)]

    def line_start(at: int) -> int:
        return lines[bisect_right(lines, at) - 1]

    def none_between(places: list[int], a: int, b: int) -> bool:
        return bisect_left(places, a) == bisect_left(places, b)

    def comments_before(at: int) -> list[tuple[int, int]]:
        """The run of whole-line comments right before a function, its modifiers and annotations."""
        limit = at
        if language not in _AFTER:
            limit = line_start(at)
            while limit and source.startswith(("#[", "@"), _SPACE.match(source, above := line_start(limit - 1)).end()):
                limit = above
        run, place = [], bisect_left(starts, limit) - 1
        while place >= 0:
            a, b = comments[place]
            alone = _SPACE.match(code, line_start(a)).end() >= a
            together = none_between(stops, b, limit) if not run and language in _AFTER else _SPACE.match(code, b).end() >= limit
            if not alone or not together or not none_between(blanks, b, limit):
                break
            run.append((a, b))
            limit, place = a, place - 1
        return run[::-1]

    found = []
    for m in heads.finditer(code):
        at = m.end("n")
        while (space := _SPACE.match(code, at).end()) in closes and code[space] in "<[" and language not in ("java", "cpp", "c", "ruby"):
            at = closes[space] + 1
        at = space
        if language == "ruby" and code[at : at + 1] != "(":
            line = code.find("\n", m.end("n"))
            begin, end = m.end("n"), line if line >= 0 else len(code)
            end = min(end, code.find(";", begin, end) if ";" in code[begin:end] else end)
            if code[begin:end].lstrip().startswith("="):
                end = begin
            body = end
        elif code[at : at + 1] == "(" and at in closes:
            begin, end = at + 1, closes[at]
            body = end + 1
        else:
            continue
        if language in _AFTER:
            before = re.search(r"([\w$>\]*&]+)\s*$", code[max(0, m.start() - 200) : m.start()])
            word = before and re.search(r"[\w$]*$", before[1]).group()
            after = _AFTER[language].match(code, end + 1)
            if m["n"] in _NO_NAME or not before or word in _NO_TYPE or not after:
                continue
            if language != "java" and after["end"] == ";":
                # A declaration has types; a variable that is built from values is none.
                given = [code[a:b].strip() for a, b in _parts(code, begin, end, closes)]
                if any(g and not re.match(rf"(?:const\s+)?{_NAME}(?:::{_NAME})*\s*[<*&]|{_NAME}[\w:]*\s+[\w*&]|\.\.\.", g) and g not in _ONE_WORD_TYPES for g in given):
                    continue
        doc = ""
        if language == "python":
            colon = _COLON.match(code, body)
            inside = colon.end() if colon else len(source)
            while inside < len(source):
                if source[inside].isspace():
                    inside = _SPACE.match(source, inside).end()
                elif inside in ends:
                    inside = ends[inside]
                else:
                    break
            if inside in strings and not re.match(r"[rRuU]?[bBfF]", source[inside : inside + 2]):
                text = re.sub(r"^[rRuU]{0,2}", "", source[inside : strings[inside]])
                mark = 3 if text[:3] in ("'''", '"""') else 1
                doc = cleandoc(text[mark : -mark if len(text) >= 2 * mark and text.endswith(text[:mark]) else None])
        else:
            doc = _comment_text(source, comments_before(m.start("n")))
            stop = bisect_left(stops, body)
            first = body if language == "ruby" else stops[stop] + 1 if stop < len(stops) and code[stops[stop]] == "{" else None
            if not doc and first is not None and (first := _SPACE.match(source, first).end()) in ends:
                doc = _comment_text(source, [(first, ends[first])])
        found.append(Function(m["n"], _parameters(code, source, begin, end, closes, language), doc))
    return found
