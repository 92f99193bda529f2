"""Linear scanners that find the outermost blocks of a text.

Each gives (start, body start, end, type, symbol) in reading order, in one pass
over the text: no pattern is retried from every opening, and nothing recurses.
"""

from __future__ import annotations

import re

from tidemark import fixed

Block = tuple[int, int, int, str, str]

_TAG = re.compile(r"<(script|style|nav|article|footer)\b[^>]*>", re.I)


def page_blocks(text: str) -> list[Block]:
    """Elements of the page's block tags, up to the first closing tag of the name."""
    out, at, unclosed, low = [], 0, set(), text.lower()
    if len(low) != len(text):  # a few letters change length; tags are ASCII
        low = text
    end = text.rfind(">") + 1  # past it, no tag can close
    while m := _TAG.search(text, at, end):
        name = m[1].lower()
        close = -1 if name in unclosed else low.find(f"</{name}>", m.end())
        if close < 0 and low is text and name not in unclosed:
            found = re.compile(f"</{name}>", re.I).search(text, m.end())
            close = found.start() if found else -1
        if close < 0:
            unclosed.add(name)
            at = m.start() + 1
            continue
        at = close + len(name) + 3
        out.append((m.start(), m.start(), at, name, f"{name}_{len(out)}"))
    return out


# strings and comments whole, brackets, colons and line ends one by one
_PYTHON = re.compile(
    r'"""(?:[^\\"]|\\.|"(?!""))*"""|' r"'''(?:[^\\']|\\.|'(?!''))*'''|" r'"(?:[^"\\\n]|\\.)*"?|' r"'(?:[^'\\\n]|\\.)*'?|"
    r"#[^\n]*|[\[\](){}:\n]|\\\n",
    re.S,
)
_DEF = re.compile(r"(?:async[ \t]+)?def[ \t]+(\w+)")


def _logical_lines(text: str) -> list[list[int]]:
    """[start, first colon outside brackets or -1, end, end of code] of each line that begins outside strings and brackets."""
    lines, start, depth, colon, code_end = [], 0, 0, -1, -1
    for m in _PYTHON.finditer(text):
        c = m[0][0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(depth - 1, 0)
        elif c == ":" and not depth and colon < 0:
            colon = m.start()
        elif c == "#" and not depth:
            code_end = m.start()  # a comment ends its line, and this one
        elif c == "\n" and not depth:
            lines.append([start, colon, m.start(), code_end if code_end >= 0 else m.start()])
            start, colon, code_end = m.end(), -1, -1
    lines.append([start, colon, len(text), code_end if code_end >= 0 else len(text)])
    return lines


def python_blocks(text: str) -> list[Block]:
    """Bodies of functions, by indentation; comments and strings at any column do not end one."""
    out: list[Block] = []
    open_: tuple[int, int, str, int] | None = None  # start, indentation, symbol, colon
    body = last = -1

    def close() -> None:
        if open_ and body >= 0:
            out.append((open_[0], body, last, "function_definition", open_[2]))

    for start, colon, _, code_end in _logical_lines(text):
        code = text[start:code_end]
        stripped = code.strip()
        if not stripped:
            continue
        indent = len(code[:len(code) - len(code.lstrip())].expandtabs(8))
        first = start + len(code) - len(code.lstrip())
        if open_:
            if indent > open_[1]:
                body = first if body < 0 else body
                last = start + len(code.rstrip())
                continue
            close()
            open_, body = None, -1
        m = _DEF.match(text, first, code_end)
        if m and colon >= 0:
            rest = text[colon + 1:code_end]
            if rest.strip():
                out.append((start, colon + 1 + len(rest) - len(rest.lstrip()), colon + 1 + len(rest.rstrip()), "function_definition", m[1]))
            else:
                open_ = (start, indent, m[1], colon)
    close()
    return out


_BRACE = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`|[\w$]+|=>|[{}()\[\];,:=<>|&?.*+\-!~^%/@#]",
    re.S,
)
_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; => + - * % < > ~ ^ return typeof case in of do else".split())
_CONTROL = frozenset("if for while switch catch with return new else do typeof void delete await yield throw in of super".split())
_TYPE_GOES_ON = frozenset(": | & < , => ( [ ?".split())


def brace_blocks(text: str) -> list[Block]:
    """Bodies of functions, methods and arrow functions in any layout.

    Strings, templates, comments and regular expressions are passed over; a brace
    opens a body after ``=>`` or after the parameters and the return type of a
    function or method.
    """
    out: list[Block] = []
    stack: list[dict] = []
    recent: list[tuple[str, int]] = []  # the last tokens
    head: dict | None = None  # parameters that may be followed by a body
    inside: int | None = None  # depth of the body that is open
    at = no_regex = 0

    def prev(n: int = 1) -> str:
        return recent[-n][0] if len(recent) >= n else ""

    def template(at: int) -> int:
        """End of the template's text from ``at``: after the tick, or after ``${``, which is then open."""
        while m := _TEMPLATE.search(text, at):
            at = m.end()
            if m[0] == "`":
                recent.append(("`", m.start()))
                return at
            if m[0] == "${":
                stack.append({"open": "${"})
                recent.append(("{", m.start()))
                return at
        return len(text)

    while m := _BRACE.search(text, at):
        token, start, at = m[0], m.start(), m.end()
        if token.startswith(("//", "/*")):
            continue
        if token == "/" and start >= no_regex and (not recent or prev() in _BEFORE_REGEX):
            r = _REGEX.match(text, start)
            if r:
                at = r.end()
                recent.append(("/x/", start))
                continue
            no_regex = text.find("\n", start) % (len(text) + 1)  # none is closed on this line
        if token == "`":
            at = template(at)
            continue
        if token == "(":
            stack.append({"open": "(", "at": start, "before": list(recent[-4:]), "in_type": head is not None and head["typed"]})
        elif token == "[":
            stack.append({"open": "["})
        elif token in ")]":
            if stack and stack[-1]["open"] == ("(" if token == ")" else "["):
                closed = stack.pop()
                if token == ")" and not closed["in_type"] and inside is None:
                    head = closed | {"depth": len(stack), "typed": False}
        elif token == "{":
            body = _body_of(prev(), prev(2), recent, head, len(stack)) if inside is None else None
            stack.append({"open": "{", "body": (start, *body) if body else None})
            if body:
                inside, head = len(stack), None
        elif token == "}":
            while stack and stack[-1]["open"] not in ("{", "${"):
                stack.pop()
            if stack:
                closed = stack.pop()
                if closed["open"] == "${":
                    at = template(at)
                    continue
                if inside is not None and len(stack) < inside and closed["body"]:
                    begin, first, kind, symbol = closed["body"]
                    out.append((first, begin, at, kind, symbol))
                    inside = None
            if head is not None and not (head["typed"] and len(stack) == head["depth"]):  # an object type may end here
                head = None
        elif head is not None and len(stack) == head["depth"]:
            if token == ":" and prev() == ")" and not head["typed"]:
                head["typed"] = True
            elif token in ("=", ";") or not head["typed"] and token != "=>":
                head = None
        recent.append((token, start))
        if len(recent) > 64:
            del recent[:-16]
    return out


def _declared(tokens: list[tuple[str, int]]) -> tuple[str, int] | None:
    """The name in ``name =``, ``name: type =`` or ``name:`` before a function that is a value."""
    words = [t for t, _ in tokens]
    while words and words[-1] in ("async",):
        words, tokens = words[:-1], tokens[:-1]
    if words and words[-1] in ("=", ":") and len(words) > 1 and re.fullmatch(r"[\w$]+", words[-2]):
        return words[-2], tokens[-2][1]
    return None


def _body_of(prev: str, before: str, recent: list[tuple[str, int]], head: dict | None, depth: int) -> tuple[int, str, str] | None:
    """(start, type, symbol) of the function whose body a brace opens; None if it opens something else."""
    if prev == "=>":
        if head is not None and head["depth"] == depth and (before == ")" or head["typed"]):
            start, tokens = head["at"], head["before"]
        else:  # one bare parameter
            start, tokens = recent[-2][1] if len(recent) > 1 else recent[-1][1], recent[:-2]
        named = _declared(tokens)
        return (named[1] if named else start), "arrow_function", named[0] if named else fixed.ANONYMOUS
    if head is None or head["depth"] != depth or head["typed"] and prev in _TYPE_GOES_ON:
        return None
    tokens = head["before"]
    words = [t for t, _ in tokens]
    if not words:
        return None
    for back in (1, 2, 3):
        if len(words) >= back and words[-back] == "function":
            name = words[-1] if back > 1 and words[-1] != "*" else ""
            generator = "*" in words[-back:]
            named = (name, 0) if name else _declared(tokens[:-back])
            kind = "generator_function_declaration" if generator else "function_declaration"
            return tokens[-back][1], kind, named[0] if named else fixed.ANONYMOUS
    if words[-1] == ">":  # type parameters: run<T>(...) {
        i = len(words) - 1 - words[::-1].index("<") if "<" in words else 0
        name = words[i - 1] if i and re.fullmatch(r"[\w$]+", words[i - 1]) else fixed.ANONYMOUS
        return tokens[max(i - 1, 0)][1], "method_definition", name
    if words[-1] == "]":
        return tokens[-1][1], "method_definition", fixed.ANONYMOUS
    if re.fullmatch(r"[\w$]+", words[-1]) and words[-1] not in _CONTROL and (len(words) < 2 or words[-2] not in (".", "new")):
        return tokens[-1][1], "method_definition", words[-1]
    return None
