"""Rewrite a rule pattern from RE2 syntax into a Java pattern that matches the same text.

Rules are written for RE2, where ``\\b`` and ``\\w`` are ASCII, ``\\s`` has no
vertical tab, ``.`` is anything but a newline and ``(?i)`` folds case over Unicode.
Spark's regex functions use Java's engine, which differs on each of these.
"""

from __future__ import annotations

import re

_WORD = "(?-iu:[0-9A-Za-z_])"
_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_NO_BOUNDARY = f"(?:(?<!{_WORD})(?!{_WORD})|(?<={_WORD})(?={_WORD}))"
_SPACE = r"\t\n\f\r "
_POSIX = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "digit": "0-9", "lower": "a-z", "upper": "A-Z",
          "space": r"\t\n\x0B\f\r ", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f"}
_CLASS_INSIDE = {"s": _SPACE, "w": "0-9A-Za-z_", "d": "0-9"}
_OUTSIDE = {
    "b": _BOUNDARY, "B": _NO_BOUNDARY, "A": r"\A", "z": r"\z",
    "s": f"[{_SPACE}]", "S": f"[^{_SPACE}]", "w": "[0-9A-Za-z_]", "W": "[^0-9A-Za-z_]",
    "d": "[0-9]", "D": "[^0-9]",
}
_CONTROL = "afnrtv"
_LEAD = re.compile(r"([A-Za-z0-9_-]+)\.\*(?![?+*{])")
_REPEAT = re.compile(r"\{(\d+)(?:,(\d*))?\}")


class UnsupportedPattern(ValueError):
    """The pattern is not valid in the rule dialect, or cannot be rewritten exactly."""


def to_java(pattern: str, boundaries: bool = True) -> str:
    """Java form of a rule pattern, for one line of text; without ``boundaries``, ``\\b`` holds anywhere."""
    flags = re.match(r"\(\?([is]+)\)", pattern)
    fold = flags is not None and "i" in flags.group(1)
    dot = "(?s:.)" if flags is not None and "s" in flags.group(1) else r"[^\n]"
    out = ["(?iu)"] if fold else []
    at = flags.end() if flags else 0
    lead = _LEAD.match(pattern, at)
    if lead:
        # "word.*rest" matches a line if the rest follows the first such word. Java would try every
        # other one as well, each time up to the end of the line.
        out.append(rf"\A(?>(?s:.*?){lead.group(1)})")
        at = lead.end(1)
    repeated = False  # the previous piece was a repetition operator
    while at < len(pattern):
        char = pattern[at]
        piece, width, repeat = char, 1, False
        if char == "\\":
            piece, width = _escape(pattern, at, _OUTSIDE)
            if pattern[at:at + 2] == r"\b":
                piece = _next_is(pattern, at + 2, fold) + _BOUNDARY if boundaries else ""
        elif char == "[":
            piece, width = _char_class(pattern, at, fold)
        elif char == ".":
            piece = dot
        elif char == "^":
            piece = r"\A"
        elif char == "$":
            piece = r"\z"
        elif char == "(":
            piece, width = _group(pattern, at)
        elif char in "*+?":
            repeat = True
        elif char == "{":
            found = _REPEAT.match(pattern, at)
            if found is None:
                piece = r"\{"
            else:
                if max(int(n) for n in found.groups() if n) > 1000:
                    raise UnsupportedPattern(f"repeat count over 1000 in {pattern!r}")
                piece, width, repeat = found.group(), len(found.group()), True
        elif char in "}]":
            piece = "\\" + char
        if repeat and pattern[at + width:at + width + 1] == "?":
            piece, width = piece + "?", width + 1
        if repeat and repeated:
            raise UnsupportedPattern(f"nested repetition in {pattern!r}")
        repeated = repeat
        out.append(piece)
        at += width
    return "".join(out)


def _next_is(pattern: str, at: int, fold: bool) -> str:
    """Lookahead for the piece behind a boundary: far cheaper to fail on than the boundary itself."""
    literal = re.compile(r"[A-Za-z0-9_]{1,3}(?![A-Za-z0-9_]*[?*{])").match(pattern, at)
    if literal:
        return f"(?={literal.group()})"
    if pattern.startswith("[", at):
        piece, width = _char_class(pattern, at, fold)
        if not re.compile(r"[?*]|\{0").match(pattern, at + width):
            return f"(?={piece})"
    return ""


def _group(pattern: str, at: int) -> tuple[str, int]:
    if not pattern.startswith("(?", at):
        return "(", 1
    if pattern.startswith("(?:", at):
        return "(?:", 3
    named = re.compile(r"\(\?P?<([A-Za-z][A-Za-z0-9]*)>").match(pattern, at)
    if named:
        return f"(?<{named.group(1)}>", len(named.group())
    raise UnsupportedPattern(f"group at {at} in {pattern!r}")


def _escape(pattern: str, at: int, table: dict[str, str]) -> tuple[str, int]:
    if at + 1 >= len(pattern):
        raise UnsupportedPattern(f"trailing backslash in {pattern!r}")
    char = pattern[at + 1]
    if char in table:
        return table[char], 2
    if char in _CONTROL:
        return {"v": r"\x0B"}.get(char, "\\" + char), 2
    code = re.compile(r"\\x(?:([0-9A-Fa-f]{2})|\{([0-9A-Fa-f]+)\})").match(pattern, at)
    if code:
        return rf"\x{{{code.group(1) or code.group(2)}}}", len(code.group())
    if char.isalnum():
        raise UnsupportedPattern(f"escape \\{char} in {pattern!r}")
    return "\\" + char, 2


def _char_class(pattern: str, at: int, fold: bool = False) -> tuple[str, int]:
    end = at + 1
    negated = pattern.startswith("^", end)
    end += negated
    body: list[str] = []
    while end < len(pattern):
        char = pattern[end]
        if char == "]" and body:
            if body[-1] == "-":
                body[-1] = r"\-"
            inside = "".join(body) + (_folded_members(body) if fold else "")
            return ("[^" if negated else "[") + inside + "]", end + 1 - at
        posix = re.compile(r"\[:([a-z]+):\]").match(pattern, end)
        if posix:
            if posix.group(1) not in _POSIX:
                raise UnsupportedPattern(f"class {posix.group()} in {pattern!r}")
            piece, width = _POSIX[posix.group(1)], len(posix.group())
        elif pattern.startswith("[:", end):
            raise UnsupportedPattern(f"class at {pattern[end:]!r} in {pattern!r}")
        elif char == "\\":
            piece, width = _escape(pattern, end, _CLASS_INSIDE)
        elif char in "[]&^":
            piece, width = "\\" + char, 1
        else:
            piece, width = char, 1
        body.append(piece)
        end += width
    raise UnsupportedPattern(f"missing ] in {pattern!r}")


def _folded_members(body: list[str]) -> str:
    """The two non-ASCII letters that fold to ASCII ones; Java adds them to some ranges only."""
    same = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", "".join(body))
    try:
        members = re.compile(f"[{same}]")
    except re.error as problem:
        raise UnsupportedPattern(f"class [{same}]: {problem}") from None
    extra = {"kK": r"\x{212A}", "sS": r"\x{17F}"}
    return "".join(code for letters, code in extra.items() if any(members.match(c) for c in letters))
