"""Regular expressions of matchers, which are anchored and of the RE2 kind, as Java patterns."""

from __future__ import annotations

import re

#: What RE2 has no notion of: look-around, back references, possessive quantifiers, atomic groups.
_FOREIGN = re.compile(r"(?:\\.)|(\(\?(?:[=!>]|<[=!]))|([*+?}]\+)", re.S)
_BACKREFERENCE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|k<)")


#: Named classes of ASCII characters, as Java names them.
_CLASSES = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph",
    "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit",
}
_NAMED_CLASS = re.compile(r"\[:(\^?)(\w+):\]")
_PROPERTY = re.compile(r"\\([pP])(?:\{(\^?)(\w+)\}|(\w))")
#: White space without the vertical tab, which Java's class has.
_SPACE = r"\t\n\f\r "


def _escape(pattern: str, at: int, inside: bool) -> tuple[str, int]:
    """The escape that begins at ``at``, for Java, and where it ends."""
    kind = pattern[at + 1 : at + 2]
    if kind == "Q" and not inside:
        end = pattern.find(r"\E", at)
        end = len(pattern) if end < 0 else end + 2
        return pattern[at:end], end
    if kind in ("p", "P"):
        m = _PROPERTY.match(pattern, at)
        if not m:
            raise ValueError(f"malformed regular expression {pattern!r}")
        name, negated = m[3] or m[4], (m[1] == "P") != (m[2] == "^")
        return rf"\{'P' if negated else 'p'}{{{name if len(name) < 3 else 'Is' + name}}}", m.end()
    if kind == "s":
        return (_SPACE if inside else f"[{_SPACE}]"), at + 2
    if kind == "S" and not inside:
        return f"[^{_SPACE}]", at + 2
    if kind == "v":
        return r"\x0B", at + 2
    if kind in ("Z", "G", "R", "X", "h", "H", "V", "K", "N"):
        raise ValueError(f"unsupported regular expression {pattern!r}")
    return pattern[at : at + 2], at + 2


def _translated(pattern: str) -> str:
    """What is written alike but means another thing in Java: named classes, brackets and && in a class, \\s and \\v."""
    out, at, inside, opened = [], 0, False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            text, at = _escape(pattern, at, inside)
            out.append(text)
            continue
        if not inside:
            if c == "(" and (flags := re.match(r"\(\?([a-zA-Z]*)-?([a-zA-Z]*)[:)]", pattern[at:])) and not set(flags[1] + flags[2]) <= set("ims"):
                raise ValueError(f"unsupported flags in regular expression {pattern!r}")
            inside = c == "["
            out.append(c)
            at += 1
            if inside:
                if pattern[at : at + 1] == "^":
                    out.append("^")
                    at += 1
                opened = at
            continue
        named = _NAMED_CLASS.match(pattern, at) if c == "[" else None
        if named:
            if named[2] != "word" and named[2] not in _CLASSES:
                raise ValueError(f"malformed regular expression {pattern!r}")
            letter = "w" if named[2] == "word" else "p"
            letter = letter.upper() if named[1] else letter
            out.append(rf"\{letter}" if named[2] == "word" else rf"\{letter}{{{_CLASSES[named[2]]}}}")
            at = named.end()
            continue
        if c == "]" and at > opened:
            inside = False
            out.append(c)
        else:
            out.append("\\" + c if c in "[]&" else c)
        at += 1
    return "".join(out)


def _for_python(pattern: str) -> str:
    """The same groups and brackets, with an x for what Python does not know: only for checks and counts."""
    plain = re.sub(r"\\[pP]\{\^?\w+\}|\\[pP]\w|\\[zQECA]|\\x\{\w+\}|\[:\^?\w+:\]", "x", pattern)
    return re.sub(r"\(\?<(?![=!])", "(?P<", plain)


def java_pattern(pattern: str) -> str:
    """``pattern``, to be found in the whole of a text; raises ValueError for what RE2 would not take."""
    if any(m.group(1) or m.group(2) for m in _FOREIGN.finditer(pattern)) or _BACKREFERENCE.search(pattern):
        raise ValueError(f"unsupported regular expression {pattern!r}")
    plain = re.sub(r"\(\?P<", "(?<", pattern)
    try:
        re.compile(_for_python(pattern))
    except re.error as error:
        raise ValueError(f"malformed regular expression {pattern!r}: {error}") from None
    return _translated(plain)


def anchored(pattern: str) -> str:
    """A Java pattern for the whole text; (?d) makes "." stop at line feeds alone."""
    return rf"(?d)\A(?:{java_pattern(pattern)})\z"


def template_parts(template: str) -> list[tuple[str, str]]:
    """A replacement text as ("text", ...) and ("group", number or name) parts; "$$" is a dollar sign."""
    out: list[tuple[str, str]] = []
    at = 0
    for m in re.finditer(r"\$(?:(\$)|\{(\w+)\}|(\w+))", template):
        out.append(("text", template[at : m.start()]))
        out.append(("text", "$") if m[1] else ("group", m[2] or m[3]))
        at = m.end()
    out.append(("text", template[at:]))
    return [p for p in out if p[1]]


def group_numbers(pattern: str) -> tuple[int, dict[str, int]]:
    """The number of capturing groups, and the numbers of the named ones."""
    try:
        compiled = re.compile(_for_python(pattern))
    except re.error as error:
        raise ValueError(f"malformed regular expression {pattern!r}: {error}") from None
    return compiled.groups, dict(compiled.groupindex)
