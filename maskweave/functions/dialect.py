"""Regular expressions written in the ECMAScript dialect (no `u` flag), re-expressed for Java, Python and RE2.

`\\b`, `\\d` and `\\w` are ASCII there, `\\s` holds 25 code points, `$` is the absolute end, and ignoring case
also folds accented letters.  Java and Python differ on each point, so these are spelled out.
"""

from __future__ import annotations

#: The code points of ECMAScript white space, as the inside of a class.
SPACE = r"\t\n\x0B\f\r " + "".join(f"\\u{c:04X}" for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
WORD = "A-Za-z0-9_"
EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def _spell(source: str, space: str, edge: str, end: str) -> str:
    out, i, inside = [], 0, False
    while i < len(source):
        c = source[i]
        if c == "\\":
            n = source[i + 1]
            made = {"s": space if inside else f"[{space}]", "d": "0-9" if inside else "[0-9]", "b": edge if not inside else r"\b"}.get(n)
            out.append(made if made is not None else ("/" if n == "/" else c + n))
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "[" and inside:
            c = r"\["
        elif c == "]":
            inside = False
        elif c == "&" and inside:
            c = r"\&"
        elif c == "$" and not inside:
            c = end
        out.append(c)
        i += 1
    return "".join(out)


def java(source: str, ignore_case: bool = False) -> str:
    return ("(?iu)" if ignore_case else "") + _spell(source, SPACE, EDGE, r"\z")


def python(source: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + _spell(source, SPACE, EDGE, r"\Z")


def re2(source: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + _spell(source, r"\t\n\x0B\f\r ", r"\b", r"\z").replace(r"\&", "&")


#: `String.trim()`
TRIM = rf"^[{SPACE}]+|[{SPACE}]+\z"
