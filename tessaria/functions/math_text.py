"""Math mark-up as plain text (TXT-24): a scanner, dollar signs told apart first, and a reader with a stack of open braces.

Mark-up nests, which patterns over text can't follow, so this is one Arrow function. Texts without a backslash, brace
or dollar sign are returned as they are.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Symbols of the mark-up with their text, commands that wrap what is read, commands that only size what follows, environments.
SYMBOLS = {
    "Delta": "Δ", "times": "×", "cdot": "×", "div": "÷", "sum": "求和", "prod": "连乘", "geq": "≥", "ge": "≥", "leq": "≤", "le": "≤", "neq": "≠",
    "approx": "≈", "pm": "±", "rightarrow": "→", "to": "→", "infty": "∞", "%": "%", "quad": " ", ",": " ", ";": " ", ":": " ", "!": "",
}
WRAPPERS = {"text", "mathrm", "mathbf", "operatorname"}
SIZES = {"left", "right"}
ENVIRONMENTS = {"aligned", "align", "align*", "equation", "equation*", "gathered", "cases"}
#: Characters that are themselves after a backslash, and what makes a power more than one thing.
ESCAPED, COMPOUND = set("$&#_{}"), re.compile(r"[+×÷/\s-]")
#: An amount of money after a dollar sign: a number that no letter of a name goes on, but for units.
AMOUNT = re.compile(r"[0-9]+(?:[.,][0-9]+)*(?![0-9]*(?!USD|RMB)[A-Za-z_^\\])")
_TOKEN = re.compile(r"[^\\{}&$_^]+|\\[A-Za-z]+\*?|\\.|\$+|.", re.S)
_ENVIRONMENT = re.compile(r"\{([A-Za-z]+\*?)\}")
_DOLLARS = re.compile(r"\$+")
_SPACE = re.compile(r"\s*")


def _delimiters(text: str, longest: int) -> dict[int, bool]:
    """The offsets of dollar signs that open (True) or close (False) a formula.

    Two dollars close with the next two. One opens a formula if it isn't followed by an amount or white space up to
    the line's end, and the next single dollar in its line, `longest` characters away at most, isn't followed by a
    digit: that one is a price. Runs of three and more are text.
    """
    runs = []
    for m in _DOLLARS.finditer(text):
        at, n = m.start(), len(m[0])
        if at and text[at - 1] == "\\":  # the first one is itself
            at, n = at + 1, n - 1
        if n:
            runs.append((at, n))
    out: dict[int, bool] = {}
    k = 0
    while k < len(runs):
        at, n = runs[k]
        if n == 2:
            end = next((j for j in range(k + 1, len(runs)) if runs[j][1] == 2), None)
        elif n == 1 and not AMOUNT.match(text, at + 1):
            end = k + 1 if k + 1 < len(runs) and runs[k + 1][1] == 1 else None
            inside = text[at + 1 : runs[end][0]] if end else ""
            price = end and text[runs[end][0] + 1 : runs[end][0] + 2].isdigit()
            end = end if inside.strip() and "\n" not in inside and len(inside) <= longest and not price else None
        else:
            end = None
        if end is not None:
            out[at], out[runs[end][0]] = True, False
            k = end
        k += 1
    return out


class _Open:
    """An open brace: what stood before it, what has been read since, and a fraction's first part."""

    __slots__ = ("first", "kind", "out")

    def __init__(self, kind: str, first: str = "") -> None:
        self.kind, self.first, self.out = kind, first, []

    def closed(self) -> str:
        s = "".join(self.out)
        if self.kind == "_":
            return f"_{s}"
        if self.kind == "^":
            return f"^({s})" if COMPOUND.search(s) else f"^{s}"
        if self.kind == "sqrt":
            return f"√({s})"
        if self.kind in ("frac", "over"):
            return f"({self.first}) ÷ ({s})" if self.kind == "over" else f"({s})"
        return s if self.kind == "text" else f"{{{s}}}"

    def broken(self) -> str:
        """What is left of a brace that never closes."""
        before = {"_": "_", "^": "^", "sqrt": "√", "over": f"({self.first}) ÷ "}.get(self.kind, "")
        return before + "{" + "".join(self.out)


def read_math(text: str, longest: int = 500) -> str:
    """Plain text of one text with mark-up, in one pass over its tokens."""
    if not any(c in text for c in "\\{$") and "&=" not in text:
        return text
    dollars = _delimiters(text, longest)
    stack, math, at, trim = [_Open("")], 0, 0, False

    def brace(i: int) -> int | None:
        """The offset after the next brace that opens, white space aside."""
        if text[i : i + 1] == "{":
            return i + 1
        j = _SPACE.match(text, i).end()
        return j + 1 if text[j : j + 1] == "{" else None

    def edge(opens: bool) -> None:
        nonlocal math, trim
        math = math + 1 if opens else max(0, math - 1)
        trim = opens
        if not opens:
            out = stack[-1].out
            while out and not out[-1].rstrip():
                out.pop()
            if out:
                out[-1] = out[-1].rstrip()

    next_token, end = _TOKEN.match, len(text)
    while at < end:
        found = next_token(text, at)
        token, start, at = found[0], at, found.end()
        first, out = token[0], stack[-1].out
        if first not in "\\{}&$_^":  # a run of text, white space included
            out.append(token.lstrip() if trim else token)
            trim = False
            continue
        trim = False
        if first == "$":
            if start in dollars:
                edge(dollars[start])
            else:
                out.append(token)
        elif first == "\\" and len(token) > 1:
            name = token[1:]
            if name in ("(", "["):
                edge(True)
                continue
            if name in (")", "]"):
                edge(False)
                continue
            if name == "\\":
                out.append("\n")
                continue
            if name not in SYMBOLS and name.endswith("*"):
                name, at = name[:-1], at - 1
            inner = brace(at) if name in WRAPPERS or name in ("frac", "dfrac", "sqrt") else None
            environment = _ENVIRONMENT.match(text, at) if name in ("begin", "end") else None
            if inner is not None:
                stack.append(_Open("text" if name in WRAPPERS else "sqrt" if name == "sqrt" else "frac"))
                at = inner
            elif environment and environment[1] in ENVIRONMENTS:
                math, at = math + 1 if name == "begin" else max(0, math - 1), environment.end()
            elif name in SYMBOLS:
                out.append(SYMBOLS[name])
            elif name not in SIZES:
                out.append(name if name.isalpha() or name in ESCAPED else token)
        elif first == "{":
            stack.append(_Open("{"))
        elif first == "}" and len(stack) > 1:
            top = stack.pop()
            inner = brace(at) if top.kind == "frac" else None
            if inner is None:
                stack[-1].out.append(top.closed())
            else:
                stack.append(_Open("over", "".join(top.out)))
                at = inner
        elif first in "_^" and text[at : at + 1] == "{":
            stack.append(_Open(first))
            at += 1
        elif first == "&" and (math or text[at : at + 1] == "="):
            if text[at : at + 1] != "=":
                out.append(" ")
        else:
            out.append(token)
    while len(stack) > 1:
        top = stack.pop()
        stack[-1].out.append(top.broken())
    return "".join(stack[0].out)


@F.pandas_udf(StringType())
def _plain(s: pd.Series) -> pd.Series:
    return s.map(lambda x: read_math(x) if x is not None else None)


def plain_math(c: Column) -> Column:
    """TXT-24: math mark-up as plain text. Delimiters, environments, sizes and wrappers go, indices and powers lose their
    braces (a power of more than one thing gets parentheses), fractions become (a) ÷ (b) and roots √(a) at any depth,
    symbols become text, alignment marks go in formulas and before an equals sign, an unknown command keeps its name,
    a break becomes a line break. Dollars before amounts, single dollars without a partner, and runs of three stay. Braces that belong to no
    command stay; one that never closes stays with what was before it. Null gives null."""
    return _plain(c)
