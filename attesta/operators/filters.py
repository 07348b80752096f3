"""Boolean filter strings: tokenised, checked, and turned into a Column. No text of the user reaches the SQL parser.

Grammar: comparisons ``== != > >= < <=``, ``LIKE "pattern"``, ``in [..]``, ``&& || and or not``, parentheses; operands
are bare columns, ``metadata["key"]`` paths, numbers, strings and booleans.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<num>-?\d+(?:\.\d+)?)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<op>==|!=|>=|<=|&&|\|\||[><()\[\],])|(?P<name>[A-Za-z_]\w*))""")


class FilterError(ValueError):
    pass


class _Parser:
    def __init__(self, text: str, columns: set[str], json_columns: set[str]):
        self.columns, self.json, self.tokens, at = columns, json_columns, [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise FilterError(f"unexpected text at {at}: {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> tuple[str, str]:
        if self.at >= len(self.tokens) or wanted and self.tokens[self.at][1].lower() not in wanted:
            raise FilterError(f"expected {wanted or 'more'}, found {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self) -> Column:
        left = self.both()
        while (self.peek() or "").lower() in ("||", "or"):
            self.take()
            left = left | self.both()
        return left

    def both(self) -> Column:
        left = self.term()
        while (self.peek() or "").lower() in ("&&", "and"):
            self.take()
            left = left & self.term()
        return left

    def term(self) -> Column:
        word = (self.peek() or "").lower()
        if word == "not":
            self.take()
            return ~self.term()
        if word == "(":
            self.take()
            inner = self.either()
            self.take(")")
            return inner
        return self.comparison()

    def literal(self):
        kind, text = self.take()
        if kind == "num":
            return float(text) if "." in text else int(text)
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        if kind == "name" and text.lower() in ("true", "false"):
            return text.lower() == "true"
        raise FilterError(f"expected a literal, found {text!r}")

    def comparison(self) -> Column:
        kind, name = self.take()
        if kind != "name" or name not in self.columns:
            raise FilterError(f"unknown column {name!r}")
        path = None
        if self.peek() == "[":
            self.take()
            path = self.literal()
            self.take("]")
            if name not in self.json or not isinstance(path, str):
                raise FilterError(f"{name!r} has no paths")
        _, op = self.take("==", "!=", ">", ">=", "<", "<=", "like", "in")
        if op.lower() == "in":
            self.take("[")
            values = [self.literal()]
            while self.peek() == ",":
                self.take()
                values.append(self.literal())
            self.take("]")
            return self.operand(name, path, values[0]).isin(values)
        value = self.literal()
        col = self.operand(name, path, value)
        if op.lower() == "like":
            return col.like(value)
        return {"==": col.__eq__, "!=": col.__ne__, ">": col.__gt__, ">=": col.__ge__, "<": col.__lt__, "<=": col.__le__}[op](value)

    def operand(self, name: str, path: str | None, value) -> Column:
        if path is None:
            return F.col(name)
        found = F.get_json_object(F.col(name), "$['" + path.replace("'", "") + "']")
        return found if isinstance(value, str) else found.try_cast("boolean" if isinstance(value, bool) else "double")


def compile_filter(text: str, columns: list[str], json_columns: tuple[str, ...] = ("metadata",)) -> Column:
    """The filter as a Column over ``columns``; ``json_columns`` hold JSON text and take ``["key"]`` paths."""
    parser = _Parser(text, set(columns), set(json_columns))
    out = parser.either()
    if parser.peek() is not None:
        raise FilterError(f"unexpected {parser.peek()!r}")
    return out
