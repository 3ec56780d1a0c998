"""Tokens of the SQL dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from quillframe.errors import SqlSyntaxError

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      |(?P<str>'(?:[^']|'')*')
      |(?P<quoted>`(?:[^`]|``)+`)
      |(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)
      |(?P<var>@[^\W\d]\w*)
      |(?P<temp>\#[^\W\d]\w*)
      |(?P<name>\$?[^\W\d](?:[\w$]|\.(?=\d))*(?:@[^\W\d]\w*)?|\$\w+)
      |(?P<op><=|>=|<>|!=|\|\||[-+*/%=<>(),;.\[\]])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str  # str, num, var, temp, name, quoted, op, end
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlSyntaxError(f"unexpected character {sql[at]!r} at {at}")
        kind, text = m.lastgroup, m.group()
        if kind == "str":
            text = text[1:-1].replace("''", "'")
        elif kind == "quoted":
            text = text[1:-1].replace("``", "`")
        if kind != "space":
            out.append(Token(kind, text, at))
        at = m.end()
    out.append(Token("end", "", at))
    return out
