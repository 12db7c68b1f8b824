"""Expansion of LaTeX macros: a stack of tokens, definitions with arguments, defaults and delimiters, within a budget.

Cases: a macro that calls itself is expanded until the budget is spent; what is left then stays as it is written. A macro whose
arguments end before they are complete, or do not fit its pattern, stays, too. Definitions inside braces end with them, but for
gdef and xdef. What is verbatim is not touched. White space after a command without arguments is
kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Macros that are expanded in a text, and characters that come of it beyond as many as the text has, at most.
EXPANSIONS, LENGTH = 20_000, 8_000_000

_TOKEN = re.compile(r"\\begin\{(verbatim|Verbatim|lstlisting|minted)(\*?)\}.*?\\end\{\1\2\}|\\[A-Za-z@]+|\\.|[{}\[\]]|#+[1-9]?|\s+|[^\\{}\[\]#\s]+|\\", re.S)
#: The same, but what stands between marks is one token, and what such a token is split into.
_COARSE = re.compile(r"\\begin\{(verbatim|Verbatim|lstlisting|minted)(\*?)\}.*?\\end\{\1\2\}|\\[A-Za-z@]+|\\.|[{}\[\]]|#+[1-9]?|[^\\{}\[\]#]+|\\", re.S)
_FINE = re.compile(r"\s+|\S+")
#: Commands that define others.
_NEW, _DEF = ("\\newcommand", "\\renewcommand", "\\providecommand", "\\DeclareRobustCommand"), ("\\def", "\\edef", "\\gdef", "\\xdef")


@dataclass
class Macro:
    #: What stands before the first argument, and after each one; None for an argument without a delimiter.
    before: str
    after: list[str | None]
    default: str | None
    body: list[str]


class _Incomplete(Exception):
    pass


def tokens(text: str) -> list[str]:
    return [m[0] for m in _TOKEN.finditer(text)]


class Expander:
    def __init__(self, text: str, expansions: int = EXPANSIONS, length: int = LENGTH):
        # Words are told apart only where they are read one by one: in arguments, and once a macro is named without a backslash.
        self.todo = [m[0] for m in _COARSE.finditer(text)][::-1]
        self.words = False
        self.left, self.room = expansions, length + len(text)
        self.macros: dict[str, Macro] = {}
        self.scopes: list[dict[str, Macro | None]] = []
        self.taken: list[str] = []

    def split(self) -> None:
        """Make the next token a single word or white space, if it is several."""
        if self.todo and len(t := self.todo[-1]) > 1 and t[0] not in "\\{}[]#":
            self.todo[-1:] = _FINE.findall(t)[::-1]

    def take(self) -> str:
        if not self.todo:
            raise _Incomplete
        self.split()
        t = self.todo.pop()
        self.taken.append(t)
        return t

    def skip(self) -> str:
        """The next token that is no white space."""
        while (t := self.take()).isspace():
            pass
        return t

    def group(self) -> str:
        """What stands inside braces whose first one is taken."""
        out, depth = [], 1
        while True:
            t = self.take()
            depth += (t == "{") - (t == "}")
            if not depth:
                return "".join(out)
            out.append(t)

    def option(self) -> str | None:
        """What stands in brackets, if that comes next."""
        mark = len(self.taken)
        while self.todo and (t := self.take()).isspace():
            pass
        if self.taken[mark:][-1:] != ["["]:
            self.todo += reversed(self.taken[mark:])
            del self.taken[mark:]
            return None
        out, depth = [], 0
        while (t := self.take()) != "]" or depth:
            depth += (t == "{") - (t == "}")
            out.append(t)
        return "".join(out)

    def argument(self) -> str:
        t = self.skip()
        if t == "{":
            return self.group()
        if len(t) > 1 and t[0] not in "\\#":
            self.taken[-1] = t[0]
            self.todo.append(t[1:])
            return t[0]
        return t

    def until(self, mark: str) -> str:
        """What stands before a delimiter outside of braces; braces around all of it go."""
        out, depth, flat = "", 0, 0
        while True:
            t = self.take()
            depth += (t == "{") - (t == "}")
            if depth < 0:
                raise _Incomplete
            out += t
            if depth:
                flat = len(out)
                continue
            at = out.find(mark, max(flat, len(out) - len(t) - len(mark) + 1))
            if at >= 0:
                rest = out[at + len(mark) :]
                if rest:
                    self.taken[-1] = t[: len(t) - len(rest)]
                    self.todo.append(rest)
                out = out[:at]
                inner = out[1:-1]
                return inner if out[:1] == "{" and out[-1:] == "}" and "{" not in inner and "}" not in inner else out

    def define(self, name: str, macro: Macro | None, everywhere: bool = False) -> None:
        if everywhere:
            for scope in self.scopes:
                scope.pop(name, None)
        elif self.scopes:
            self.scopes[-1].setdefault(name, self.macros.get(name))
        if macro is None:
            self.macros.pop(name, None)
        else:
            self.macros[name] = macro
            self.words |= not name.startswith("\\")

    def definition(self, command: str) -> None:
        if command == "\\let":
            name, other = self.skip(), self.skip()
            other = self.skip() if other == "=" else other
            self.define(name, self.macros.get(other) or Macro("", [], None, [other]))
            return
        if command in _DEF:
            name, pattern = self.skip(), []
            while (t := self.take()) != "{":
                pattern.append(t)
            parts = re.split(r"#[1-9]", "".join(pattern))
            self.define(name, Macro(parts[0], [p or None for p in parts[1:]], None, tokens(self.group())), command in ("\\gdef", "\\xdef"))
            return
        t = self.skip()
        t = self.skip() if t == "*" else t
        name = self.group().strip() if t == "{" else t
        if command == "\\DeclareMathOperator":
            self.define(name, Macro("", [], None, ["\\operatorname", "{", *tokens(self.argument()), "}"]))
            return
        n = self.option()
        default = self.option() if n is not None else None
        body = tokens(self.argument())
        if command != "\\providecommand" or name not in self.macros:
            self.define(name, Macro("", [None] * (int(n) if n is not None and n.strip().isdigit() else 0), default, body))

    def called(self, macro: Macro) -> list[str]:
        """The body with its arguments."""
        while (macro.before or macro.after) and self.todo and self.todo[-1][0].isspace():
            self.take()
        if macro.before and self.until(macro.before):
            raise _Incomplete
        given = []
        for k, mark in enumerate(macro.after):
            if not k and macro.default is not None:
                found = self.option()
                given.append(macro.default if found is None else found)
            else:
                given.append(self.argument() if mark is None else self.until(mark))
        out = []
        for t in macro.body:
            if re.fullmatch("#[1-9]", t):
                out += tokens(given[int(t[1]) - 1]) if int(t[1]) <= len(given) else []
            else:
                # Two marks in a body are one of a definition inside it.
                out.append(t[1:] if t.startswith("##") else t)
        return out

    def run(self) -> str:
        out: list[str] = []
        size = 0
        while self.todo:
            self.taken = []
            if self.words:
                self.split()
            t = self.todo.pop()
            spent = self.left <= 0 or size > self.room
            if t == "{":
                self.scopes.append({})
            elif t == "}" and self.scopes:
                for name, macro in self.scopes.pop().items():
                    if macro is None:
                        self.macros.pop(name, None)
                    else:
                        self.macros[name] = macro
            elif not spent and (t in self.macros or t in _NEW or t in _DEF or t in ("\\let", "\\DeclareMathOperator")):
                self.left -= 1
                try:
                    if t in self.macros:
                        self.todo += reversed(self.called(self.macros[t]))
                    else:
                        self.definition(t)
                    continue
                except _Incomplete:
                    # Nothing is lost: what was read comes again after the command.
                    self.todo += reversed(self.taken)
            if out and t[0].isalpha() and re.fullmatch(r"\\[A-Za-z@]+", out[-1]):
                out.append(" ")
            out.append(t)
            size += len(t)
        return "".join(out)


def expanded(text: str, expansions: int = EXPANSIONS, length: int = LENGTH) -> str:
    """The text with its definitions taken out and its macros replaced."""
    return Expander(text, expansions, length).run()
