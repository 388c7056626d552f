"""A small lexer of shell scripts: words, redirects, assignments and substitutions of one text.

`lex(text)` is the one Python crossing of the command policies. Scripts inside a script (of wrappers, here-bodies and
substitutions) are found by Columns and lexed as texts of their own: see unwrap.py and operators/scripts.py.
What the lexer doesn't understand is malformed, which the policies deny.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

STAGE = (
    "struct<basename:string,name:string,argv0:string,args:array<string>,assignments:array<struct<name:string,value:string>>,"
    "redirects:array<struct<kind:string,append:boolean,target:string,body:string,fd:string>>,"
    "subs:array<string>,sub_names:array<string>,sub_all_names:array<string>,sub_words:array<string>>"
)
SCRIPT = f"struct<whole:boolean,pipelines:array<array<{STAGE}>>>"

#: Fixed values
SHELLS = ["bash", "sh", "zsh", "dash", "ksh", "ash"]
ALL_SHELLS = [*SHELLS, "fish", "tcsh", "csh"]
CODE_SINKS = [*ALL_SHELLS, "source", ".", "eval"]
DECLARATIONS = ["declare", "typeset", "export", "readonly", "local", "unset", "unsetenv"]

_REDIRECT = re.compile(r"(\d*)(<<<|<<-|<<|<>|<&|>>|>&|>\||&>>|&>|<(?!\()|>(?!\())")
_ASSIGN = re.compile(r"([A-Za-z_]\w*)(?:\[[^]]*\])?\+?=", re.A)
#: Runs of characters that mean nothing in a word, in double quotes, and within brackets
_PLAIN, _QUOTED, _WITHIN = re.compile(r"""[^ \t\r\n;|&()<>'"`$\\]+"""), re.compile(r"""[^"$`\\]+"""), re.compile(r"""[^\\'"`(){}]+""")
_ASTRAL_AFTER_BRACE = re.compile("(?s)\\{.*[\U00010000-\U0010ffff]")


class Malformed(Exception):
    """Text that the lexer can't read."""


@dataclass
class Stage:
    argv0: str | None = None
    args: list = field(default_factory=list)
    redirects: list = field(default_factory=list)
    assignments: list = field(default_factory=list)
    subs: list = field(default_factory=list)

    @property
    def basename(self) -> str:
        name = unicodedata.normalize("NFKC", self.argv0 or "")
        # $'...' and $"..." are quotes too
        return unquote(name[1:] if name[:2] in ("$'", '$"') else name, "'\"`").rpartition("/")[2]


def unquote(s: str, quotes: str = "'\"") -> str:
    return s[1:-1] if len(s) >= 2 and s[0] == s[-1] and s[0] in quotes else s


class Lexer:
    """One pass over a script; `script` returns its pipelines as lists of stages."""

    def __init__(self, text: str, depth: int = 0):
        if depth > 100:
            raise Malformed
        self.s, self.i, self.depth, self.bodies = text, 0, depth, []

    def script(self, close: str = "") -> list[list[Stage]]:
        out: list[list[Stage]] = []
        stages, stage, compound = [], Stage(), False

        def end_stage(pipe: bool) -> None:
            nonlocal stage
            bare = stage.argv0 is None or stage.argv0 in DECLARATIONS
            if stage.argv0 is None and not (stage.assignments or stage.redirects):
                if pipe or stages:
                    raise Malformed
            elif bare and (pipe or stages):
                raise Malformed
            elif bare:
                # no command runs, but its substitutions do
                for sub in stage.subs:
                    out.extend(Lexer(sub, self.depth + 1).script())
            else:
                stages.append(stage)
            stage = Stage()

        def end_pipeline() -> None:
            nonlocal stages, compound
            end_stage(False)
            if stages:
                out.append(stages)
            stages, compound = [], False

        while True:
            self._spaces()
            c = self.s[self.i : self.i + 1]
            fresh = stage.argv0 is None and not stage.assignments and not stage.redirects
            if not c or (c in close and c):
                if stages and fresh:
                    raise Malformed
                end_pipeline()
                if close and not c or self.bodies:
                    if close or any(self.bodies):
                        raise Malformed
                return out
            if c == "#":
                self.i = (self.s.find("\n", self.i) + 1 or len(self.s) + 1) - 1
            elif c == "\n" or self.s.startswith((";", "&&", "||"), self.i) or (c == "&" and self.s[self.i + 1 : self.i + 2] != ">"):
                end_pipeline()
                self.i += 2 if self.s.startswith((";;", "&&", "||"), self.i) else 1
                if c == "\n":
                    self._heredocs()
            elif c == "|":
                if compound:
                    raise Malformed
                end_stage(True)
                self.i += 2 if self.s.startswith("|&", self.i) else 1
                self._spaces(lines=True)
            elif c == "(" and fresh:
                if stages or compound:
                    raise Malformed
                if self.s.startswith("((", self.i) and (to := self.s.find("))", self.i)) > 0:
                    self.i = to + 2
                else:
                    self.i += 1
                    out.extend(self.script(")"))
                    self.i += 1
                compound = True
            elif c in "()":
                if c == "(" and stage.argv0 and not stage.args and self.s.startswith("()", self.i):
                    self.i, stage = self.i + 2, Stage()  # a function's name
                    continue
                raise Malformed
            elif m := _REDIRECT.match(self.s, self.i):
                if compound:
                    raise Malformed
                self._redirect(stage, m)
            else:
                at = self.i
                raw, word, subs = self._word()
                plain = raw == word
                if compound and not (fresh and plain and word in ("fi", "done", "esac", "}", "then", "do", "else", "elif")):
                    raise Malformed
                if fresh and plain and self._keyword(word, bool(stages), out):
                    compound = word in ("fi", "done", "esac", "}", "]]", "case", "[[")
                    continue
                stage.subs += subs
                if stage.argv0 is None and (a := _ASSIGN.match(raw)):
                    value = raw[a.end() :]
                    if not value and self.s[self.i : self.i + 1] == "(":
                        value = self._balanced("(", ")")
                    stage.assignments.append((a[1], value))
                elif stage.argv0 is None:
                    stage.argv0 = self.s[at : self.i] if raw[:1] == "$" else word
                else:
                    stage.args.append(word)

    def _keyword(self, word: str, piped: bool, out: list) -> bool:
        if word in ("then", "do", "else", "elif", "fi", "done", "esac", "}", "!", "time") and not (word == "time" and piped):
            return word != "time"
        if word in ("if", "while", "until", "{", "for", "select", "case", "[[", "function"):
            if piped:
                raise Malformed
            if word in ("for", "select"):
                while True:
                    self._spaces()
                    if self.i >= len(self.s) or self.s[self.i] in ";\n":
                        break
                    if self.s.startswith("((", self.i):
                        self.i = self.s.find("))", self.i) + 2 or len(self.s)
                        continue
                    for sub in self._word()[2]:
                        out.extend(Lexer(sub, self.depth + 1).script())
            elif word in ("case", "[["):
                last, depth = ("esac", 1) if word == "case" else ("]]", 1)
                while depth:
                    self._spaces(lines=True)
                    if self.i >= len(self.s):
                        raise Malformed
                    if self.s[self.i] in "();&|<>":
                        self.i += 1
                        continue
                    inner = self._word()[0]
                    depth += (inner == word) - (inner == last)
            elif word == "function":
                self._spaces()
                self._word()
                if self.s.startswith("()", self.i):
                    self.i += 2
            return True
        return False

    def _spaces(self, lines: bool = False) -> None:
        while self.i < len(self.s):
            if self.s[self.i] in (" \t\r\n" if lines else " \t\r"):
                self.i += 1
            elif self.s.startswith("\\\n", self.i):
                self.i += 2
            else:
                return

    def _redirect(self, stage: Stage, m: re.Match) -> None:
        self.i = m.end()
        number, op = m[1], m[2]
        self._spaces()
        raw, word, subs = self._word()
        if not raw:
            raise Malformed
        fd = {"": "stdout" if ">" in op else "stdin", "0": "stdin", "1": "stdout", "2": "stderr"}.get(number, "other")
        if op in ("<<", "<<-"):
            item = ["heredoc", False, word, "", "stdin"]
            self.bodies.append((item, word, op == "<<-", raw == word, stage))
        elif op == "<<<":
            item = ["herestring", False, raw, None, "stdin"]
        else:
            both = op in ("&>", "&>>") or (op == ">&" and not number and not word.lstrip("-").isdigit() and word != "-")
            item = ["out" if ">" in op else "in", ">>" in op, word, None, "both" if both else fd]
        stage.subs += subs
        stage.redirects.append(item)

    def _heredocs(self) -> None:
        for item, word, tabs, live, stage in self.bodies:
            lines = []
            while True:
                if self.i >= len(self.s):
                    break
                to = self.s.find("\n", self.i)
                line = self.s[self.i : to if to >= 0 else len(self.s)]
                self.i = to + 1 if to >= 0 else len(self.s)
                if (line.lstrip("\t") if tabs else line) == word:
                    break
                lines.append(line + "\n")
            item[3] = "".join(lines)
            if live:
                inner = Lexer(item[3], self.depth + 1)
                while inner.i < len(inner.s):
                    stage.subs += inner._part()[2] if inner.s[inner.i] in "$`" else inner._skip()
        self.bodies = []

    def _skip(self) -> list:
        self.i += 2 if self.s[self.i] == "\\" else 1
        return []

    def _balanced(self, open_: str, close: str) -> str:
        """The text inside brackets that open here; quotes and nested brackets count."""
        self.i, at, level = self.i + 1, self.i + 1, 1
        while self.i < len(self.s):
            if m := _WITHIN.match(self.s, self.i):
                self.i = m.end()
                continue
            c = self.s[self.i]
            if c == "\\":
                self.i += 1
            elif c in "'\"`":
                self._part()
                continue
            elif c in open_ + close:
                level += 1 if c == open_ else -1
                if not level:
                    self.i += 1
                    return self.s[at : self.i - 1]
            self.i += 1
        raise Malformed

    def _part(self) -> tuple[str, str, list]:
        """(raw, text without its quotes, substitutions) of one part of a word."""
        at, c = self.i, self.s[self.i]
        two = self.s[at : at + 2]
        if c == "'" or two == "$'":
            j = at + len(two) if two == "$'" else at + 1
            while (to := self.s.find("'", j)) > 0 and two == "$'" and self.s[to - 1] == "\\":
                j = to + 1
            if to < 0:
                raise Malformed
            self.i = to + 1
            return self.s[at : self.i], self.s[at + (2 if two == "$'" else 1) : to], []
        if c == '"' or two == '$"':
            self.i, subs = at + (2 if two == '$"' else 1), []
            first = self.i
            while self.s[self.i : self.i + 1] != '"':
                if self.i >= len(self.s):
                    raise Malformed
                if m := _QUOTED.match(self.s, self.i):
                    self.i = m.end()
                elif self.s[self.i] in "$`":
                    subs += self._part()[2]
                else:
                    self._skip()
            self.i += 1
            return self.s[at : self.i], self.s[first : self.i - 1], subs
        if c == "`":
            to = at + 1
            while self.s[to : to + 1] != "`":
                if to >= len(self.s):
                    raise Malformed
                to += 2 if self.s[to] == "\\" else 1
            self.i = to + 1
            return self.s[at : self.i], self.s[at : self.i], [self.s[at + 1 : to].replace("\\`", "`")]
        if two in ("$(", "<(", ">("):
            self.i = at + 1
            inner = self._balanced("(", ")")
            raw = self.s[at : self.i]
            nested = [] if self.s.startswith("$((", at) and raw.endswith("))") else [inner]
            return raw, raw, nested
        if two == "${":
            self.i = at + 1
            inner = Lexer(self._balanced("{", "}"), self.depth + 1)
            subs = []
            while inner.i < len(inner.s):
                subs += inner._part()[2] if inner.s[inner.i] in "$`" else inner._skip()
            return self.s[at : self.i], self.s[at : self.i], subs
        self._skip()
        return self.s[at : self.i], self.s[at : self.i], []

    def _word(self) -> tuple[str, str, list]:
        raw, text, subs = [], [], []
        while self.i < len(self.s):
            if m := _PLAIN.match(self.s, self.i):
                self.i = m.end()
                raw.append(m[0])
                text.append(m[0])
                continue
            c = self.s[self.i]
            if c in " \t\r\n;|&()" or (c in "<>" and self.s[self.i + 1 : self.i + 2] != "("):
                break
            r, t, u = self._part()
            raw.append(r)
            text.append(t)
            subs += u
        return "".join(raw), "".join(text), subs


def _sub_facts(s: Stage) -> tuple[list, list, list]:
    """Names of the stages right inside a stage's substitutions, of those at any depth, and the words of the former."""
    names, every, words = [], [], []
    for sub in s.subs:
        try:
            for stage in _reached(Lexer(sub, 1).script(), every):
                names.append(stage.basename.lower())
                words += [stage.argv0 or "", *stage.args, *[r[2] for r in stage.redirects]]
        except (Malformed, RecursionError):
            pass
    return names, every, words


def _reached(script: list[list[Stage]], every: list[str], level: int = 0):
    """The stages of a script; the names of all those in their substitutions too go to every."""
    for stages in script:
        for s in stages:
            every.append(s.basename.lower())
            if level == 0:
                yield s
            for sub in s.subs if level < 20 else []:
                try:
                    list(_reached(Lexer(sub, 1).script(), every, level + 1))
                except Malformed:
                    pass


def _row(s: Stage) -> tuple:
    return (s.basename, s.basename.lower(), s.argv0 or "", s.args, s.assignments, [tuple(r) for r in s.redirects], s.subs, *_sub_facts(s))


def lexed(text: str | None) -> tuple | None:
    """(whole, pipelines) of one script, as SCRIPT; no pipelines: it can't be read. Not whole: one of its substitutions, or its bytes, can't."""
    if text is None:
        return None
    try:
        script = Lexer(text).script()
    except (Malformed, RecursionError):
        return False, None
    whole = not (len(text.encode("utf-8", "replace")) >= 5 and _ASTRAL_AFTER_BRACE.search(text))
    try:
        for sub in {sub for stages in script for stage in stages for sub in stage.subs} if whole else ():
            Lexer(sub, 1).script()
    except (Malformed, RecursionError):
        whole = False
    return whole, [[_row(s) for s in stages] for stages in script]


@cache
def _lex():
    # rows of nested structs are made faster from pickled tuples than from Arrow
    return F.udf(lexed, SCRIPT, useArrow=False)


def lex(text: Column) -> Column:
    """The pipelines of one script, without those of scripts inside it. Call it on distinct texts (see operators/scripts.py)."""
    return _lex()(text)
