"""Units, definitions and mentions of code: Python by its syntax tree, Rust and Java by their tokens.

The token readers know comments, strings, attributes and brackets, and declarations by their keywords; inside
bodies they record calls and names of types. They never fail on code they don't understand.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from .unit_tree import UnitTree


@dataclass(frozen=True)
class Scope:
    unit: str
    prefix: str
    in_owner: bool = False  # directly in a type's body: functions are methods
    owner: str | None = None  # the type around, for calls on itself
    calls: bool = True  # whether names before round brackets are calls; not in a type's own declaration


class Reader:
    """What the languages share: named units with their definitions."""

    def __init__(self, path: str, content: str):
        self.tree = UnitTree(path, content)
        self.top = Scope(path, path)

    def named(self, scope: Scope, name: str, kind: str, start: int, end: int, label: str | None = None) -> str:
        unit = self.tree.add(scope.unit, f"{scope.prefix}::{name}", kind, start, end, label or name)
        self.tree.define(unit, name)
        if scope.in_owner and scope.owner:
            self.tree.define(unit, f"{scope.owner}::{name}")
        return unit

    def function(self, scope: Scope, name: str, start: int, end: int) -> Scope:
        label = f"{scope.prefix.rsplit('::', 1)[-1]}::{name}" if scope.in_owner else name
        unit = self.named(scope, name, "method" if scope.in_owner else "function", start, end, label)
        return Scope(unit, unit, False, scope.owner)


class PythonReader(Reader):
    def read(self) -> UnitTree:
        self.walk(ast.parse(self.tree.content), self.top)
        return self.tree.finish()

    def names(self, node: ast.AST, scope: Scope, kind: str) -> None:
        for x in ast.walk(node):
            name = x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else x.arg if isinstance(x, ast.keyword) else None
            if name:
                self.tree.mention(scope.unit, name, kind, x.lineno if hasattr(x, "lineno") else node.lineno)

    def inside(self, node: ast.AST, scope: Scope) -> None:
        for child in ast.iter_child_nodes(node):
            self.walk(child, scope)

    def walk(self, node: ast.AST, scope: Scope) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            for d in node.decorator_list:
                self.walk(d, scope)
            inner = self.function(scope, node.name, start, node.end_lineno)
            self.inside(node.args, inner)
            if node.returns:
                self.names(node.returns, inner, "type")
            for x in node.body:
                self.walk(x, inner)
        elif isinstance(node, ast.ClassDef):
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            for d in node.decorator_list:
                self.walk(d, scope)
            unit = self.named(scope, node.name, "type", start, node.end_lineno)
            inner = Scope(unit, unit, True, node.name)
            for base in [*node.bases, *node.keywords]:
                self.names(base, inner, "type")
            for x in node.body:
                self.walk(x, inner)
        elif isinstance(node, ast.arg):
            if node.annotation:
                self.names(node.annotation, scope, "type")
        elif isinstance(node, ast.AnnAssign):
            self.names(node.annotation, scope, "type")
            for x in (node.target, node.value):
                if x is not None:
                    self.walk(x, scope)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            dotted = [node.module] if isinstance(node, ast.ImportFrom) and node.module else []
            dotted += [x for a in node.names for x in (a.name, a.asname) if x and x != "*"]
            for name in (part for d in dotted for part in d.split(".")):
                self.tree.mention(scope.unit, name, "import", node.lineno)
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                self.tree.mention(scope.unit, f.id, "call", node.lineno)
            elif isinstance(f, ast.Attribute):
                own = scope.owner and isinstance(f.value, ast.Name) and f.value.id in ("self", "cls")
                self.tree.mention(scope.unit, f"{scope.owner}::{f.attr}" if own else f.attr, "call" if own else "method", node.lineno)
            self.inside(node, scope)
        elif not isinstance(node, ast.JoinedStr):  # strings are not code
            self.inside(node, scope)


@dataclass(frozen=True)
class Token:
    kind: str  # id, mark, comment, attr, text
    text: str
    line: int
    end: int


class TokenReader(Reader):
    """Reads a language with braces from its tokens; brackets are matched once."""

    pattern: re.Pattern

    def __init__(self, path: str, content: str):
        super().__init__(path, content)
        self.toks: list[Token] = []
        line, at = 1, 0
        for m in self.pattern.finditer(content):
            line += content.count("\n", at, m.start())
            end = line + m[0].count("\n")
            self.toks.append(Token(m.lastgroup, m[0], line, end))
            line, at = end, m.end()
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.toks):
            if t.kind == "mark" and t.text in ("(", "[", "{"):
                stack.append(i)
            elif t.kind == "mark" and t.text in (")", "]", "}"):
                while stack and {"(": ")", "[": "]", "{": "}"}[self.toks[stack[-1]].text] != t.text:
                    stack.pop()
                if stack:
                    o = stack.pop()
                    self.match[o], self.match[i] = i, o
        self.silent = {i for i, t in enumerate(self.toks) if t.kind in ("comment", "attr")}
        self.spots = [i for i in range(len(self.toks)) if i not in self.silent]  # tokens that are code
        self.place = {i: k for k, i in enumerate(self.spots)}

    def at(self, i: int) -> str:
        return self.toks[i].text if 0 <= i < len(self.toks) else ""

    def step(self, i: int, by: int = 1) -> int:
        """The next (or an earlier) token that is code; -1 or the end where there is none."""
        k = self.place[i] + by
        return -1 if k < 0 else self.spots[k] if k < len(self.spots) else len(self.toks)

    def find(self, i: int, stops: str) -> int:
        """The first of ``stops`` from token ``i`` on, outside round and square brackets."""
        while i < len(self.toks):
            t = self.toks[i]
            if t.kind == "mark" and t.text in stops:
                return i
            i = self.match.get(i, i) if t.kind == "mark" and t.text in "([" else i
            i += 1
        return len(self.toks) - 1

    def close(self, i: int) -> int:
        """The last token of a declaration whose body opens, or which ends, at ``i``."""
        return self.match.get(i, len(self.toks) - 1) if self.at(i) == "{" else i

    def lead(self, i: int) -> int:
        """The first line of a declaration at ``i``, with the comments and attributes right above it."""
        first = self.toks[i].line
        while i > 0 and i - 1 in self.silent and self.toks[i - 1].end + 1 >= first:
            i -= 1
            first = self.toks[i].line
        return first

    def read(self) -> UnitTree:
        self.walk(0, len(self.toks), self.top)
        return self.tree.finish()

    def walk(self, i: int, end: int, scope: Scope) -> None:
        while i < end:
            i = max(i + 1, self.visit(i, scope)) if i not in self.silent and self.toks[i].kind == "id" else i + 1

    def visit(self, i: int, scope: Scope) -> int:
        raise NotImplementedError


def camel(name: str) -> bool:
    return name[:1].isupper() and (len(name) == 1 or any(map(str.islower, name)))


class RustReader(TokenReader):
    pattern = re.compile(
        r"""(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)
        |(?P<attr>\#!?\[(?:[^\[\]]|\[[^\[\]]*\])*\])
        |(?P<text>b?r(?P<h>\#*)"(?s:.*?)"(?P=h)|b?"(?:\\(?s:.)|[^"\\])*"|b?'(?:\\[^\n]{1,10}?|[^'\\\n])'|'\w+|\d[\w.]*)
        |(?P<id>[^\W\d]\w*)
        |(?P<mark>::|->|=>|\S)""",
        re.X,
    )
    BEFORE = {"pub", "async", "unsafe", "const", "extern", "default"}
    NOT_TYPES = {"Self", "None", "Some", "Ok", "Err"}

    def head(self, i: int) -> int | None:
        """The first token of the declaration whose keyword is at ``i``; none if it is no declaration."""
        k = i
        while (p := self.step(k, -1)) >= 0:
            t = self.toks[p]
            if t.text in self.BEFORE or t.kind == "text" and self.at(self.step(p, -1)) == "extern":
                k = p
            elif t.text == ")" and p in self.match and (q := self.step(self.match[p], -1)) >= 0 and self.at(q) == "pub":
                k = q
            else:
                break
        before = self.step(k, -1)
        return k if before < 0 or self.at(before) in ("{", "}", ";") else None

    def visit(self, i: int, scope: Scope) -> int:
        word, after = self.at(i), self.step(i)
        if word in ("fn", "struct", "enum", "union", "type", "trait", "impl", "mod", "use", "macro_rules") and (head := self.head(i)) is not None:
            line = self.lead(head)
            if word == "use":
                stop = self.find(i, ";{")
                stop = self.find(stop, ";") if self.at(stop) == ";" else self.find(self.match.get(stop, stop), ";")
                for t in self.toks[i + 1 : stop]:
                    if t.kind == "id" and t.text not in ("crate", "self", "super", "as"):
                        self.tree.mention(scope.unit, t.text, "import", t.line)
                return stop + 1
            if word == "impl":
                return self.impl(i, line, scope)
            if word == "macro_rules":
                after = self.step(after)
            if after < len(self.toks) and self.toks[after].kind == "id":
                return self.declare(word, self.at(after), after, line, scope)
        nxt = self.at(after)
        if nxt == "!" and self.at(self.step(after)) in ("(", "[", "{") and word != "macro_rules":
            return self.match.get(self.step(after), after) + 1  # a macro's tokens are not parsed
        call = after if nxt == "(" else None
        if nxt == "::" and self.at(self.step(after)) == "<":  # turbofish
            g = self.past_angles(self.step(after))
            call = g if self.at(g) == "(" else None
        if call is not None and word not in ("fn", "if", "while", "match", "for", "in", "return", "loop", "let", "move", "pub", "where", "as", "else"):
            self.callee(i, word, scope)
        elif camel(word) and word not in self.NOT_TYPES and nxt not in ("::", "(", "!") and self.at(self.step(i, -1)) not in (".", "'"):
            self.tree.mention(scope.unit, word, "type", self.toks[i].line)
        return i + 1

    def declare(self, word: str, name: str, at: int, line: int, scope: Scope) -> int:
        stop = self.find(at, ";{" if word != "type" else ";")
        last = self.close(stop)
        if word == "struct" and self.at(stop) == "{" and self.at(self.step(at)) == "(":
            last = stop = self.find(at, ";")
        if word == "mod":
            if self.at(stop) == ";":
                self.tree.mention(scope.unit, name, "import", self.toks[at].line)
                return stop + 1
            unit = self.named(scope, name, "module", line, self.toks[last].end, f"mod {name}")
            inner = Scope(unit, unit, False, scope.owner)
        elif word == "fn":
            inner = self.function(scope, name, line, self.toks[last].end)
        else:
            unit = self.named(scope, name, "function" if word == "macro_rules" else "type", line, self.toks[last].end)
            inner = Scope(unit, unit, True, name) if word == "trait" else Scope(unit, unit, False, scope.owner, False)
        if word != "macro_rules":
            self.walk(at + 1, last, inner)
        return last + 1

    def past_angles(self, i: int) -> int:
        depth = 0
        while i < len(self.toks):
            depth += (self.at(i) == "<") - (self.at(i) == ">")
            i = self.step(i)
            if depth <= 0:
                break
        return i

    def type_name(self, toks: list[Token]) -> str:
        name = ""
        for t in toks:
            if t.text in ("<", "where"):
                break
            if t.kind == "id" and t.text not in ("mut", "dyn"):
                name = t.text
        return name

    def impl(self, i: int, line: int, scope: Scope) -> int:
        opened = self.find(i, "{;")
        k = self.step(i)
        if self.at(k) == "<":
            k = self.past_angles(k)
        head = [t for t in self.toks[k:opened] if t.kind in ("id", "mark")]
        depth, cut = 0, None
        for n, t in enumerate(head):
            depth += (t.text == "<") - (t.text == ">")
            if t.text == "for" and depth == 0 and (n + 1 >= len(head) or head[n + 1].text != "<"):
                cut = n
                break
        trait, kind = (self.type_name(head[:cut]), self.type_name(head[cut + 1 :])) if cut is not None else (None, self.type_name(head))
        label = f"impl {trait} for {kind}" if trait else f"impl {kind}"
        last = self.close(opened)
        unit = self.tree.add(scope.unit, f"{scope.prefix}::{label}", "impl", line, self.toks[last].end, label)
        for name in filter(None, (trait, kind)):
            self.tree.mention(unit, name, "type", self.toks[i].line)
        self.walk(opened + 1, last, Scope(unit, f"{scope.prefix}::{kind}", True, kind))
        return last + 1

    def callee(self, i: int, word: str, scope: Scope) -> None:
        before, name, kind = self.step(i, -1), word, "call"
        if self.at(before) == "fn" or not scope.calls:
            return
        if self.at(before) == ".":
            value = self.step(before, -1)
            own = scope.owner and self.at(value) == "self" and self.at(self.step(value, -1)) not in (".", "::")
            name, kind = (f"{scope.owner}::{word}", "call") if own else (word, "method")
        elif self.at(before) == "::":
            q = self.step(before, -1)
            if self.at(q) == ">":
                depth = 0
                while q > 0:
                    depth += (self.at(q) == ">") - (self.at(q) == "<")
                    q = self.step(q, -1)
                    if depth <= 0:
                        break
                q = self.step(q, -1) if self.at(q) == "::" else q
            base = self.at(q)
            if base == "Self":
                name = f"{scope.owner}::{word}" if scope.owner else word
            elif base[:1].isupper():
                name = f"{base}::{word}"
        self.tree.mention(scope.unit, name, kind, self.toks[i].line)


class JavaReader(TokenReader):
    pattern = re.compile(
        r"""(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)
        |(?P<text>\"{3}(?s:.*?)\"{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|\d[\w.]*)
        |(?P<id>[^\W\d][\w$]*)
        |(?P<mark>::|->|\S)""",
        re.X,
    )
    TYPES = {"class", "interface", "enum", "record"}
    NOT_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "super", "this", "return", "new", "try", "assert", "throw"}

    def start(self, i: int) -> int:
        """The first token of the declaration that ``i`` is in: what follows the last ; { or }."""
        while (p := self.step(i, -1)) >= 0 and self.at(p) not in (";", "{", "}"):
            i = self.match[p] if self.at(p) == ")" and p in self.match else p
        return i

    def visit(self, i: int, scope: Scope) -> int:
        word, after, before = self.at(i), self.step(i), self.step(i, -1)
        if word == "import" and self.at(before) in ("", ";", "}"):
            stop = self.find(i, ";")
            names = [t for t in self.toks[i + 1 : stop] if t.kind == "id" and t.text != "static"]
            if names:
                self.tree.mention(scope.unit, names[-1].text, "import", names[-1].line)
            return stop + 1
        if word == "package":
            return self.find(i, ";") + 1
        if word in self.TYPES and self.at(before) != "." and after < len(self.toks) and self.toks[after].kind == "id" and (word != "record" or self.at(self.step(after)) in ("(", "<")):
            opened = self.find(after, "{;")
            last = self.close(opened)
            name = self.at(after)
            unit = self.named(scope, name, "type", self.lead(self.start(i)), self.toks[last].end)
            self.walk(after + 1, last, Scope(unit, unit, True, name))
            return last + 1
        nxt = self.at(after)
        if nxt == "(":
            if scope.in_owner and self.declares(i, word, scope):
                opened = self.find(self.match.get(after, after) + 1, "{;")
                last = self.close(opened)
                label = f"{scope.prefix.rsplit('::', 1)[-1]}::{word}"
                unit = self.named(scope, word, "method", self.lead(self.start(i)), self.toks[last].end, label)
                self.walk(after + 1, last, Scope(unit, unit, False, scope.owner))
                return last + 1
            if self.at(before) == "new":
                self.tree.mention(scope.unit, word, "type", self.toks[i].line)
            elif word not in self.NOT_CALLS and self.at(before) != "@":
                away = self.at(before) == "." and self.at(self.step(before, -1)) != "this"
                self.tree.mention(scope.unit, word, "method" if away else "call", self.toks[i].line)
        elif camel(word) and nxt not in (".", "::") and self.at(before) not in (".", "@", "::"):
            self.tree.mention(scope.unit, word, "type", self.toks[i].line)
        return i + 1

    def declares(self, i: int, word: str, scope: Scope) -> bool:
        """Whether a name before round brackets in a type's body is a method or constructor being declared."""
        closed = self.match.get(self.step(i))
        if closed is None or self.at(self.step(closed)) not in ("{", ";", "throws", "default"):
            return False
        before = self.step(i, -1)
        t = self.toks[before] if before >= 0 else None
        if any(self.at(k) == "=" for k in range(self.start(i), i)):
            return False
        returns = t is not None and (t.kind == "id" and t.text not in ("new", "return") or t.text in (">", "]"))
        return returns or word == scope.owner
