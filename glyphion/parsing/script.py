"""A reader of JavaScript and TypeScript text: tokens, declarations, imports, exports and calls.

It reads syntax only, by one pass over tokens with a stack of open blocks; no compiler is at hand.
Calls inside template literals aren't seen, and types are skipped rather than understood.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

TOKEN = re.compile(
    r"(?P<blank>\s+)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<word>[A-Za-z_$#\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)|(?P<number>\d[\w.]*)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?)|(?P<sign>=>|\?\.|\.\.\.|[\s\S])"
)
REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}
OPEN, CLOSE = "([{", ")]}"
MODIFIERS = {"export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "readonly", "override", "accessor"}
CALL_NAMES_NOT = {"if", "for", "while", "switch", "catch", "return", "typeof", "function", "super", "import", "await", "new", "void", "delete", "in", "of", "with", "class", "do", "else", "throw", "yield", "case"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    match: int = -1  # index of the bracket that closes or opens this one


@dataclass
class Declaration:
    name: str
    kind: str
    start_line: int
    end_line: int
    column: int
    signature: str
    parent: int  # index among the declarations, or -1
    exported: bool
    first: int  # index of the first and last tokens
    last: int


class Script:
    def __init__(self, text: str):
        self.text = text
        self.lines = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
        self.tokens, self.broken = self._tokens()
        self.declarations: list[Declaration] = []
        self._block(0, len(self.tokens), -1, "file")

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def column(self, at: int) -> int:
        return at - self.lines[self.line(at) - 1] + 1

    def _template(self, at: int) -> int:
        """The end of the template literal that begins at this place."""
        i, text = at + 1, self.text
        while i < len(text):
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                return i + 1
            elif text.startswith("${", i):
                depth, i = 1, i + 2
                while i < len(text) and depth:
                    if text[i] == "`":
                        i = self._template(i)
                        continue
                    depth += (text[i] == "{") - (text[i] == "}")
                    i += 1
            else:
                i += 1
        return len(text)

    def _tokens(self) -> tuple[list[Token], bool]:
        out: list[Token] = []
        stack: list[int] = []
        at, broken = 0, False
        while at < len(self.text):
            before = out[-1] if out else None
            if self.text[at] == "`":
                end = self._template(at)
                out.append(Token("string", self.text[at:end], at, end))
                at = end
                continue
            if self.text[at] == "/" and (before is None or (before.kind == "sign" and before.text not in ")]}") or before.text in BEFORE_REGEX):
                m = REGEX.match(self.text, at)
                if m:
                    out.append(Token("regex", m[0], at, m.end()))
                    at = m.end()
                    continue
            m = TOKEN.match(self.text, at)
            if m.lastgroup not in ("blank", "comment"):
                out.append(Token(m.lastgroup, m[0], at, m.end()))
                if m[0] in OPEN:
                    stack.append(len(out) - 1)
                elif m[0] in CLOSE:
                    if stack and OPEN.index(out[stack[-1]].text) == CLOSE.index(m[0]):
                        out[-1].match = stack[-1]
                        out[stack.pop()].match = len(out) - 1
                    else:
                        broken = True
            at = m.end()
        for i in stack:
            out[i].match = len(out)
        return out, broken or bool(stack)

    def _is(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind in ("word", "sign") and self.tokens[i].text in texts

    def _name(self, i: int) -> str | None:
        if 0 <= i < len(self.tokens) and self.tokens[i].kind in ("word", "string", "number"):
            t = self.tokens[i].text
            return t[1:-1] if self.tokens[i].kind == "string" else t
        return None

    def _past(self, i: int, *stops: str, end: int) -> int:
        """The first token from i on, outside brackets, that is one of stops; else end."""
        while i < end:
            if self._is(i, *stops):
                return i
            t = self.tokens[i]
            i = t.match + 1 if t.text in OPEN and t.kind == "sign" and t.match > i else i + 1
        return end

    def _body(self, i: int, end: int) -> int:
        """The `{` of the body of what begins at i, or the end of a header without one."""
        at = i
        while at < end:
            if self._is(at, "{") and not self._is(at - 1, ":", "|", "&", "<", "="):
                return at
            if self._is(at, ";"):
                return at
            t = self.tokens[at]
            at = t.match + 1 if t.text in "([{" and t.kind == "sign" and t.match > at else at + 1
        return end

    def _add(self, name: str, kind: str, first: int, last: int, header_end: int, parent: int, exported: bool) -> int:
        last = min(max(last, first), len(self.tokens) - 1)
        a, b = self.tokens[first].start, self.tokens[last].end
        stop = self.tokens[header_end].start if header_end < len(self.tokens) else b
        signature = " ".join(self.text[a : max(a, min(stop, b))].split())[:300]
        self.declarations.append(Declaration(name, kind, self.line(a), self.line(b), self.column(a), signature, parent, exported, first, last))
        return len(self.declarations) - 1

    def _statement_start(self, i: int, low: int) -> bool:
        if i == low or self._is(i - 1, ";", "{", "}", ")") or self._is(i - 1, *MODIFIERS):
            return True
        a, b = self.tokens[i - 1], self.tokens[i]
        return self.line(a.end) < self.line(b.start) and not (a.kind == "sign" and a.text not in ")]}")

    def _block(self, i: int, end: int, parent: int, inside: str) -> None:
        """Declarations among the tokens i to end of a file, block or function body."""
        low, first, exported = i, -1, False
        while i < end:
            t = self.tokens[i]
            start = self._statement_start(i, low)
            if t.kind == "word" and start and t.text in MODIFIERS and not self._is(i + 1, "(", "=", ":", ",", "."):
                first = i if first < 0 else first
                exported = exported or t.text in ("export", "default")
                i += 1
                continue
            head = first if first >= 0 else i
            was_exported, first, exported = exported, -1, False
            if t.kind != "word" or not start:
                i += 1
            elif t.text == "function" and (self._name(i + 1 + self._is(i + 1, "*")) or was_exported):
                i = self._function(i, end, head, parent, was_exported)
            elif t.text == "class" and not self._is(i + 1, ":", "=", ".", ","):
                i = self._members_of(i, end, head, parent, was_exported, "class")
            elif t.text == "interface" and self._name(i + 1):
                i = self._members_of(i, end, head, parent, was_exported, "interface")
            elif t.text in ("enum", "namespace", "module") and self._name(i + 1) and not self._is(i + 1, "in", "of") and self._is(self._body(i + 2, end), "{"):
                body = self._body(i + 2, end)
                close = self.tokens[body].match
                me = self._add(self._name(i + 1), "enum" if t.text == "enum" else "namespace", head, close, body, parent, was_exported)
                if t.text != "enum":
                    self._block(body + 1, min(close, end), me, "block")
                i = close + 1
            elif t.text == "type" and self._name(i + 1) and self._is(self._past(i + 2, "=", ";", "(", end=end), "="):
                i = self._alias(i, end, head, parent, was_exported)
            elif t.text in ("const", "let", "var"):
                if t.text == "const" and self._is(i + 1, "enum"):
                    first, exported, i = head, was_exported, i + 1
                    low = i
                    continue
                i = self._variables(i + 1, end, parent, was_exported)
            else:
                i += 1

    def _function(self, i: int, end: int, head: int, parent: int, exported: bool) -> int:
        at = i + 1 + self._is(i + 1, "*")
        name = None if self._is(at, "(") else self._name(at)
        body = self._body(at + (name is not None), end)
        if self._is(body, "{"):
            close = self.tokens[body].match
            me = self._add(name or "default", "function", head, close, body, parent, exported)
            self._block(body + 1, min(close, end), me, "block")
            return close + 1
        self._add(name or "default", "function", head, body, body, parent, exported)
        return body + 1

    def _members_of(self, i: int, end: int, head: int, parent: int, exported: bool, kind: str) -> int:
        named = self._name(i + 1) if not self._is(i + 1, "extends", "implements", "{") else None
        body = self._body(i + 1, end)
        if not self._is(body, "{"):
            return body + 1
        close = self.tokens[body].match
        me = self._add(named or "default", kind, head, close, body, parent, exported)
        self._members(body + 1, min(close, end), me)
        return close + 1

    def _alias(self, i: int, end: int, head: int, parent: int, exported: bool) -> int:
        at = self._past(i + 2, "=", end=end)
        stop = at + 1
        while stop < end and not self._is(stop, ";"):
            t = self.tokens[stop]
            new_line = self.line(self.tokens[stop - 1].end) < self.line(t.start)
            if new_line and t.kind == "word" and not self._is(stop - 1, "|", "&", "=", "=>", ":", "?", ",") and t.text not in ("extends", "keyof", "typeof", "infer"):
                break
            stop = t.match + 1 if t.kind == "sign" and t.text in OPEN and t.match > stop else stop + 1
        last = stop if self._is(stop, ";") else stop - 1
        me = self._add(self._name(i + 1), "type", head, last, last + 1, parent, exported)
        for k in range(at + 1, min(stop, end)):
            if self._is(k, "{") and self.tokens[k].match < end and self._is(k - 1, "=", "&", "|", "<", "("):
                self._members(k + 1, self.tokens[k].match, me)
        return last + 1

    def _members(self, i: int, end: int, parent: int) -> None:
        """Methods and properties of a class or interface body."""
        while i < end:
            head = i
            while self._is(i, "@"):  # a decorator
                i += 2
                while self._is(i, ".", "("):
                    i = self.tokens[i].match + 1 if self._is(i, "(") else i + 2
            while self.tokens[i].text in MODIFIERS | {"get", "set", "*"} and i + 1 < end and not self._is(i + 1, "(", "=", ":", ";", "?", "!", "<", ","):
                i += 1
            name = self._name(i)
            if self._is(i, "["):
                close = self.tokens[i].match
                name, i = self.text[self.tokens[i].start : self.tokens[min(close, len(self.tokens) - 1)].end], close
            if name is None or i >= end:
                if self._is(i, "{") and self.tokens[i].match > i:
                    self._block(i + 1, min(self.tokens[i].match, end), parent, "block")  # a static block
                    i = self.tokens[i].match
                i += 1
                continue
            at = i + 1
            while self._is(at, "?", "!"):
                at += 1
            if self._is(at, "<"):
                at = self._past(at, "(", ";", "}", end=end)
            if self._is(at, "("):
                body = self._body(self.tokens[at].match + 1, end)
                after = self.tokens[at].match + 1
                ends = self._past(after, ";", ",", "{", end=end) if not self._is(after, ":") else body
                brace = body if self._is(body, "{") and self._is(ends, "{") else -1
                if brace < 0 and ends < end and self.line(self.tokens[after - 1].end) < self.line(self.tokens[min(after, end - 1)].start) and not self._is(after, ":"):
                    ends = after - 1
                if brace >= 0:
                    close = self.tokens[brace].match
                    me = self._add(name, "method", head, close, brace, parent, False)
                    self._block(brace + 1, min(close, end), me, "block")
                    i = close + 1
                else:
                    stop = min(ends, end)
                    self._add(name, "method", head, stop if self._is(stop, ";", ",") else stop - 1, stop, parent, False)
                    i = stop + 1
                continue
            stop = self._property_end(at, end)
            init = self._past(at, "=", end=stop)
            arrow = self._arrow(init + 1, stop) if init < stop else -1
            me = self._add(name, "method" if arrow >= 0 and not self._is(init + 1, "function") else "variable", head, stop - 1, init if init < stop else stop, parent, False)
            if arrow >= 0 and self._is(arrow, "{"):
                self._block(arrow + 1, min(self.tokens[arrow].match, stop), me, "block")
            i = stop + self._is(stop, ";", ",")

    def _property_end(self, i: int, end: int) -> int:
        while i < end:
            if self._is(i, ";", ","):
                return i
            t = self.tokens[i]
            if i > 0 and t.kind in ("word", "string") and self.line(self.tokens[i - 1].end) < self.line(t.start) and not (self.tokens[i - 1].kind == "sign" and self.tokens[i - 1].text not in ")]}"):
                return i
            i = t.match + 1 if t.kind == "sign" and t.text in OPEN and t.match > i else i + 1
        return end

    def _arrow(self, i: int, end: int) -> int:
        """The first token of the body of a function expression that begins at i, or -1."""
        i += self._is(i, "async")
        if self._is(i, "function"):
            body = self._body(i + 1, end)
            return body if self._is(body, "{") else -1
        if self._is(i, "<"):
            i = self._past(i, "(", end=end)
        if self._is(i, "("):
            at = self.tokens[i].match + 1
            if self._is(at, ":"):
                at = self._past(at, "=>", ";", ",", "=", end=end)
            return at + 1 if self._is(at, "=>") else -1
        return i + 2 if self._name(i) and self._is(i + 1, "=>") else -1

    def _variables(self, i: int, end: int, parent: int, exported: bool) -> int:
        while i < end:
            head, name = i, self._name(i) if self.tokens[i].kind == "word" else None
            if self._is(i, "{", "["):
                i = self.tokens[i].match
            at = self._past(i + 1, "=", ",", ";", "of", "in", end=self._property_end(i + 1, end) if not self._is(i + 1, "=", ":") else end)
            stop = at
            if self._is(at, "="):
                stop = self._initializer_end(at + 1, end)
                arrow = self._arrow(at + 1, stop)
            else:
                arrow = -1
            if name:
                stop_of_header = arrow if arrow >= 0 else at + 1 if self._is(at, "=") else stop
                me = self._add(name, "function" if arrow >= 0 else "variable", head, stop - 1, stop_of_header, parent, exported)
                if arrow >= 0 and self._is(arrow, "{"):
                    self._block(arrow + 1, min(self.tokens[arrow].match, stop), me, "block")
                    stop = max(stop, min(self.tokens[arrow].match + 1, end))
            if not self._is(stop, ","):
                return stop
            i = stop + 1
        return end

    def _initializer_end(self, i: int, end: int) -> int:
        low = i
        while i < end:
            if self._is(i, ";", ","):
                return i
            t, before = self.tokens[i], self.tokens[i - 1]
            joins = before.kind == "sign" and before.text not in ")]}" or before.text in BEFORE_REGEX
            if i > low and t.kind in ("word", "string") and self.line(before.end) < self.line(t.start) and not joins and t.text not in ("instanceof", "in", "as", "satisfies"):
                return i
            i = t.match + 1 if t.kind == "sign" and t.text in OPEN and t.match > i else i + 1
        return end

    # --- what the parsers of imports, exports, chunks and graphs ask for ---------------------------

    def imports(self) -> list[tuple[str, list[str] | None, str, int, list[tuple[str, str]]]]:
        """specifier, names or None, type, token index, bindings (local name, original name or '*')."""
        out = []
        for i, t in enumerate(self.tokens):
            if t.kind != "word" or self._is(i - 1, ".", "?."):
                continue
            if t.text in ("import", "require") and self._is(i + 1, "(") and i + 2 < len(self.tokens) and self.tokens[i + 2].kind == "string" and self.tokens[i + 2].text[0] != "`":
                bound = [(self._name(i - 2), "*")] if t.text == "require" and self._is(i - 1, "=") and i > 1 and self.tokens[i - 2].kind == "word" else []
                out.append((self._name(i + 2), None, "dynamic" if t.text == "import" else "require", i, bound))
            elif t.text in ("import", "export") and self._statement_start(i, 0):
                found = self._clause(i)
                if found:
                    out.append(found)
        return out

    def _clause(self, i: int):
        at = i + 1
        typed = self._is(at, "type") and not self._is(at + 1, "from", ",", "=")
        at += typed
        names: list[str] | None = None
        bound: list[tuple[str, str]] = []
        export = self.tokens[i].text == "export"
        if not export and at < len(self.tokens) and self.tokens[at].kind == "string":
            return self._name(at), None, "static", i, bound
        if not export and at < len(self.tokens) and self.tokens[at].kind == "word":
            names, bound = ["default"], [(self.tokens[at].text, "default")]
            at += 1 + self._is(at + 1, ",")
        if self._is(at, "*"):
            if self._is(at + 1, "as"):
                bound.append((self._name(at + 2) or "", "*"))
                at += 2
            at += 1
        elif self._is(at, "{"):
            names = (names or []) + [original for original, _, _ in self._listed(at)]
            bound += [(local, original) for original, local, _ in self._listed(at)]
            at = self.tokens[at].match + 1
        if self._is(at, "from") and at + 1 < len(self.tokens) and self.tokens[at + 1].kind == "string":
            return self._name(at + 1), names, "type-only" if typed else "static", i, [] if export else bound
        return None

    def _listed(self, at: int) -> list[tuple[str, str, bool]]:
        """(name, name after `as`, type only) of a list in braces."""
        out, k, end = [], at + 1, min(self.tokens[at].match, len(self.tokens))
        while k < end:
            typed = self._is(k, "type") and not self._is(k + 1, ",", "}", "as") and k + 1 < end
            k += typed
            name = self._name(k)
            if name is not None:
                out.append((name, self._name(k + 2) if self._is(k + 1, "as") else name, typed))
            k = self._past(k, ",", end=end) + 1
        return out

    def exports(self) -> list[tuple[str, str, int]]:
        """name, type, line of the exports at the file's top level."""
        out, depth_end = [], -1
        for i, t in enumerate(self.tokens):
            if i <= depth_end:
                continue
            if t.kind == "sign" and t.text in OPEN and t.match > i:
                depth_end = t.match
                continue
            if t.kind != "word" or t.text != "export" or not self._statement_start(i, 0):
                continue
            line, at = self.line(t.start), i + 1
            typed = self._is(at, "type") and self._is(at + 1, "{", "*")
            if self._is(at, "default"):
                out.append(("default", "default", line))
            elif self._is(at + typed, "{"):
                out += [(as_, "type" if typed or of else "variable", line) for _, as_, of in self._listed(at + typed)]
            elif not self._is(at + typed, "*", "="):
                for d in self.declarations:
                    if d.parent == -1 and d.exported and self._belongs(d, i):
                        kind = "variable" if self._is_variable(i) else d.kind
                        if kind in ("function", "class", "type", "interface", "enum", "variable"):
                            out.append((d.name, kind, line))
        return out

    def _is_variable(self, i: int) -> bool:
        at = i + 1 + self._is(i + 1, "declare")
        return self._is(at, "const", "let", "var") and not self._is(at + 1, "enum")

    def _belongs(self, d: Declaration, i: int) -> bool:
        if d.first == i:
            return True
        if not self._is_variable(i) or d.first < i:
            return False
        k = i + 1
        while k < d.first:
            if self._is(k, ";") or (self._is(k, "export") and k > i):
                return False
            t = self.tokens[k]
            k = t.match + 1 if t.kind == "sign" and t.text in OPEN and t.match > k else k + 1
        return True

    def calls(self) -> list[tuple[str, str, int]]:
        """receiver ('' if none), name, token index of each call of a name."""
        names = {d.first for d in self.declarations}
        heads = set()
        for d in self.declarations:
            if d.kind in ("function", "method"):
                k = d.first
                while k <= d.last and not self._is(k, "("):
                    k += 1
                heads.add(k - 1)
        out = []
        for i, t in enumerate(self.tokens):
            if t.kind == "word" and t.text not in CALL_NAMES_NOT and i not in heads and i not in names | {-1} and self._is(i + 1, "("):
                dotted = self._is(i - 1, ".", "?.")
                out.append(((self._name(i - 2) or "?") if dotted and not self._is(i - 3, ".", "?.") else "?" if dotted else "", t.text, i))
            elif t.kind == "word" and i in names and self._is(i + 1, "(") and t.text not in CALL_NAMES_NOT and not any(d.first == i and d.kind in ("function", "method") for d in self.declarations):
                out.append(("", t.text, i))
        return out

    def owner(self, i: int) -> int:
        """The innermost declaration that isn't a variable around token i; -1 for the file."""
        best = -1
        for k, d in enumerate(self.declarations):
            if d.kind != "variable" and d.first <= i <= d.last and (best < 0 or d.first >= self.declarations[best].first):
                best = k
        return best


def chunk_ranges(text: str, most: int) -> list[tuple[int, int]] | None:
    """Line ranges that cover the file and break before top-level declarations; None where brackets don't match.

    Comments before a declaration stay with it; classes and interfaces longer than `most` lines
    also break before members, and longer runs every `most` lines.
    """
    s = Script(text)
    if s.broken:
        return None
    total = text.count("\n") + 1
    cuts = {1, total + 1}
    for k, d in enumerate(s.declarations):
        if d.parent >= 0 or d.kind == "variable":
            continue
        first = d.first
        while first > 0 and s.tokens[first - 1].text in MODIFIERS | {"const", "let", "var", "@"} and s.line(s.tokens[first - 1].start) == s.line(s.tokens[first].start):
            first -= 1
        low = s.tokens[first - 1].end if first else 0
        between = text[low : s.tokens[first].start]
        begins = low + len(between) - len(between.lstrip())
        if first and "\n" in between and text[low:begins].count("\n") == 0:  # a comment that ends the line of the statement before
            rest = between.find("\n")
            begins = low + rest + len(between[rest:]) - len(between[rest:].lstrip())
        start = s.line(begins)
        if start > 1:
            cuts.add(start)
        if d.end_line - start + 1 > most and d.kind in ("class", "interface"):
            cuts |= {m.start_line for m in s.declarations if m.parent == k and m.start_line > start}
    marks = sorted(cuts)
    return [(a, min(a + most - 1, hi - 1)) for lo, hi in zip(marks, marks[1:]) for a in range(lo, hi, most)]
