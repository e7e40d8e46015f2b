"""What one source file declares, imports and uses, in one form for all languages of the symbol graph.

Names are resolved within the file here, by scope; what an import or package binds is left as a
request (module, parent, name) that the graph's joins answer.
"""

from __future__ import annotations

import ast
import posixpath
import re
from dataclasses import dataclass, field

from glyphion.parsing.script import Script

SELF = {"self", "this", "$this", "cls", "Self"}
CALLABLE = {"function", "method", "class"}


@dataclass
class Node:
    name: str
    kind: str
    start_line: int
    end_line: int
    column: int
    parent: int  # index among the nodes, -1 for the file
    signature: str
    exported: bool
    start: int = 0
    end: int = 0


@dataclass
class Use:
    """call: else a plain reference. target: a node of this file, or -1. A request: module and the name sought in it."""

    owner: int
    name: str
    line: int
    column: int
    call: bool
    target: int = -1
    module: str | None = None
    want_parent: str | None = None
    want_name: str | None = None


@dataclass
class Import:
    module: str
    line: int
    column: int
    names: list[str] | None
    kind: str
    bindings: list[tuple[str, str]]  # local name; original name, or * for the module itself


@dataclass
class Unit:
    language: str
    nodes: list[Node] = field(default_factory=list)
    uses: list[Use] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    namespace: str = ""

    def children(self, parent: int, name: str) -> list[int]:
        return [k for k, n in enumerate(self.nodes) if n.parent == parent and n.name == name]

    def bound(self, name: str) -> tuple[str, str] | None:
        """The module and original name (or *) that an import binds to a local name."""
        for i in self.imports:
            for local, original in i.bindings:
                if local == name:
                    return i.module, original
        return None


def _only(found: list[int]) -> int:
    return found[0] if len(found) == 1 else -1


def resolve(unit: Unit, use: Use, receiver: str, shadow: dict[int, set[str]], skip_classes: bool) -> None:
    """Fills in the target or the request of a use, from its owner's scopes outwards and then the imports."""
    nodes, name = unit.nodes, use.name
    if receiver in SELF:
        scope = use.owner
        while scope >= 0 and nodes[scope].kind not in ("class", "interface"):
            scope = nodes[scope].parent
        if scope >= 0:
            use.target = _only(unit.children(scope, name))
        return
    if receiver:
        local = _lexical(unit, use.owner, receiver, shadow, skip_classes)
        if local == -2:
            return
        if local >= 0:
            if nodes[local].kind in ("class", "namespace", "interface"):
                use.target = _only(unit.children(local, name))
            return
        found = unit.bound(receiver)
        if found:
            module, original = found
            use.module, use.want_name = module, name
            use.want_parent = None if original == "*" else original
        return
    local = _lexical(unit, use.owner, name, shadow, skip_classes)
    if local == -2:
        return
    if local >= 0:
        use.target = local
        return
    found = unit.bound(name)
    if found:
        if found[1] != "*":
            use.module, use.want_name = found
    elif unit.language in ("c", "cpp"):
        use.module, use.want_name = "*", name
    elif unit.language == "go":
        use.module, use.want_name = ".", name


def _lexical(unit: Unit, owner: int, name: str, shadow: dict[int, set[str]], skip_classes: bool) -> int:
    """The node that a name means from an owner's scope; -1 if none does, -2 if a variable or several nodes have the name."""
    scope = owner
    while True:
        if not (skip_classes and scope >= 0 and unit.nodes[scope].kind in ("class", "interface")):
            found = unit.children(scope, name)
            if scope == -1 and unit.language != "ruby":
                found = [k for k in found if unit.nodes[k].kind != "method"]
            if found:
                return found[0] if len(found) == 1 else -2
        if name in shadow.get(scope, ()):
            return -2
        if scope == -1:
            return -1
        scope = unit.nodes[scope].parent


def _finish(unit: Unit, raw: list[tuple[Use, str]], shadow: dict[int, set[str]], skip_classes: bool = False) -> Unit:
    for use, receiver in raw:
        if receiver != "?":
            resolve(unit, use, receiver, shadow, skip_classes)
        if use.target >= 0 and use.call and unit.nodes[use.target].kind not in CALLABLE:
            use.target = -1
        if use.call or use.target >= 0 or use.module:
            unit.uses.append(use)
    return unit


# --- Python, by its own parser -------------------------------------------------------------------


class _Python(ast.NodeVisitor):
    def __init__(self, text: str, unit: Unit):
        self.lines, self.unit, self.scope = text.split("\n"), unit, -1
        self.raw: list[tuple[Use, str]] = []
        self.shadow: dict[int, set[str]] = {}

    def _column(self, node) -> int:
        return len(self.lines[node.lineno - 1].encode()[: node.col_offset].decode("utf-8", "replace")) + 1 if node.lineno <= len(self.lines) else 1

    def _declare(self, node, kind: str) -> None:
        if kind == "function" and self.scope >= 0 and self.unit.nodes[self.scope].kind == "class":
            kind = "method"
        body = node.body[0].lineno
        head = self.lines[node.lineno - 1 : max(node.lineno, body - 1)]
        signature = "\n".join(head).strip()[:1000] if body > node.lineno else self.lines[node.lineno - 1].strip()[:1000]
        self.unit.nodes.append(Node(node.name, kind, node.lineno, node.end_lineno, self._column(node), self.scope, signature, not node.name.startswith("_")))
        for d in node.decorator_list:
            self.visit(d)
        outer, self.scope = self.scope, len(self.unit.nodes) - 1
        if kind != "class":
            a = node.args
            self.shadow.setdefault(self.scope, set()).update(x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))))
            for default in (*a.defaults, *filter(None, a.kw_defaults)):
                self.visit(default)
        else:
            for base in (*node.bases, *node.keywords):
                self.visit(base)
        for statement in node.body:
            self.visit(statement)
        self.scope = outer

    def visit_FunctionDef(self, node):
        self._declare(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        self._declare(node, "class")

    def visit_Import(self, node):
        for a in node.names:
            self.unit.imports.append(Import(a.name, node.lineno, self._column(node), None, "static", [(a.asname or a.name.split(".")[0], "*")]))

    def visit_ImportFrom(self, node):
        module = "." * node.level + (node.module or "")
        self.unit.imports.append(Import(module, node.lineno, self._column(node), [a.name for a in node.names], "static", [(a.asname or a.name, a.name) for a in node.names]))

    def visit_Call(self, node):
        f = node.func
        if isinstance(f, ast.Name):
            self.raw.append((Use(self.scope, f.id, f.lineno, self._column(f), True), ""))
        elif isinstance(f, ast.Attribute):
            receiver = f.value.id if isinstance(f.value, ast.Name) else "?"
            self.raw.append((Use(self.scope, f.attr, f.end_lineno, self._column(f), True), receiver))
            self.visit(f.value)
        else:
            self.visit(f)
        for x in (*node.args, *node.keywords):
            self.visit(x)

    def visit_Name(self, node):
        if isinstance(node.ctx, ast.Store):
            self.shadow.setdefault(self.scope, set()).add(node.id)
        else:
            self.raw.append((Use(self.scope, node.id, node.lineno, self._column(node), False), ""))


def _python(text: str) -> Unit:
    unit = Unit("python")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        unit.warnings.append(f"syntax error: {getattr(e, 'msg', None) or 'too deep'}")
        return unit
    visitor = _Python(text, unit)
    visitor.visit(tree)
    return _finish(unit, visitor.raw, visitor.shadow, skip_classes=True)


# --- the JavaScript family -----------------------------------------------------------------------


def _script(text: str) -> Unit:
    s = Script(text)
    unit = Unit("script")
    if s.broken:
        unit.warnings.append("syntax error: brackets don't match")
    for d in s.declarations:
        unit.nodes.append(Node(d.name, d.kind, d.start_line, d.end_line, d.column, d.parent, d.signature, d.exported))
    for module, names, kind, at, bindings in s.imports():
        t = s.tokens[at]
        unit.imports.append(Import(module, s.line(t.start), s.column(t.start), names, kind, bindings))
    raw, called = [], set()
    for receiver, name, at in s.calls():
        t = s.tokens[at]
        called.add(at)
        raw.append((Use(s.owner(at), name, s.line(t.start), s.column(t.start), True), receiver))
    known = {n.name for n in unit.nodes} | {b[0] for i in unit.imports for b in i.bindings}
    heads = {k for d in s.declarations for k in range(d.first, min(d.first + 4, d.last + 1)) if s.tokens[k].text == d.name}
    listed = {k for _, _, _, at, _ in s.imports() for k in range(at, at + 40) if k < len(s.tokens) and s.line(s.tokens[k].start) <= s.line(s.tokens[at].start) and s.tokens[at].text in ("import", "export")}
    for at, t in enumerate(s.tokens):
        if t.kind == "word" and t.text in known and at not in called | heads | listed and not (at and s.tokens[at - 1].text in (".", "?.")) and not (at + 1 < len(s.tokens) and s.tokens[at + 1].text == ":"):
            raw.append((Use(s.owner(at), t.text, s.line(t.start), s.column(t.start), False), ""))
    shadow: dict[int, set[str]] = {}
    for k, d in enumerate(s.declarations):
        if d.kind in ("function", "method"):
            head = re.search(r"\((.*)\)", d.signature)
            shadow[k] = set(re.findall(r"(?:^|[,{(])\s*(?:\.\.\.)?([A-Za-z_$][\w$]*)", head[1])) if head else set()
    return _finish(unit, raw, shadow)


# --- languages with braces or `end`, by patterns over text without comments and strings -----------

_COMMENTS = {
    "ruby": r"#[^\n]*", "lua": r"--\[\[[\s\S]*?\]\]|--[^\n]*", "php": r"//[^\n]*|/\*[\s\S]*?\*/|\#(?!\[)[^\n]*",
}
_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_RUST_CHAR = r"\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\\n]|\\.[^'\n]*)'"
_WORDS = {"if", "for", "while", "switch", "catch", "return", "sizeof", "new", "else", "do", "match", "when", "guard", "elseif", "foreach", "using", "lock", "fixed", "throw", "function", "fun", "fn", "func", "def", "and", "or", "not", "in", "super", "until", "unless", "case", "typeof", "echo", "print", "defined", "init", "constructor"}
_TYPED = r"(?:^|(?<=[;{}]))\s*(?:(?:[A-Za-z_][\w<>\[\],.?:*&~]*|@\w+(?:\([^)]*\))?)[\s*&]+)+?(?:(?P<scope>\w+(?:::\w+)*)::)?(?P<name>~?\w+)\s*\((?P<args>[^;{}]*?)\)[\w\s,.:()]*?(?=\{|;|=>)"
_CLASSES = r"\b(?P<word>class|interface|enum|record|struct|object|trait|protocol)\s+(?:class\s+|struct\s+)?(?P<name>[A-Za-z_]\w*)"
_KIND = {"interface": "interface", "trait": "interface", "protocol": "interface", "enum": "enum"}
#: Patterns of declarations by language: kind (None: by the word matched) and expression.
DECLARATIONS: dict[str, list[tuple[str | None, str]]] = {
    "php": [("function", r"\bfunction\s+&?(?P<name>\w+)\s*\((?P<args>[^{};]*)\)"), (None, _CLASSES)],
    "go": [("function", r"^func\s*(?:\(\s*(?P<receiver>\w+)\s+\*?(?P<scope>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\((?P<args>[^{};]*?)\)"), ("class", r"^type\s+(?P<name>\w+)\s+struct\b"), ("interface", r"^type\s+(?P<name>\w+)\s+interface\b"), ("type", r"^type\s+(?P<name>\w+)\s+(?!struct\b|interface\b)")],
    "java": [(None, _CLASSES), ("typed", _TYPED)],
    "csharp": [(None, _CLASSES), ("namespace", r"\bnamespace\s+(?P<name>[\w.]+)"), ("typed", _TYPED)],
    "c": [(None, r"\b(?P<word>struct|enum)\s+(?P<name>\w+)\s*(?=\{)"), ("typed", _TYPED)],
    "cpp": [(None, r"\b(?P<word>class|struct|enum)\s+(?:class\s+)?(?P<name>\w+)[^;{}()]*(?=\{)"), ("namespace", r"\bnamespace\s+(?P<name>\w+)\s*(?=\{)"), ("typed", _TYPED)],
    "rust": [("function", r"\bfn\s+(?P<name>\w+)\s*(?:<[^>]*>)?\s*\((?P<args>[^{};]*?)\)"), (None, r"\b(?P<word>struct|enum|trait)\s+(?P<name>\w+)"), ("namespace", r"\bmod\s+(?P<name>\w+)"), ("type", r"\btype\s+(?P<name>\w+)")],
    "ruby": [("function", r"\bdef\s+(?:self\.)?(?P<name>\w+[?!=]?)(?:\s*\((?P<args>[^)]*)\))?"), ("class", r"^\s*class\s+(?:\w+::)*(?P<name>\w+)"), ("namespace", r"^\s*module\s+(?:\w+::)*(?P<name>\w+)")],
    "kotlin": [("function", r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(?P<name>\w+)\s*\((?P<args>[^{}=]*?)\)"), (None, _CLASSES)],
    "swift": [("function", r"\bfunc\s+(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<args>[^{}]*?)\)"), (None, _CLASSES)],
    "scala": [("function", r"\bdef\s+(?P<name>\w+)(?:\[[^\]]*\])?(?:\((?P<args>[^{}=]*?)\))?"), (None, _CLASSES)],
    "lua": [("function", r"\bfunction\s+(?:\w+[.:])?(?P<name>\w+)\s*\((?P<args>[^)]*)\)"), ("function", r"\blocal\s+function\s+(?P<name>\w+)\s*\((?P<args>[^)]*)\)")],
}
#: Import statements by language: module, local name, alias.
IMPORTS = {
    "go": r"^\s*(?:import\s+)?(?P<alias>\w+\s+)?\"(?P<module>[^\"\n]+)\"\s*$",
    "java": r"^\s*import\s+(?:static\s+)?(?P<module>[\w.]+)\s*;?", "kotlin": r"^\s*import\s+(?P<module>[\w.]+)(?:\s+as\s+(?P<alias>\w+))?",
    "scala": r"^\s*import\s+(?P<module>[\w.]+)", "csharp": r"^\s*using\s+(?:static\s+)?(?P<module>[\w.]+)\s*;",
    "php": r"\buse\s+(?:function\s+|const\s+)?(?P<module>[\w\\]+)(?:\s+as\s+(?P<alias>\w+))?\s*;", "rust": r"\buse\s+(?P<module>[\w:]+)(?:\s+as\s+(?P<alias>\w+))?\s*;",
    "c": r"^\s*#\s*include\s+[\"<](?P<module>[^\">\n]+)[\">]", "cpp": r"^\s*#\s*include\s+[\"<](?P<module>[^\">\n]+)[\">]",
    "ruby": r"^\s*require(?:_relative)?\s*\(?\s*[\"'](?P<module>[^\"'\n]+)[\"']", "swift": r"^\s*import\s+(?P<module>[\w.]+)", "lua": r"\brequire\s*\(?\s*[\"'](?P<module>[^\"'\n]+)[\"']",
}
NAMESPACE = {"java": r"^\s*package\s+([\w.]+)", "kotlin": r"^\s*package\s+([\w.]+)", "scala": r"^\s*package\s+([\w.]+)", "go": r"^\s*package\s+(\w+)", "php": r"\bnamespace\s+([\w\\]+)\s*;", "csharp": r"^\s*namespace\s+([\w.]+)\s*;"}


def _blanked(text: str, language: str) -> str:
    """The text with comments and quoted strings as blanks, at equal places."""
    quoted = _RUST_CHAR if language in ("rust", "swift", "kotlin") else r"`[^`]*`|" + _QUOTED if language == "go" else r"\"\"\"[\s\S]*?\"\"\"|" + _QUOTED
    pattern = _COMMENTS.get(language, r"//[^\n]*|/\*[\s\S]*?\*/") + "|" + quoted
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _pairs(clean: str) -> dict[int, int]:
    """Where the brace that is opened at a place is closed."""
    out, stack = {}, []
    for m in re.finditer(r"[{}]", clean):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.end()
    return out | {a: len(clean) for a in stack}


def _end_of(clean: str, at: int, language: str, pairs: dict[int, int]) -> tuple[int, int]:
    """Where the header and the whole of a declaration end whose pattern matched up to `at`."""
    if language in ("ruby", "lua"):
        openers = r"^\s*(?:def|class|module|if|unless|while|until|case|begin|for)\b|\bdo\b" if language == "ruby" else r"\b(?:function|if|do|repeat)\b"
        line = clean.find("\n", at)
        depth = 1
        for m in re.finditer(rf"{openers}|\b(?:end|until)\b" if language == "lua" else rf"{openers}|\bend\b", clean[at:], re.M):
            word = m[0].strip()
            if word in ("end", "until") and not (language == "ruby" and word == "until"):
                depth -= 1
                if depth == 0:
                    return (line if line >= 0 else len(clean)), at + m.end()
            elif not (language == "ruby" and word == "do" and re.match(r"\s*(?:while|until|for)\b", clean[clean.rfind("\n", 0, at + m.start()) + 1 :])):
                depth += 1
        return (line if line >= 0 else len(clean)), len(clean)
    depth = 0
    for k in range(at, len(clean)):
        c = clean[k]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth <= 0 and c == "{":
            return k, pairs[k]
        elif depth <= 0 and c == ";":
            return k, k + 1
        elif depth <= 0 and c == "=" and language in ("kotlin", "scala", "csharp"):
            rest = re.compile(r"=>?\s*\{").match(clean, k)
            if rest:
                return k, pairs[rest.end() - 1]
            stop = clean.find("\n", k)
            return k, stop if stop >= 0 else len(clean)
        elif depth <= 0 and c == "\n" and language in ("kotlin", "scala", "swift", "go") and not re.match(r"\s*[{=:]|\s*where\b", clean[k:]):
            return k, k
    return len(clean), len(clean)


def _patterned(text: str, language: str) -> Unit:
    unit, clean = Unit(language), _blanked(text, language)
    pairs = _pairs(clean)
    starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def place(at: int) -> tuple[int, int]:
        line = clean.count("\n", 0, at) + 1
        return line, at - starts[line - 1] + 1

    found: dict[int, tuple[Node, re.Match]] = {}
    for kind, pattern in DECLARATIONS[language]:
        for m in re.finditer(pattern, clean, re.M):
            name, word = m["name"], m.groupdict().get("word")
            if name in _WORDS or (kind == "typed" and re.search(r"(?:^|\s)(?:return|new|else|throw|case|goto|await|yield|delete)\s", m[0][: m.start("name") - m.start()] + " ")):
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            head, end = _end_of(clean, m.end(), language, pairs)
            if kind == "typed" and clean[head : head + 1] == ";" and language in ("java", "csharp") and "=" in clean[m.end() : head]:
                continue
            own = "function" if kind == "typed" else kind or _KIND.get(word, "class")
            line, column = place(start)
            node = Node(name, own, line, place(max(start, end - 1))[0], column, -1, text[start:head].strip()[:1000], not name.startswith("_"), start, end)
            found.setdefault(m.start("name"), (node, m))
    order = sorted(found.values(), key=lambda x: (x[0].start, -x[0].end))
    unit.nodes = [n for n, _ in order]
    open_: list[int] = []
    for k, node in enumerate(unit.nodes):
        while open_ and unit.nodes[open_[-1]].end <= node.start:
            open_.pop()
        node.parent = open_[-1] if open_ else -1
        open_.append(k)
    typed = {id(n) for n, m in order if m.groupdict().get("args") is not None}
    dropped = {id(n) for n in unit.nodes if id(n) in typed and language in ("java", "csharp", "c", "cpp") and n.parent >= 0 and unit.nodes[n.parent].kind == "function"}
    if dropped:  # calls inside a body that look like prototypes
        keep = [k for k, n in enumerate(unit.nodes) if id(n) not in dropped]
        again = {k: i for i, k in enumerate(keep)}
        order = [order[k] for k in keep]
        for n, _ in order:
            while n.parent >= 0 and n.parent not in again:
                n.parent = unit.nodes[n.parent].parent
            n.parent = again.get(n.parent, -1)
        unit.nodes = [n for n, _ in order]
    shadow: dict[int, set[str]] = {}
    receivers: dict[int, tuple[str, str]] = {}
    for k, (node, m) in enumerate(order):
        groups = m.groupdict()
        if node.kind == "function" and node.parent >= 0 and unit.nodes[node.parent].kind in ("class", "interface"):
            node.kind = "method"
        if groups.get("scope"):
            types = [i for i, n in enumerate(unit.nodes) if n.kind == "class" and n.name == groups["scope"].split("::")[-1]]
            node.kind = "method"
            if len(types) == 1:
                node.parent = types[0]
            if groups.get("receiver"):
                receivers[k] = (groups["receiver"], groups["scope"])
        words = re.findall(r"\$?([A-Za-z_]\w*)\s*(?=[,:=)]|$)|(?:^|,)\s*([A-Za-z_]\w*)", groups.get("args") or "")
        shadow[k] = {a or b for a, b in words} - ({n.name for n in unit.nodes if n.kind == "class"} if language in ("java", "csharp", "cpp") else set())
    owners = sorted(range(len(unit.nodes)), key=lambda k: unit.nodes[k].start)

    def owner(at: int) -> int:
        best = -1
        for k in owners:
            n = unit.nodes[k]
            if n.start > at:
                break
            if at < n.end and (best < 0 or n.start >= unit.nodes[best].start):
                best = k
        return best

    for m in re.finditer(r"\b(?:let\s+(?:mut\s+)?|var\s+|val\s+|local\s+)?\$?([A-Za-z_]\w*)\s*:?=(?![=>])", clean):
        shadow.setdefault(owner(m.start(1)), set()).add(m[1])
    shadow = {k: v - {n.name for n in unit.nodes if n.parent == k} for k, v in shadow.items()}
    if language in NAMESPACE:
        m = re.search(NAMESPACE[language], clean, re.M)
        unit.namespace = m[1].replace("\\", ".") if m else ""
    source = text if language in ("go", "c", "cpp", "ruby", "lua") else clean
    for m in re.finditer(IMPORTS[language], source, re.M):
        if language == "go" and not m[0].lstrip().startswith("import") and not re.search(r"import\s*\([^)]*$", source[: m.start()]):
            continue
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        line, column = place(at)
        module, alias = m["module"], (m.groupdict().get("alias") or "").strip()
        last = [x for x in re.split(r"[./\\:]", module) if x][-1:] or [module]
        whole = language in ("go", "c", "cpp", "ruby", "lua", "swift", "csharp")
        unit.imports.append(Import(module, line, column, None, "static", [] if language in ("c", "cpp") else [(alias or last[0], "*" if whole else last[0])]))
    named = set(found)
    raw: list[tuple[Use, str]] = []
    called = set()
    for m in re.finditer(r"(?:(?P<receiver>\$?\w+|[)\]])\s*(?:\?\.|\.|->|::)\s*)?(?P<name>[A-Za-z_]\w*[?!]?)\s*\(", clean):
        at, name = m.start("name"), m["name"]
        called.add(at)
        if at in named or name in _WORDS or (m["receiver"] or "") in ("fn", "func", "def"):
            continue
        receiver = m["receiver"] or ""
        if receiver and not re.fullmatch(r"\$?\w+", receiver) or re.search(r"(?:\.|->|::)\s*$", clean[max(0, m.start() - 3) : m.start()]):
            receiver = "?"
        line, column = place(at)
        mine = owner(at)
        if mine in receivers and receivers[mine][0] == receiver:
            receiver = "self"
        raw.append((Use(mine, name, line, column, True), receiver))
    known = {n.name for n in unit.nodes} | {b[0] for i in unit.imports for b in i.bindings}
    spans = [(m.start(), m.end()) for m in re.finditer(IMPORTS[language], source, re.M)]
    for m in re.finditer(r"(?<![\w$.>:\\])[A-Za-z_]\w*(?!\w|\s*\()", clean):
        if m[0] in known and m.start() not in named | called and not any(a <= m.start() < b for a, b in spans):
            line, column = place(m.start())
            raw.append((Use(owner(m.start()), m[0], line, column, False), ""))
    return _finish(unit, raw, shadow, skip_classes=language == "php")


def parse(text: str | None, language: str) -> Unit:
    if language == "python":
        return _python(text or "")
    return _script(text or "") if language == "script" else _patterned(text or "", language)


def candidates(module: str, file: str, language: str) -> list[str]:
    """Paths that an import may mean, the likeliest first. Empty where the language goes by qualified names."""
    here, base = posixpath.dirname(file), module.replace("\\", "/")
    if language == "python":
        dots = len(base) - len(base.lstrip("."))
        rest = base[dots:].replace(".", "/")
        roots = [posixpath.join(here, "../" * max(0, dots - 1), rest)] if dots else [rest, "src/" + rest]
        tried = [x for r in roots for x in (r + ".py", r + ".pyi", r + "/__init__.py")]
    elif language in ("java", "kotlin", "csharp", "scala", "script"):
        return []
    else:
        ends = {"c": ["", ".h", ".c"], "cpp": ["", ".h", ".hpp"], "ruby": ["", ".rb"], "lua": [".lua"], "php": [".php"], "rust": [".rs", "/mod.rs"], "swift": [".swift"], "go": []}[language]
        base = base.replace("::", "/").removeprefix("crate/") if language == "rust" else base.replace(".", "/") if language == "lua" else base
        tried = [x + e for x in (posixpath.join(here, base), base) for e in ends]
    paths = [posixpath.normpath(p) for p in tried]
    return list(dict.fromkeys(p for p in paths if not p.startswith("../")))
