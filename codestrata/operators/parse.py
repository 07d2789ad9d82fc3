"""Parsing source files into imports, definitions, calls, symbols and edge hints.

A scanner takes a text and gives a :class:`Parsed`. Languages with braces, ``end`` keywords or offside rule share one scanner driven by a table of
patterns; Python is read with its own syntax tree and by patterns where that fails; markup, data and schema formats have scanners of
their own. Scanners are looked up by extension and may be registered from outside. A text no scanner understands gives an empty
result with the reason in ``diag``; nothing raises.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import inspect
import json
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codestrata.tables import spread


@dataclass
class Parsed:
    """What a scanner finds. Entries of ``functions``, ``symbols`` and ``hints`` are made by :func:`function`, :func:`symbol` and :func:`hint`, which fill in what is left out."""

    imports: list[str] = field(default_factory=list)
    functions: list[dict] = field(default_factory=list)
    calls: list[str] = field(default_factory=list)
    calls_by_function: list[dict] = field(default_factory=list)  # caller, line, callees
    symbols: list[dict] = field(default_factory=list)
    hints: list[dict] = field(default_factory=list)
    links: list[dict] = field(default_factory=list)  # source, target, type, line: what a type states about another beside its bases
    defines: list[str] = field(default_factory=list)  # names that other files of the page may use without importing them
    uses: list[str] = field(default_factory=list)
    diag: str | None = None


Scanner = Callable[[str, str], Parsed]


def symbol(kind: str, name: str, line: int, end_line: int | None = None, **more) -> dict:
    return {"kind": kind, "name": name, "line": line, "end_line": end_line or line, "bases": [], "parent": None, "is_public": not name.startswith("_"), "signature": "", "doc": None, "decorators": [],
            "is_static": False, "complexity": None, "type_refs": [], **more}


def function(s: dict, head: str = "") -> dict:
    """The function record of a callable symbol."""
    return {"label": s["name"], "is_efiapi": bool(re.search(r"\bEFIAPI\b", head)), "is_static": s["is_static"], "is_public": s["is_public"], "doc": s["doc"], "line": s["line"], "end_line": s["end_line"]}


class Lines:
    """Line numbers of positions in a text."""

    def __init__(self, text: str):
        self.text = text
        self.feeds = [m.start() for m in re.finditer("\n", text)]

    def of(self, at: int) -> int:
        return bisect.bisect_left(self.feeds, at) + 1

    def all(self) -> list[str]:
        return self.text.split("\n")


# For each language its extensions, comment markers, and patterns of imports, functions and types.
LANGUAGES: dict[str, dict] = {
    "c": {"ext": ".c .cpp .cc .cxx .h .hpp .hh .hxx .m .mm .asl .vfr", "line": "//", "import": r"^\s*#\s*(?:include|import)\s*[<\"]([^>\"]+)", "type": r"\b(?:class|struct|union|enum)\s+(\w+)\s*(?::\s*([^{;]+))?(?=\s*\{)", "func": r"^[A-Za-z_][\w\s*&:<>,~]*?\b([A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:const\s*)?\{"},
    "java": {"ext": ".java .cs .kt .kts .scala .groovy .dart .swift", "line": "//", "import": r"^\s*(?:import|using)\s+(?:static\s+)?([\w.*]+)", "type": r"\b(?:class|interface|enum|struct|record|object|trait|protocol)\s+(\w+)(?:<[^>]*>)?(?:\s*\([^(){}]*\))?\s*(?:(?:extends|implements|:)\s*([^{]+))?(?=\s*\{)", "func": r"(?:\b(?:fun|func|def)\s+([A-Za-z_]\w*)\s*[(<\[]|^[ \t]*(?:[\w<>\[\],.?]+\s+)+([A-Za-z_]\w*)\s*\([^;{}()]*\)\s*(?:throws [\w., ]+)?\{)"},
    "js": {"ext": ".js .mjs .cjs .jsx .ts .tsx", "line": "//", "import": r"(?:\bfrom\s+|\brequire\(\s*|\bimport\(\s*|^\s*import\s+)['\"]([^'\"]+)['\"]", "type": r"\b(?:class|interface|enum)\s+(\w+)\s*(?:(?:extends|implements)\s+([^{]+))?(?=\s*\{)", "func": r"(?:\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*[(<]|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*=>|\w+\s*=>)|(?:^[ \t]+|[{};][ \t]*)(?:async\s+|static\s+|get\s+|set\s+)*([A-Za-z_$][\w$]*)\s*\([^;{}()]*\)\s*(?::\s*[\w<>\[\]|. ]+)?\{)"},
    "go": {"ext": ".go", "line": "//", "import": r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$", "type": r"\btype\s+(\w+)\s+(?:struct|interface)()", "func": r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*[(\[]"},
    "rust": {"ext": ".rs .zig .d .nim .v", "line": "//", "import": r"^\s*(?:pub\s+)?(?:use|import|extern crate)\s+([\w:.]+)", "type": r"\b(?:struct|enum|trait|union|class|interface)\s+(\w+)()", "func": r"\b(?:fn|proc|func)\s+([A-Za-z_]\w*)\s*[(<*]"},
    "ruby": {"ext": ".rb .cr .ex .exs .jl .lua", "line": "#", "import": r"^\s*(?:require|require_relative|import|alias|use|include)\s*\(?['\"]?([\w./:]+)", "type": r"^\s*(?:class|module|defmodule|defprotocol|struct)\s+([\w.:]+)\s*(?:<\s*([\w:.]+))?", "func": r"^\s*(?:def|defp|function|local function)\s+(?:self\.)?([A-Za-z_]\w*[?!]?)"},
    "php": {"ext": ".php", "line": "//", "import": r"\b(?:use|require|require_once|include|include_once)\s*\(?\s*['\"]?([\w\\./-]+)", "type": r"\b(?:class|interface|trait)\s+(\w+)\s*(?:(?:extends|implements)\s+([^{]+))?", "func": r"\bfunction\s+&?([A-Za-z_]\w*)\s*\("},
    "shell": {"ext": ".sh .bash .zsh .ps1 .psm1 .psd1", "line": "#", "import": r"^\s*(?:source|\.|Import-Module)\s+([\w./$-]+)", "type": r"^\s*(?:class)\s+(\w+)()", "func": r"^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*(?:\(\)\s*)?\{"},
    "perl": {"ext": ".pl .pm .r", "line": "#", "import": r"^\s*(?:use|require|library|source)\s*\(?['\"]?([\w:./]+)", "type": r"^\s*package\s+([\w:]+)()", "func": r"(?:^\s*sub\s+([A-Za-z_]\w*)|^([A-Za-z_.]\w*)\s*<-\s*function)"},
    "functional": {"ext": ".hs .ml .mli .elm .fs .fsx .erl .hrl .clj .cljs", "line": "--", "import": r"^\s*(?:import(?:\s+qualified)?|open|-include(?:_lib)?\(|\(:require\s+\[)\s*\"?([\w./-]+)", "type": r"^\s*(?:data|type|newtype|class|module)\s+(\w+)()", "func": r"(?:^\(defn-?\s+([\w*+!?<>=-]+)|^(?:let\s+(?:rec\s+)?)?([a-z_]\w*)\s*(?:::|\([^)]*\)\s*->|[^=\n]*=))"},
    "basic": {"ext": ".vb .asm .s .nasm", "line": "'", "import": r"(?i)^\s*(?:imports|include|%include)\s+\"?([\w./]+)", "type": r"(?i)\b(?:class|module|structure|interface)\s+(\w+)()", "func": r"(?i)(?:\b(?:sub|function)\s+([A-Za-z_]\w*)\s*\(|^([A-Za-z_]\w*)\s+proc\b|^([A-Za-z_]\w*):)"},
}
#: How the block of a definition ends: by its brace, by a keyword, or by the indent of what follows.
BLOCKS = {"ruby": "end", "functional": "indent", "basic": "end"}
#: What tells that a definition is not for others (or, where the pattern starts with '+', that it is), in its own words.
PRIVATE = {
    "c": r"\bstatic\b", "java": r"\b(?:private|protected|fileprivate|internal)\b", "js": r"\bprivate\b|\bprotected\b|(?:^|\s)#", "go": r"+^\s*func\s+(?:\([^)]*\)\s*)?[A-Z]|^\s*type\s+[A-Z]", "rust": r"+\bpub\b|\bexport\b|\*\s*[(\[{=:]",
    "ruby": r"\bdefp\b|\bdefmacrop\b|\blocal\s+function\b", "php": r"\bprivate\b|\bprotected\b", "basic": r"(?i)\bprivate\b|\bprotected\b"}
#: Types that every language brings along, which refer to nothing in a project.
BUILTIN_TYPES = frozenset("""String Integer Boolean Double Float Long Short Byte Char Character Object Void Number Array List Map Set Dict Tuple Optional Any Union Callable Iterable Iterator Sequence
 Vec Option Result Box Self None True False Promise Record Partial Int Int32 Int64 UInt UInt8 Bool Unit Nothing Exception Error Class Type Func Action Task Date RegExp Symbol Hash Collection ArrayList HashMap
 HashSet Mapping Literal Final ClassVar Generic Protocol TypeVar FrozenSet Deque Counter DefaultDict Private Public Protected Friend Shared Overrides Sub Module Structure ByVal ByRef End EFIAPI VOID""".split())
BRANCHES = re.compile(r"\b(?:if|elif|elsif|for|foreach|while|case|catch|except|when|unless|until|rescue)\b|&&|\|\||\?(?!\.)")
CALL = re.compile(r"\b([A-Za-z_]\w+)\s*\(")
NOT_CALLS = frozenset("if for while switch return catch function def fn func elif else do sizeof typeof new throw assert and or not in is lambda with match when unless until require import class super".split())


def blank(text: str, line_marker: str = "//") -> str:
    """The text with strings and comments blanked, lines and positions kept."""
    marker = re.escape(line_marker)
    pattern = re.compile(rf"\"\"\".*?\"\"\"|'''.*?'''|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|{marker}[^\n]*", re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def count_lines(text: str, ext: str) -> tuple[int, int, int]:
    """(code, comment, blank) lines. A line that opens or continues a block comment is comment; the first token decides."""
    ext = ext.lower()
    hash_like = ext in (".py", ".rb", ".sh", ".bash", ".zsh", ".yaml", ".yml", ".toml", ".pl", ".pm", ".r", ".jl", ".ex", ".exs", ".cr", ".nim", ".ps1", ".psm1")
    dash = ext in (".sql", ".lua", ".hs", ".elm")
    code = comment = empty = 0
    closer = None
    for line in text.splitlines():
        s = line.strip()
        if closer:
            comment += 1
            if closer in s:
                closer = None
        elif not s:
            empty += 1
        elif hash_like and ext == ".py" and s.startswith(('"""', "'''")):
            comment += 1
            closer = None if len(s) > 3 and s.endswith(s[:3]) and len(s) >= 6 else s[:3]
        elif (hash_like and s.startswith("#")) or (dash and s.startswith("--")) or (not hash_like and s.startswith("//")):
            comment += 1
        elif not hash_like and s.startswith("/*"):
            comment += 1
            closer = None if "*/" in s[2:] else "*/"
        else:
            code += 1
    return code, comment, empty


_ROUND, _CURLY = re.compile(r"[()]"), re.compile(r"[{}]")
_NO_BODY = re.compile(r"[{;]|=(?![>=])|\n\s*(?:(?:\w+\s+)*(?:fun|func|fn|def|function|class|interface|struct|trait|impl)\b|[}@])")
_KEYWORD = re.compile(r"(?im)^[ \t]*(?:(?:public|private|protected|friend|shared|overrides|local|async)\s+)*(?P<open>class|module|def|defp|defmodule|defmacro|defprotocol|defimpl|if|unless|while|until|case|begin|for|struct|function|sub|structure|interface|property|do|with|try|let|macro|quote|mutable struct|select)\b[^\n]*|(?P<inline>\bdo\b[ \t]*(?:\|[^|\n]*\|)?[ \t]*$)|(?P<close>^[ \t]*end\b)")


def _matching(clean: str, at: int, pairs: re.Pattern) -> int:
    """The position behind the bracket that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in pairs.finditer(clean, at):
        depth += 1 if m.group() in "({" else -1
        if not depth:
            return m.end()
    return len(clean)


def _body(clean: str, at: int, style: str) -> tuple[int, int] | None:
    """Where the body of the definition lies whose name stands before ``at``, or None if it has none."""
    if style == "brace":
        found = _NO_BODY.search(clean, at)
        if found and found.group() == "{":
            return found.end(), _matching(clean, found.start(), _CURLY)
        stop = clean.find("\n", found.end()) if found and found.group() == "=" else -1
        return (found.end(), stop) if stop >= 0 else None
    line = clean.find("\n", at)
    line = len(clean) if line < 0 else line
    if style == "end" and re.search(r",\s*do:|\bend\s*$", clean[at:line]):
        return at, line
    if style == "end":
        depth = 1
        for m in _KEYWORD.finditer(clean, line):
            if m.group("close") is None:
                one_line = re.search(r"\bend\b\s*$|,\s*do:", m.group())
                depth += 0 if one_line or (m.group("open") or "").lower() in ("if", "do") and re.search(r"\bthen\b.*\S", m.group()) and style == "end" and "end" in m.group() else 1
            else:
                depth -= 1
                if not depth:
                    return line, m.end()
        return None
    start = clean.rfind("\n", 0, at) + 1
    indent = re.match(r"[ \t]*", clean[start:]).end()
    at, end = min(at, line), line
    for m in re.finditer(r"\n([ \t]*)([^\s])", clean[line:]):
        if len(m[1]) <= indent:
            break
        stop = clean.find("\n", line + m.end())
        end = stop if stop >= 0 else len(clean)
    return at, end


def line_doc(lines: list[str], line: int) -> tuple[str | None, list[str]]:
    """The comment that stands directly above a line, cleaned of its markers, and the decorators or attributes between."""
    at, decorators = line - 2, []
    while at >= 0 and (m := re.match(r"\s*(@\w[\w.]*(?:\(.*\))?|#\[.*\]|\[[A-Z]\w*.*\])\s*$", lines[at])):
        decorators.append(m[1])
        at -= 1
    decorators.reverse()
    if at < 0:
        return None, decorators
    found: list[str] = []
    if lines[at].rstrip().endswith("*/"):
        while at >= 0:
            found.append(lines[at])
            if "/*" in lines[at]:
                break
            at -= 1
    else:
        while at >= 0 and re.match(r"\s*(?:///?|//!|#(?![\[!])|--|;+|%+|'|\(\*)", lines[at]):
            found.append(lines[at])
            at -= 1
    clean = [re.sub(r"^\s*(?:/\*+!?|\*+/|\*|//[/!]?|#+|--+\s*\|?|;+|%+|'+|\(\*+)[ \t]?|\s*\*+[/)]\s*$", "", x).strip() for x in reversed(found)]
    return "\n".join(x for x in clean if x) or None, decorators


def type_refs(text: str, own: str = "") -> list[str]:
    """The capitalised names of a declaration that may be types of the project: of three letters or more and not built in."""
    return [x for x in dict.fromkeys(re.findall(r"(?<![\w.@\"'])(?:\w+[.:]+)*([A-Z]\w{2,})\b", text)) if x not in BUILTIN_TYPES and x != own]


def scan_generic(text: str, ext: str) -> Parsed:
    family, spec = next(((k, v) for k, v in LANGUAGES.items() if ext.lower() in v["ext"].split()), ("c", LANGUAGES["c"]))
    style = BLOCKS.get(family, "brace")
    clean, lines = blank(text, spec["line"]), Lines(text)
    raw = lines.all()
    out = Parsed(imports=list(dict.fromkeys(re.findall(spec["import"], text, re.M))))
    mark = PRIVATE.get(family, "")
    owners: list[tuple[int, int, str]] = []

    def visible(head: str, name: str) -> bool:
        if mark.startswith("+"):
            return bool(re.search(mark[1:], head))
        return not name.startswith("_") and not (mark and re.search(mark, head))

    def declared(start: int, stop: int) -> str:
        first = clean.rfind("\n", 0, start) + 1
        return re.sub(r"\s+", " ", re.split(r"[{\n]", text[max(first, 0) : stop].lstrip("\n"))[0]).strip()[:200]

    for m in re.finditer(spec["type"], clean, re.M):
        body = _body(clean, m.end() if style == "brace" else m.end(2 if m[2] else 1), style)
        end = body[1] if body else m.end()
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        bases = [re.sub(r"[<(].*|\b(?:public|private|protected|virtual)\b", "", x).strip() for x in re.split(r",|\b(?:implements|extends|with)\b", m[2] or "")]
        line, head = lines.of(start), declared(start, m.end())
        doc, decorators = line_doc(raw, line)
        fields = "\n".join(x for x in clean[body[0] : body[1]].split("\n") if "(" not in x) if body else ""
        out.symbols.append(symbol(re.search(r"[a-z]+", m.group().lower()).group(), m[1], line, lines.of(end), bases=[x for x in bases if x], is_public=visible(head, m[1]), is_static=bool(re.search(r"\bstatic\b", head)),
                                  signature=m.group().strip()[:200], doc=doc, decorators=decorators, type_refs=type_refs(f"{m[2] or ''} {fields}", m[1])))
        owners.append((m.start(), end, m[1]))
    for m in re.finditer(spec["func"], clean, re.M):
        name = next((g for g in m.groups() if g), None)
        if not name or name in NOT_CALLS or (style == "indent" and any(f["label"] == name for f in out.functions[-1:])):
            continue  # a signature and the clauses below it are one function
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        opened = clean.find("(", m.start(next(i for i, g in enumerate(m.groups(), 1) if g)), m.end() + 1)
        after = _matching(clean, opened, _ROUND) if opened >= 0 else m.end() - m.group().endswith("{")
        body = _body(clean, after, style)
        end = body[1] if body else m.end()
        parent = next((o for x, y, o in reversed(owners) if x < m.start() < y), None)
        line, head = lines.of(start), declared(start, max(m.end(), after))
        doc, decorators = line_doc(raw, line)
        inner = clean[body[0] : body[1]] if body else ""
        stop = clean.find("\n", after)
        typed = clean[max(opened, m.start()) : body[0] if body and style == "brace" else stop if stop >= 0 else len(clean)] if family not in ("shell", "perl", "ruby") else ""
        s = symbol("method" if parent else "function", name, line, lines.of(end), parent=parent, is_public=visible(head, name), is_static=bool(re.search(r"\bstatic\b", head)),
                   signature=re.sub(r"\s+", " ", re.split(r"[\n{]", m.group().strip())[0])[:200], doc=doc, decorators=decorators, complexity=1 + len(BRANCHES.findall(inner)), type_refs=type_refs(f"{head} {typed}" if typed else "", name))
        out.symbols.append(s)
        out.functions.append(function(s, head))
        out.calls_by_function.append({"caller": name, "line": line, "callees": [c for c in dict.fromkeys(CALL.findall(inner)) if c not in NOT_CALLS]})
    out.calls = [c for c in dict.fromkeys(CALL.findall(clean)) if c not in NOT_CALLS]
    if family == "ruby":
        for m in re.finditer(r"(?m)^[ \t]*(?P<word>include|extend|prepend|@behaviour)\s+\(?(?P<name>[A-Z][\w.:]*)|^[ \t]*defimpl\s+(?P<protocol>[A-Z][\w.]*)\s*,\s*for:\s*(?P<of>[A-Z][\w.]*)", clean):
            owner = m["of"] or next((o for x, y, o in reversed(owners) if x < m.start() < y), None)
            if owner:
                kind = "protocol_impl" if m["protocol"] else "behaviour_impl" if m["word"] == "@behaviour" else f"mixin_{m['word']}"
                out.links.append({"source": owner, "target": m["protocol"] or m["name"], "type": kind, "line": lines.of(m.end())})
    if family == "js":
        out.defines = list(dict.fromkeys(re.findall(r"\b(?:window|globalThis|self)\.([A-Za-z_$][\w$]*)\s*=(?!=)|(?m:^(?:async\s+)?(?:function\s*\*?|class|var|let|const)\s+([A-Za-z_$][\w$]*))", clean)))
        out.defines = list(dict.fromkeys(x or y for x, y in out.defines))
        out.uses = list(dict.fromkeys(x or y for x, y in re.findall(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*(?:\(|\.)|\b(?:window|globalThis|self)\.([A-Za-z_$][\w$]*)(?!\s*=[^=])", clean)))
    return out


class _Tree(ast.NodeVisitor):
    def __init__(self) -> None:
        self.out, self.stack, self.callers = Parsed(), [], []

    def visit_Import(self, node: ast.Import) -> None:
        self.out.imports += [a.name for a in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        root = "." * node.level + (node.module or "")
        self.out.imports += [root] if node.module else [root + a.name for a in node.names]

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        notes = " ".join(ast.unparse(n.annotation) for n in node.body if isinstance(n, ast.AnnAssign))
        bases = [ast.unparse(b) for b in node.bases]
        self._symbol(node, symbol("class", node.name, node.lineno, node.end_lineno, bases=bases, signature=f"class {node.name}" + (f"({', '.join(bases)})" if bases else ""), type_refs=type_refs(f"{' '.join(bases)} {notes}", node.name)))

    def visit_FunctionDef(self, node) -> None:
        names = {getattr(d, "id", getattr(d, "attr", None)) for d in node.decorator_list}
        notes = " ".join(ast.unparse(x) for x in (*(a.annotation for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)), node.returns) if x is not None)
        kind = "method" if self.stack and self.stack[-1][0] == "class" else "function"
        s = symbol(kind, node.name, node.lineno, node.end_lineno, is_static="staticmethod" in names, complexity=python_complexity(node), type_refs=type_refs(notes, node.name),
                   signature=f"def {node.name}({ast.unparse(node.args)})"[:200] + (f" -> {ast.unparse(node.returns)}" if node.returns else ""))
        self.callers.append({"caller": node.name, "line": node.lineno, "callees": []})
        self.out.calls_by_function.append(self.callers[-1])
        self._symbol(node, s)
        self.callers.pop()
        self.out.functions.append(function(s))

    visit_AsyncFunctionDef = visit_FunctionDef

    def _symbol(self, node, s: dict) -> None:
        s |= {"parent": self.stack[-1][1] if self.stack else None, "doc": ast.get_docstring(node), "decorators": [ast.unparse(d) for d in node.decorator_list],
              "is_public": not node.name.startswith("_") or bool(re.fullmatch("__.+__", node.name))}
        self.out.symbols.append(s)
        self.stack.append((s["kind"], node.name))
        self.generic_visit(node)
        self.stack.pop()

    def visit_Call(self, node: ast.Call) -> None:
        name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
        if name and len(name) > 1:
            self.out.calls.append(name)
            if self.callers and name not in self.callers[-1]["callees"]:
                self.callers[-1]["callees"].append(name)
            first = node.args[0] if node.args else None
            if name in ("open", "Path") and isinstance(first, ast.Constant) and isinstance(first.value, str):
                self.out.hints.append(hint(first.value, node.lineno, via=name, origin="literal", confidence=0.8))
        self.generic_visit(node)


def python_complexity(node: ast.AST) -> int:
    """1 and the branches of a function's own body; nested definitions count for themselves."""
    total, todo = 1, list(ast.iter_child_nodes(node))
    while todo:
        n = todo.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            continue
        if isinstance(n, (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.match_case)):
            total += 1
        elif isinstance(n, ast.BoolOp):
            total += len(n.values) - 1
        elif isinstance(n, ast.comprehension):
            total += len(n.ifs)
        todo += ast.iter_child_nodes(n)
    return total


def scan_python(text: str, ext: str = ".py") -> Parsed:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        clean, lines = blank(text, "#"), Lines(text)
        raw = lines.all()
        out = Parsed(imports=[a or b for a, b in re.findall(r"^\s*(?:from\s+([.\w]+)\s+import|import\s+([.\w]+))", text, re.M)], diag=f"syntax: {e.__class__.__name__}")
        for m in re.finditer(r"^([ \t]*)(class|(?:async\s+)?def)\s+(\w+)", clean, re.M):
            kind = "class" if m[2] == "class" else "method" if m[1] else "function"
            body = _body(clean, m.end(), "indent")
            line = lines.of(m.start(2))
            out.symbols.append(symbol(kind, m[3], line, lines.of(body[1]) if body else line, signature=m.group().strip(), decorators=line_doc(raw, line)[1]))
            if kind != "class":
                out.functions.append(function(out.symbols[-1]))
                out.calls_by_function.append({"caller": m[3], "line": line, "callees": [c for c in dict.fromkeys(CALL.findall(clean[slice(*body)] if body else "")) if c not in NOT_CALLS]})
        out.calls = [c for c in dict.fromkeys(CALL.findall(clean)) if c not in NOT_CALLS]
        return out
    v = _Tree()
    v.visit(tree)
    v.out.imports, v.out.calls = list(dict.fromkeys(v.out.imports)), list(dict.fromkeys(v.out.calls))
    return v.out


# What a literal reference leads to, by extension.
CONFIG_EXT = (".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".env", ".xml")
ASSET_EXT = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".css", ".woff", ".woff2", ".ttf", ".csv", ".txt", ".html", ".md", ".mp3", ".mp4", ".pdf")


def hint(target: str, line: int, kind: str | None = None, **more) -> dict:
    """An edge hint; without a kind it goes by the extension of what it leads to."""
    low = target.lower().split("?")[0].split("#")[0]
    kind = kind or ("config_ref" if low.endswith(CONFIG_EXT) else "asset_ref" if low.endswith(ASSET_EXT) else "import")
    return {"type": kind, "target": target, "line": line, "via": None, "subtype": None, "origin": "parser", "confidence": None, **more}


def _local(ref: str) -> bool:
    return bool(ref) and not re.match(r"(?i)[a-z][a-z0-9+.-]*:|//|#", ref)


def scan_html(text: str, ext: str = ".html") -> Parsed:
    body = re.sub(r"<!--.*?-->", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)
    lines = Lines(text)
    out = Parsed()
    for m in re.finditer(r"<(\w+)\b[^>]*?\b(href|src|srcset)\s*=\s*[\"']([^\"']+)[\"']", body, re.I):
        for ref in ([p.split()[0] for p in m[3].split(",") if p.split()] if m[2].lower() == "srcset" else [m[3]]):
            if _local(ref):
                out.hints.append(hint(ref, lines.of(m.start()), "import" if m[1].lower() == "script" else "asset_ref" if m[1].lower() in ("img", "link", "source", "video", "audio") else "resource_hint"))
    out.imports = [h["target"] for h in out.hints if h["type"] == "import"]
    return out


def scan_markdown(text: str, ext: str = ".md") -> Parsed:
    body = re.sub(r"(?ms)^(```|~~~).*?^\1|`[^`\n]*`", lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    lines = Lines(text)
    out = Parsed()
    for m in re.finditer(r"!?\[[^\]]*\]\(\s*<?([^)\s>]+)|^\[[^\]]+\]:\s*(\S+)|\[\[([^\]|#]+)", body, re.M):
        ref = m[1] or m[2] or (m[3].strip() + ".md")
        if _local(ref):
            out.hints.append(hint(ref, lines.of(m.start()), "asset_ref" if m.group().startswith("!") else "import"))
    for m in re.finditer(r"^(#{1,6})\s+(.+?)\s*#*$", body, re.M):
        out.symbols.append(symbol("heading", m[2], lines.of(m.start()), signature=m.group().strip()[:200]))
    return out


def scan_json(text: str, ext: str = ".json") -> Parsed:
    try:
        data = json.loads(text)
    except ValueError as e:
        return Parsed(diag=f"json: {e.__class__.__name__}")
    out, todo = Parsed(), [data]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo += x.values()
        elif isinstance(x, list):
            todo += x
        elif isinstance(x, str) and re.fullmatch(r"[\w./@-]+\.\w{1,5}", x) and _local(x):
            out.hints.append(hint(x, 0))
    if isinstance(data, dict):
        out.symbols = [symbol("key", k, 1, signature=k) for k in data]
    return out


def scan_config(text: str, ext: str = ".yaml") -> Parsed:
    """YAML and TOML by lines: keys at the left edge, sections, anchors, and values that look like paths."""
    out = Parsed()
    rows = text.splitlines()
    for n, line in enumerate(rows, 1):
        if m := re.match(r"\[+([^\]]+)\]+|([\w.-]+)\s*[:=]", line):
            out.symbols.append(symbol("section" if m[1] else "key", (m[1] or m[2]).strip(), n, signature=line.strip()[:200], doc=line_doc(rows, n)[0]))
        for ref in re.findall(r"[\w./-]+\.(?:json|ya?ml|toml|py|js|ts|sh|md|txt|cfg|ini)\b", line.split(" #")[0]):
            out.hints.append(hint(ref, n))
    return out


def scan_sql(text: str, ext: str = ".sql") -> Parsed:
    clean = re.sub(r"/\*.*?\*/|--[^\n]*|'(?:[^']|'')*'", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)
    lines = Lines(text)
    raw = lines.all()
    out = Parsed()
    made = set()
    for m in re.finditer(r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(table|view|function|procedure|materialized view|index)\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)", clean):
        name = re.sub(r"[\"`]", "", m[2])
        made.add(name.lower())
        stop = clean.find(";", m.end())
        line = lines.of(m.start())
        body = clean[m.end() : stop if stop >= 0 else len(clean)]
        out.symbols.append(symbol(m[1].lower(), name, line, lines.of(stop if stop >= 0 else len(clean)), signature=re.sub(r"\s+", " ", m.group())[:200], doc=line_doc(raw, line)[0],
                                  type_refs=[x for x in dict.fromkeys(re.findall(r"(?i)\b(?:references|from|join)\s+([\w.]+)", body)) if x.lower() != name.lower()]))
    ctes = {x.lower() for x in re.findall(r"(?i)(?:\bwith\s+(?:recursive\s+)?|,\s*)(\w+)\s+as\s*\(", clean)}
    for m in re.finditer(r"(?i)\b(?:from|join|into|update|references)\s+([\w.\"`]+)", clean):
        name = re.sub(r"[\"`]", "", m[1])
        if name.lower() not in ctes | made and name.lower() not in ("select", "set", "values", "lateral", "unnest"):
            out.hints.append(hint(name, lines.of(m.start()), "schema_ref"))
    return out


def scan_schema(text: str, ext: str = ".proto") -> Parsed:
    """Protocol buffers, GraphQL and style sheets: named blocks, and the files they import."""
    clean = re.sub(r"/\*.*?\*/|//[^\n]*|#[^\n]*" if ext in (".graphql", ".gql") else r"/\*.*?\*/|//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)
    lines = Lines(text)
    raw = lines.all()
    out = Parsed(imports=re.findall(r"(?:@?import|@use|@forward|#import)\s+(?:public\s+|url\()?[\"']([^\"']+)", text))
    for m in re.finditer(r"\b(message|service|enum|rpc|type|interface|input|union|scalar|mixin|@mixin|@function)\s+(\w+)(?:\s+implements\s+([\w &,]+))?", clean):
        found = _body(clean, m.end(), "brace")
        line = lines.of(m.start())
        out.symbols.append(symbol(m[1].lstrip("@"), m[2], line, lines.of(found[1]) if found else line, bases=re.findall(r"\w+", m[3] or ""), signature=m.group(), doc=line_doc(raw, line)[0],
                                  type_refs=type_refs(clean[slice(*found)] if found else clean[m.end() : clean.find("\n", m.end())], m[2])))
    out.hints = [hint(i, 0, "import") for i in out.imports] + [hint(m[1], lines.of(m.start()), "asset_ref") for m in re.finditer(r"url\(\s*[\"']?([^\"')]+)", clean) if _local(m[1])]
    return out


def scan_manifest(text: str, ext: str = ".inf") -> Parsed:
    """Firmware manifests: the entries of their sections, typed by section and kind of manifest."""
    kinds = {"sources": "sources", "packages": "package", "libraryclasses": "library", "guids": "guid_ref", "ppis": "guid_ref", "protocols": "guid_ref", "components": "component", "depex": "depex"}
    out, section, rows = Parsed(), "", text.splitlines()
    for n, line in enumerate(rows, 1):
        s = re.sub(r"#.*", "", line).strip()
        if m := re.match(r"\[([\w.]+)", s):
            section = m[1].split(".")[0].lower()
        elif s and section in kinds:
            entry = re.split(r"[|{=]", s)[-1 if kinds[section] == "library" and "|" in s else 0].strip()
            if entry:
                out.hints.append(hint(entry, n, kinds[section]))
                if ext == ".dec" and kinds[section] == "guid_ref":
                    out.symbols.append(symbol("guid", entry, n, signature=s[:200], doc=line_doc(rows, n)[0]))
        elif m := re.match(r"(?:INF\s+|#?include\s+[\"<]?)([\w./-]+)", s):
            out.hints.append(hint(m[1], n, "component" if s.startswith("INF") else "include"))
        elif m := re.match(r"(BASE_NAME|PLATFORM_NAME|PACKAGE_NAME)\s*=\s*(\S+)", s):
            out.symbols.append(symbol("module", m[2], n, signature=s, doc=line_doc(rows, n)[0]))
    return out


def scan_form(text: str, ext: str = ".vfr") -> Parsed:
    """Forms and their strings: strings are declared by ``#string`` and referred to by STRING_TOKEN; forms include files."""
    lines, out = Lines(text), Parsed()
    for m in re.finditer(r"(?m)^\s*#string\s+(\w+)|\bSTRING_TOKEN\s*\(\s*(\w+)|^\s*#include\s+[<\"]([^>\"]+)", text):
        line = lines.of(m.start() + len(m.group()) - len(m.group().lstrip()))
        if m[1]:
            out.symbols.append(symbol("string", m[1], line, signature=m.group().strip()[:200]))
        else:
            out.hints.append(hint(m[2] or m[3], line, "str_ref" if m[2] else "include"))
    out.imports = [h["target"] for h in out.hints if h["type"] == "include"]
    return out


def scan_acpi(text: str, ext: str = ".asl") -> Parsed:
    """ACPI sources: includes, devices, scopes and methods."""
    clean, lines = blank(text), Lines(text)
    raw, out = lines.all(), Parsed(imports=re.findall(r"(?m)^\s*#?[Ii]nclude\s*\(?\s*[<\"]([^>\"]+)", text))
    out.hints = [hint(i, 0, "asl_include") for i in out.imports]
    for m in re.finditer(r"\b(Device|Scope|Method|Processor|ThermalZone)\s*\(\s*([\\\w.^]+)", clean):
        line, body = lines.of(m.start()), _body(clean, m.end(), "brace")
        inner = clean[slice(*body)] if body else ""
        s = symbol(m[1].lower(), m[2], line, lines.of(body[1]) if body else line, signature=re.sub(r"\s+", " ", m.group()) + ")", doc=line_doc(raw, line)[0], complexity=1 + len(BRANCHES.findall(inner.lower())) if m[1] == "Method" else None)
        out.symbols.append(s)
        if m[1] == "Method":
            out.functions.append(function(s))
            out.calls_by_function.append({"caller": m[2], "line": line, "callees": [c for c in dict.fromkeys(CALL.findall(inner)) if c.lower() not in NOT_CALLS]})
    return out


SCANNERS: dict[str, Scanner] = {e: scan_generic for s in LANGUAGES.values() for e in s["ext"].split()}
SCANNERS |= {".py": scan_python, ".json": scan_json, ".sql": scan_sql} | dict.fromkeys((".html", ".htm", ".xhtml"), scan_html) | dict.fromkeys((".md", ".markdown", ".mdown", ".mkd", ".rst", ".txt"), scan_markdown)
SCANNERS |= dict.fromkeys((".yaml", ".yml", ".toml"), scan_config) | dict.fromkeys((".proto", ".graphql", ".gql", ".css", ".scss", ".sass", ".less", ".styl"), scan_schema)
SCANNERS |= dict.fromkeys((".inf", ".dec", ".dsc", ".fdf"), scan_manifest) | dict.fromkeys((".vfr", ".hfr", ".uni"), scan_form) | {".asl": scan_acpi}


def register(ext: str, scanner: Scanner) -> None:
    """Let ``scanner`` read files with the extension from now on."""
    SCANNERS[ext.lower()] = scanner


def scan(text: str | None, ext: str | None) -> Parsed:
    f = SCANNERS.get((ext or "").lower())
    if not text or f is None:
        return Parsed(diag=None if text == "" else "no scanner" if text else "no text")
    try:
        return f(text.lstrip("﻿"), (ext or "").lower())
    except Exception as e:  # noqa: BLE001 - a plug-in's fault must not end the job
        return Parsed(diag=f"failed: {e.__class__.__name__}")


def fingerprint(scanner: Scanner) -> str:
    """A hash that changes when a scanner does: of this module and of the scanner's own source or code."""
    own = sys.modules[__name__]
    try:
        text = inspect.getsource(own) + ("" if scanner.__module__ == __name__ else inspect.getsource(scanner))
    except (OSError, TypeError):
        code = getattr(scanner, "__code__", None)
        text = repr((code.co_code, code.co_consts, code.co_names)) if code else repr(scanner)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


_FUNCTION = "struct<label:string,is_efiapi:boolean,is_static:boolean,is_public:boolean,doc:string,line:int,end_line:int>"
_SYMBOL = ("struct<kind:string,name:string,line:int,end_line:int,bases:array<string>,parent:string,is_public:boolean,signature:string,doc:string,decorators:array<string>,is_static:boolean,complexity:int,"
           "type_refs:array<string>>")
_HINT = "struct<type:string,target:string,line:int,via:string,subtype:string,origin:string,confidence:double>"
COLUMNS = {"file_id": "long", "path": "string", "sha": "string", "version": "string", "code": "int", "comment": "int", "blank": "int", "imports": "array<string>", "functions": f"array<{_FUNCTION}>", "calls": "array<string>",
           "calls_by_function": "array<struct<caller:string,line:int,callees:array<string>>>", "symbols": f"array<{_SYMBOL}>", "hints": f"array<{_HINT}>", "links": "array<struct<source:string,target:string,type:string,line:int>>", "defines": "array<string>", "uses": "array<string>", "diag": "string"}
SCHEMA = ", ".join(f"{k} {v}" for k, v in COLUMNS.items())


def parse_files(files: DataFrame, texts: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """One row a file, as in SCHEMA. With a ``cache`` of earlier rows only files whose content or scanner changed are parsed; cached rows of files that are gone are left out."""
    registered = dict(SCANNERS)
    prints = {e: fingerprint(f) for e, f in registered.items()}
    version = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in prints.items() for x in p)), F.coalesce("ext", F.lit(""))), F.lit("none"))
    known = files.where("file_id IS NOT NULL").select("file_id", "path", F.lower("ext").alias("ext")).dropDuplicates(["file_id"])
    rows = known.join(texts.select("file_id", "text"), "file_id").withColumns({"sha": F.sha2(F.coalesce("text", F.lit("")), 256), "version": version})
    key = ["file_id", "sha", "version"]
    fresh = rows if cache is None else rows.join(cache.select(*key), key, "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        SCANNERS.update(registered)
        for b in batches:
            out = []
            for k, path, ext, text, sha, made in zip(b["file_id"], b["path"], b["ext"], b["text"], b["sha"], b["version"]):
                p = scan(text, ext)
                out.append((k, path, sha, made, *count_lines(text or "", ext or ""), p.imports, p.functions, p.calls, p.calls_by_function, p.symbols, p.hints, p.links, p.defines, p.uses, p.diag))
            yield pd.DataFrame(out, columns=list(COLUMNS))

    fresh = spread(fresh.select("file_id", "path", "ext", "text", "sha", "version")).mapInPandas(run, SCHEMA)
    if cache is None:
        return fresh
    return fresh.unionByName(cache.join(rows.select(*key), key, "left_semi").select(*fresh.columns))


def function_rows(parsed: DataFrame, shown: int = 200) -> DataFrame:
    """(file_id, path, id, label, is_public, is_efiapi, doc): the functions of parsed files, numbered within their file; static ones are not public, documentation is a summary of ``shown`` characters."""
    f = parsed.select("file_id", "path", F.posexplode("functions").alias("id", "f"))
    return f.select("file_id", "path", "id", "f.label", (~F.col("f.is_static")).alias("is_public"), "f.is_efiapi", F.substring("f.doc", 1, shown).alias("doc"))


def symbol_rows(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """(project, sym_id, file_id, path, ...): the symbols of parsed files with ids 'sym_<file>_<symbol>' that count files of a project by path and symbols by place.

    Only the paths, one row a file, are numbered in one sorted pass a project.
    """
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("project").orderBy("path", "file_id")) - 1
    numbered = files.where("file_id IS NOT NULL AND path IS NOT NULL").select("file_id", "project", "path").distinct().withColumn("nth", place).select("file_id", "project", "nth")
    return parsed.select("file_id", "path", F.posexplode("symbols").alias("at", "s")).join(numbered, "file_id").select(
        "project", F.concat(F.lit("sym_"), "nth", F.lit("_"), "at").alias("sym_id"), "file_id", "path", "s.*")
