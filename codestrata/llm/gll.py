"""A generalised LL parser for the block structure of source files.

Files are read as a short sequence of structural tokens: documentation comments, function heads, other openers and closers.
The parser follows a grammar over them, possibly along several derivations at once; its stacks are shared in a graph
with one node for each nonterminal and position, so the work stays polynomial however ambiguous the grammar is. Well-formed files are
parsed by a plain grammar. If that fails, the blocks whose closer stands at the indent of their opener are set aside as islands, and a
second grammar, with rules for missing and surplus closers, parses what is left between them; it yields the functions
of a broken file, whole or not. There is no bound on its steps.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

DOC, HEAD, OPEN, CLOSE, EOF = "D", "H", "O", "C", "$"


@dataclass(slots=True)
class Token:
    kind: str
    start: int
    end: int
    indent: int
    name: str = ""


@dataclass(slots=True)
class Function:
    name: str
    start: int  # character positions in the text
    end: int
    doc: tuple[int, int] | None
    whole: bool  # False: its closer is missing


class Grammar:
    """Alternatives by nonterminal. An alternative is tried where the next token is among its look-ahead."""

    def __init__(self, rules: dict[str, list[tuple[list[str], str]]]):
        self.slots: list[str | None] = []  # the symbol after each dot; None ends an alternative
        self.owner: list[tuple[str, int]] = []
        self.alternatives: dict[str, list[tuple[int, str]]] = {}
        for nonterminal, options in rules.items():
            self.alternatives[nonterminal] = []
            for nth, (symbols, ahead) in enumerate(options):
                self.alternatives[nonterminal].append((len(self.slots), ahead))
                for s in [*symbols, None]:
                    self.slots.append(s)
                    self.owner.append((nonterminal, nth))


_ANY = DOC + HEAD + OPEN
_BASE = {"Item": [([DOC], DOC), (["Whole"], HEAD), (["Block"], OPEN)], "Whole": [([HEAD, "Items", CLOSE], HEAD)]}
PLAIN = Grammar({
    **_BASE, "Unit": [(["Items", EOF], _ANY + EOF)], "Items": [(["Item", "Items"], _ANY), ([], CLOSE + EOF)], "Block": [([OPEN, "Items", CLOSE], OPEN)]})
#: A block without its closer ends before the next token that stands no deeper than its opener ("Gap"); closers of nothing are passed over. Its items recur
#: on the left, so that the places where they may end are kept once a block and not once a sibling.
BROKEN = Grammar({
    "Item": [*_BASE["Item"], (["Torn"], HEAD)], "Whole": _BASE["Whole"], "Torn": [([HEAD, "Items", "Gap"], HEAD)],
    "Block": [([OPEN, "Items", CLOSE], OPEN), ([OPEN, "Items", "Gap"], OPEN)], "Gap": [([], _ANY + CLOSE + EOF)],
    "Unit": [(["Tops", EOF], _ANY + CLOSE + EOF)], "Tops": [(["Item", "Tops"], _ANY), ([CLOSE, "Tops"], CLOSE), ([], EOF)],
    "Items": [(["Items", "Item"], _ANY), ([], _ANY + CLOSE + EOF)]})


def parse(grammar: Grammar, kinds: str, reach: list[int] | None = None) -> dict[tuple[str, int], list[int]] | None:
    """All extents of the nonterminals in ``kinds``, which ends with EOF: (nonterminal, start) to its ends. None if it isn't a unit.

    ``reach`` says for the opener at each place how far its block goes at most: up to a closer there, or without one. With it a
    place is an end of the blocks around it only, so the steps grow with the tokens times the depth of what is open at once.
    """
    slots, alternatives = grammar.slots, grammar.alternatives
    nodes: dict[tuple[str, int], int] = {}
    keys: list[tuple[str, int]] = []
    edges: list[list[tuple[int, int]]] = []
    ends: list[list[int]] = []
    todo: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int, int]] = set()
    ended: set[tuple[int, int]] = set()
    linked: set[tuple[int, int, int]] = set()

    def node(nonterminal: str, at: int) -> int:
        key = (nonterminal, at)
        n = nodes[key] = len(keys)
        keys.append(key)
        edges.append([])
        ends.append([])
        ahead = kinds[at]
        for slot, look in alternatives[nonterminal]:
            if ahead in look:
                todo.append((slot, n, at))
        return n

    node("Unit", 0)
    last = len(kinds)
    while todo:
        slot, n, at = todo.pop()
        while True:
            symbol = slots[slot]
            if symbol is None:
                if (n, at) not in ended:
                    ended.add((n, at))
                    ends[n].append(at)
                    for back, upper in edges[n]:
                        d = (back, upper, at)
                        if d not in seen:
                            seen.add(d)
                            todo.append(d)
                break
            if symbol in alternatives:
                if reach:
                    held, start = keys[n]
                    if symbol == "Gap" and at != reach[start] or symbol == "Item" and held == "Items" and at >= reach[start - 1]:
                        break
                child = nodes.get((symbol, at))
                if child is None:
                    child = node(symbol, at)
                edge = (child, slot + 1, n)
                if edge not in linked:
                    linked.add(edge)
                    edges[child].append(edge[1:])
                    for end in ends[child]:
                        d = (slot + 1, n, end)
                        if d not in seen:
                            seen.add(d)
                            todo.append(d)
                break
            if at < last and kinds[at] == symbol and not (reach and symbol == CLOSE and keys[n][0] != "Tops" and at > reach[keys[n][1]]):
                slot, at = slot + 1, at + 1
            else:
                break
    if last not in ends[0]:
        return None
    return {k: e for k, e in zip(keys, ends) if e and k[0] in ("Whole", "Torn")}


# --- tokens -------------------------------------------------------------------------------------------------------------------

_NOT_FUNCTIONS = frozenset("if for while switch catch else do try return with when match until foreach using lock synchronized elif unless sizeof new throw await case".split())
_BRACES = re.compile(
    r"(?P<doc>/\*.*?(?:\*/|\Z)|(?:[ \t]*//[^\n]*\n?)+)"
    r"|(?P<text>\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|'(?:[^'\\\n]|\\.){1,200}')"
    r"|(?P<head>\b(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^<>(){};]*>)?\s*\((?:[^(){};]|\([^(){};]*\))*\)[^(){};=]*\{)"
    r"|(?P<open>\{)|(?P<close>\})", re.S)
_HASH_LINES = r"(?:[ \t]*#[^\n]*\n?)+"
_RUBY = re.compile(
    rf"(?P<doc>^{_HASH_LINES})|(?P<head>^[ \t]*def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!=]?))"
    r"|(?P<open>^[ \t]*(?:class|module|if|unless|while|until|case|begin|for)\b|\bdo\b(?:[ \t]*\|[^|\n]*\|)?[ \t\r]*$)|(?P<close>^[ \t]*end\b)", re.M)
_PYTHON = re.compile(r"^(?P<indent>[ \t]*)(?:(?P<doc>#[^\n]*)|(?P<head>(?:async[ \t]+)?def[ \t]+(?P<name>\w+))|(?P<open>class[ \t]+\w+)|(?P<line>[^\s#)\]}]))", re.M)
_TRIPLE = re.compile(r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''", re.S)
RUBY_LIKE = (".rb", ".rake", ".cr", ".ex", ".exs", ".jl", ".lua")
PYTHON_LIKE = (".py", ".pyi", ".pyx")


def _indent(text: str, at: int) -> int:
    line = text.rfind("\n", 0, at) + 1
    n = line
    while n < len(text) and text[n] in " \t":
        n += 1
    return n - line


def _line_start(text: str, at: int) -> int:
    return text.rfind("\n", 0, at) + 1


def brace_tokens(text: str) -> list[Token]:
    out = []
    for m in _BRACES.finditer(text):
        kind = m.lastgroup if m.lastgroup != "name" else "head"
        if kind == "text":
            continue
        at = m.start()
        if kind == "head":
            name = m["name"]
            if name in _NOT_FUNCTIONS:
                out.append(Token(OPEN, at, m.end(), _indent(text, at)))
            else:
                out.append(Token(HEAD, _line_start(text, at), m.end(), _indent(text, at), name))
        else:
            out.append(Token(DOC if kind == "doc" else OPEN if kind == "open" else CLOSE, at, m.end(), _indent(text, at)))
    return out


def ruby_tokens(text: str) -> list[Token]:
    out = []
    for m in _RUBY.finditer(text):
        kind = DOC if m["doc"] is not None else HEAD if m["head"] is not None else OPEN if m["open"] is not None else CLOSE
        out.append(Token(kind, m.start(), m.end(), _indent(text, m.start()), m["name"] or ""))
    return out


def _mask(m: re.Match) -> str:
    """A string of several lines as one word; the blank lines that remain don't count as lines of code."""
    first, _, rest = m.group().partition("\n")
    return "_" * len(first) + ("\n" + re.sub(r"[^\n]", " ", rest) if rest or "\n" in m.group() else "")


def python_tokens(text: str) -> list[Token]:
    """Indentation made explicit: a closer, of no length, where the lines of a def or class end."""
    held = _TRIPLE.sub(_mask, text)
    out: list[Token] = []
    stack: list[int] = []
    last = 0
    for m in _PYTHON.finditer(held):
        indent = len(m["indent"])
        if m["doc"] is None:
            while stack and indent <= stack[-1]:
                out.append(Token(CLOSE, last, last, stack.pop()))
            stop = held.find("\n", m.end())
            stop = len(held) if stop < 0 else stop
        if m["head"] is not None:
            out.append(Token(HEAD, m.start(), m.end(), indent, m["name"]))
            stack.append(indent)
        elif m["open"] is not None:
            out.append(Token(OPEN, m.start(), m.end(), indent))
            stack.append(indent)
        elif m["doc"] is not None:
            out.append(Token(DOC, m.start(), m.end(), indent))
            continue
        last = stop
    while stack:
        out.append(Token(CLOSE, len(text.rstrip()), len(text.rstrip()), stack.pop()))
    return out


def tokens(text: str, ext: str | None) -> list[Token]:
    ext = (ext or "").lower()
    return python_tokens(text) if ext in PYTHON_LIKE else ruby_tokens(text) if ext in RUBY_LIKE else brace_tokens(text)


def islands(kinds: str, indents: list[int]) -> tuple[list[int], list[int], dict[int, int]]:
    """Set aside each block whose closer stands at its opener's indent and which holds nothing but such blocks and comments.

    Gives the places that remain (a block set aside keeps its first one), the place behind each, and the ends of the blocks set aside.
    One pass: a closer is compared with the innermost open block only.
    """
    kept: list[int] = []
    behind: list[int] = []
    opened: list[int] = []  # where in ``kept`` the open blocks are; a surplus closer bars those before it
    ends: dict[int, int] = {}
    for at, kind in enumerate(kinds[:-1]):
        if kind == CLOSE and opened and indents[kept[opened[-1]]] == indents[at]:
            first = opened.pop()
            ends[kept[first]] = at + 1
            del kept[first + 1 :], behind[first + 1 :]
            behind[first] = at + 1
            continue
        if kind in (HEAD, OPEN):
            opened.append(len(kept))
        elif kind == CLOSE:
            opened.clear()
        kept.append(at)
        behind.append(at + 1)
    return kept, behind, ends


def recover(kinds: str, indents: list[int]) -> dict[tuple[str, int], list[int]]:
    """The extents of the functions of a file that is no unit of the plain grammar."""
    kept, behind, ends = islands(kinds, indents)
    out = {("Whole", at): [end] for at, end in ends.items() if kinds[at] == HEAD}
    left = "".join(DOC if at in ends else kinds[at] for at in kept) + EOF
    depth = [indents[at] for at in kept] + [-1]
    reach = [len(kept)] * (len(kept) + 1)
    deeper: list[int] = []
    for nth, indent in enumerate(depth):
        while deeper and depth[deeper[-1]] >= indent:
            reach[deeper.pop()] = nth
        deeper.append(nth)
    place = [*kept, len(kinds) - 1]
    for (name, start), found in (parse(BROKEN, left, reach) or {}).items():
        out[name, kept[start]] = [behind[end - 1] if name == "Whole" else place[end] for end in found]
    return out


def functions(text: str, ext: str | None) -> list[Function]:
    """The functions of a source text, in order, with the comment that stands before each. Broken files yield what can be read of them."""
    found = tokens(text, ext)
    kinds = "".join(t.kind for t in found) + EOF
    extents = parse(PLAIN, kinds)
    if extents is None:
        extents = recover(kinds, [t.indent for t in found] + [-1])
    # Of several extents the one whose closer stands under the head; else the shortest.
    best: dict[int, tuple[bool, int, bool]] = {}
    for (name, start), ends in extents.items():
        for end in ends:
            whole = name == "Whole"
            fit = (not (whole and found[end - 1].indent == found[start].indent), end, whole)
            best[start] = min(best.get(start, fit), fit)
    out = []
    for start, (_, end, whole) in sorted(best.items()):
        head, closer = found[start], found[end - 1]
        doc = None
        first = start - 1
        while first >= 0 and found[first].kind == DOC and not text[found[first].end : found[first + 1].start].strip():
            first -= 1
        if first + 1 < start:
            doc = (found[first + 1].start, found[start - 1].end)
        if not whole:  # it is missing: the function reaches to what comes next
            stop = max(head.end, len(text[: found[end].start if end < len(found) else len(text)].rstrip()))  # heads of one line all start with it
        elif closer.end > closer.start:
            stop = text.find("\n", closer.end)
            stop = len(text) if stop < 0 else stop
        else:
            stop = closer.end
        out.append(Function(head.name, head.start, stop, doc, whole))
    return out
