"""Per-file extraction of raw nodes and edges, a table function over files.

Ids follow one scheme for all languages but Rust: a file is its stem in lower
case, a symbol ``stem_symbol``, a method ``stem_class_method``. Edges are
``contains``, ``method``, ``inherits`` (from the base to the derived type) and
``imports_from``. Python is parsed by its own parser and Markdown line by line;
the other languages are read by scanners that follow nesting of braces after
strings and comments are blanked out, and know declarations, not the whole grammar.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ranked

EXTRACTED, INFERRED = "EXTRACTED", "INFERRED"


@dataclass
class Rows:
    """What a file yields, in order."""

    path: str
    text: str
    nodes: list[tuple] = field(default_factory=list)
    edges: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.stem = stem(self.path)
        self._lines = [0]
        for m in re.finditer("\n", self.text):
            self._lines.append(m.end())

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_right(self._lines, at)

    def node(self, label: str, start: int = 0, end: int | None = None) -> None:
        end = len(self.text) if end is None else end
        b = lambda k: len(self.text[:k].encode())
        self.nodes.append((label, b(start), b(end), self.line(start), self.line(max(start, end - 1))))

    def edge(self, source: str, target: str, relation: str, confidence: str = EXTRACTED) -> None:
        self.edges.append((source, target, relation, confidence))


def stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return (name.rsplit(".", 1)[0] if "." in name[1:] else name).lower()


def method_id(name: str) -> str:
    return name.strip("_") or name


def slug(text: str) -> str:
    return "_".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


# --- Python ------------------------------------------------------------------


def python(rows: Rows) -> None:
    """Classes, functions and ``from`` imports at the top, methods of classes; decorated definitions aren't taken."""
    b, text = rows.stem, rows.text
    rows.node(b)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    starts = [0]
    for line in text.encode().split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    raw = text.encode()

    def span(n) -> tuple[int, int]:
        at = lambda line, col: len(raw[: starts[line - 1] + col].decode(errors="ignore"))
        return at(n.lineno, n.col_offset), at(n.end_lineno, n.end_col_offset)

    classes = {n.name for n in tree.body if isinstance(n, ast.ClassDef) and not n.decorator_list}
    for n in tree.body:
        if isinstance(n, ast.ImportFrom):
            module = "." * n.level + (n.module or "")
            if module != "__future__":
                rows.edge(b, module.lower(), "imports_from")
        elif getattr(n, "decorator_list", None):
            continue
        elif isinstance(n, ast.ClassDef):
            own = f"{b}_{n.name}".lower()
            rows.node(own, *span(n))
            rows.edge(b, own, "contains")
            for base in n.bases:
                if isinstance(base, ast.Name):
                    rows.edge(f"{b}_{base.id}".lower() if base.id in classes else base.id.lower(), own, "inherits")
            for m in n.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)) and not m.decorator_list:
                    label = f"{b}_{n.name}_{method_id(m.name)}".lower()
                    rows.node(label, *span(m))
                    rows.edge(own, label, "method")
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            own = f"{b}_{n.name}".lower()
            rows.node(own, *span(n))
            rows.edge(b, own, "contains")


# --- Text --------------------------------------------------------------------

_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_LINK = re.compile(r"\[[^\]\n]*\]\(([^)\n]*)\)")


def markdown(rows: Rows) -> None:
    """Headings outside fences, and links to other Markdown files."""
    b = rows.stem
    rows.node(b)
    if rows.path.rsplit(".", 1)[-1].lower() not in ("md", "markdown"):
        return
    at, fence = 0, None
    for line in rows.text.split("\n"):
        plain, start = line.rstrip("\r"), at
        at += len(line) + 1
        if m := _FENCE.match(plain):
            mark = m[1][0]
            fence = mark if fence is None else None if fence == mark else fence
            continue
        if fence:
            continue
        if m := _HEADING.match(plain):
            title = re.sub(r"(^|[ \t]+)#+$", "", m[2] or "").strip()
            if s := slug(title):
                rows.node(f"{b}_{s}", start, start + len(plain))
                rows.edge(b, f"{b}_{s}", "contains")
        for m in _LINK.finditer(plain):
            target = m[1].strip()
            if target.startswith(("http://", "https://", "#")):
                continue
            target = re.split(r"[ #?]", target, maxsplit=1)[0]
            if target.rsplit(".", 1)[-1].lower() in ("md", "markdown") and "." in target:
                rows.edge(b, stem(target), "references")


# --- Languages with braces ---------------------------------------------------

_STRINGS = {
    "c": r'/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "js": r'/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`',
    "go": r'/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])+\'',
    "rust": r'/\*.*?\*/|//[^\n]*|r#*".*?"#*|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])\'',
    "php": r'/\*.*?\*/|(?://|#(?!\[))[^\n]*|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'',
}


def blank(text: str, kind: str) -> str:
    """Text of the same length without comments and what stands in strings."""
    keep = lambda m: m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if m[0][0] in "\"'`" else re.sub(r"[^\n]", " ", m[0])
    return re.sub(_STRINGS[kind], keep, text, flags=re.S)


def depths(code: str) -> list[int]:
    """Nesting of braces at each place."""
    out, d = [], 0
    for c in code:
        if c == "}":
            d = max(0, d - 1)
        out.append(d)
        if c == "{":
            d += 1
    return out


def body(code: str, at: int) -> tuple[int, int]:
    """The braces that open at or behind ``at``: inside from, to; (at, at) where a statement ends first."""
    k = at
    while k < len(code) and code[k] not in "{;":
        k += 1
    if k >= len(code) or code[k] == ";":
        return at, at
    d, j = 0, k
    while j < len(code):
        d += (code[j] == "{") - (code[j] == "}")
        if not d:
            break
        j += 1
    return k + 1, j


def _level(code: str, depth: list[int], lo: int, hi: int, want: int, pattern: str):
    for m in re.finditer(pattern, code[lo:hi], re.M):
        if depth[lo + m.start()] == want:
            yield m, lo + m.start()


def _type(rows: Rows, name: str, start: int, end: int, owner: str) -> str:
    own = f"{rows.stem}_{name}".lower()
    rows.node(own, start, end)
    rows.edge(owner, own, "contains")
    return own


def _method(rows: Rows, cls: str, name: str, start: int, end: int, plain: bool = True) -> None:
    label = f"{cls}_{method_id(name) if plain else name}".lower()
    rows.node(label, start, end)
    rows.edge(cls, label, "method")


def _inherits(rows: Rows, own: str, bases: list[str], local: set[str]) -> None:
    for base in bases:
        if base:
            rows.edge(f"{rows.stem}_{base}".lower() if base in local else base.lower(), own, "inherits")


def _bases(text: str) -> list[str]:
    """Names in a list of types, without type arguments and calls."""
    while re.search(r"<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]", text):
        text = re.sub(r"<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]", "", text)
    return [x.strip() for x in re.split(r",|\bwith\b", text) if x.strip()]


def go(rows: Rows) -> None:
    code, b = blank(rows.text, "go"), rows.stem
    depth = depths(code)
    rows.node(b)
    for m, at in _level(code, depth, 0, len(code), 0, r"^func\s+(?:\(\s*(?:\w+\s+)?(\*?)\s*([\w.]+)(\[)?[^)]*\)\s*)?(\w+)"):
        lo, hi = body(code, at)
        if m[2]:
            if not m[3] and "." not in m[2]:
                _method(rows, f"{b}_{m[2]}".lower(), m[4], at, hi + 1, plain=False)
        else:
            _type(rows, m[4], at, hi + 1, b)
    for m, at in _level(code, depth, 0, len(code), 0, r"^type\s+(?:(\w+)|\()"):
        if m[1]:
            _type(rows, m[1], at, at + len(m[0]), b)
        else:
            end = code.find("\n)", at)
            for t in re.finditer(r"^\s*(\w+)\s+\S", code[at + len(m[0]) : end], re.M):
                if depth[at + len(m[0]) + t.start(1)] == 0:
                    _type(rows, t[1], at, end, b)
    for m, at in _level(code, depth, 0, len(code), 0, r"^import\s*(\(|\"|\w+\s*\"|\.\s*\"|_\s*\")"):
        end = code.find(")", at) if m[1] == "(" else code.find("\n", at)
        for path in re.findall(r"\"([^\"\n]*)\"|`([^`]*)`", rows.text[at : end if end > 0 else len(code)]):
            rows.edge(b, (path[0] or path[1]).lower(), "imports_from")


_JS_WORDS = {"if", "for", "while", "switch", "catch", "function", "return", "with", "new", "super", "await", "typeof"}


def _script(rows: Rows, typed: bool) -> None:
    code, b = blank(rows.text, "js"), rows.stem
    depth = depths(code)
    rows.node(b)
    lead = r"^(?:export\s+(?:default\s+)?)?(?:declare\s+)?"
    kinds = r"class|interface|enum" if typed else "class"
    heads = [(m, at) for m, at in _level(code, depth, 0, len(code), 0, lead + rf"(?:abstract\s+|const\s+(?=enum))?({kinds})\s+([\w$]+)([^{{]*)\{{")]
    local = {m[2] for m, _ in heads if m[1] != "enum"}
    for m, at in _level(code, depth, 0, len(code), 0, lead + (r"(?:async\s+)?function\s+([\w$]+)" if typed else r"(?:async\s+)?function\s*\*?\s*([\w$]+)")):
        _type(rows, m[1], at, body(code, at)[1] + 1, b)
    arrow = r"const\s+([\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b|(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w$]+)\s*(?::[^=\n{]+)?=>)"
    for m, at in _level(code, depth, 0, len(code), 0, lead + arrow):
        _type(rows, m[1], at, at + len(m[0]), b)
    for m, at in heads:
        lo, hi = body(code, at)
        own = _type(rows, m[2], at, hi + 1, b)
        if m[1] == "class":
            if e := re.search(r"\bextends\s+([\w$]+)(?![\w$.(])", m[3]):
                _inherits(rows, own, [e[1]], local)
            if typed and (i := re.search(r"\bimplements\s+(.*)", m[3], re.S)):
                _inherits(rows, own, [x.strip() for x in re.split(r",(?![^<]*>)", i[1]) if re.fullmatch(r"[\w$]+", x.strip())], local)
            member = r"^\s*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*(#?[\w$]+)\s*(?:<[^>(]*>)?\(([^;{]*)\{"
            for f, where in _level(code, depth, lo, hi, depth[lo] if lo < len(depth) else 1, member):
                if f[1] not in _JS_WORDS:
                    name = f[1] if typed else f[1].lstrip("#")
                    start = where + len(f[0]) - len(f[0].lstrip())
                    _method(rows, own, name, start, body(code, start)[1] + 1)
    for m, at in _level(code, depth, 0, len(code), 0, r"^import\b[^;'\"]*(?:\{[^}]*\}[^;'\"]*)?(['\"])"):
        path = re.match(r"[^'\"]*(['\"])([^'\"\n]*)\1", rows.text[at:])
        if path and (path[2] or not typed):
            rows.edge(b, path[2].lower(), "imports_from")


def javascript(rows: Rows) -> None:
    _script(rows, False)


def typescript(rows: Rows) -> None:
    _script(rows, True)


def rust(rows: Rows) -> None:
    """Bare names, no node for the file; ``defines`` from a type to its functions, ``calls`` are guesses."""
    code = blank(rows.text, "rust")
    for m in re.finditer(r"\b(fn|struct|enum|trait|mod)\s+(\w+)", code):
        rows.node(m[2], m.start(), max(m.end(), body(code, m.end())[1]))
    for m in re.finditer(r"\bimpl\b(?:\s*<[^{]*?>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)[^{;]*\{", code):
        lo, hi = body(code, m.start())
        for f in re.finditer(r"\bfn\s+(\w+)", code[lo:hi]):
            rows.edge(m[1], f[1], "defines")
    for m in re.finditer(r"\bfn\s+(\w+)", code):
        lo, hi = body(code, m.end())
        for c in re.finditer(r"((?:\w+(?:::|\.))*\w+)\s*\(", code[lo:hi]):
            if c[1] not in ("if", "while", "match", "for", "return", "fn", "loop") and not re.search(r"\bfn\s+$", code[lo : lo + c.start()]):
                rows.edge(m[1], c[1], "calls", INFERRED)


def _classes(rows: Rows, kind: str, heads: str, methods: str | None, bases: Callable[[re.Match], list[str]], imports: list[tuple[str, Callable[[re.Match], list[str]]]], functions: str | None = None, transparent: str | None = None, plain: bool = True, quiet: tuple[str, ...] = ()) -> None:
    """Types with members. ``quiet``: kinds of types whose members aren't taken."""
    code, b = blank(rows.text, kind), rows.stem
    depth = depths(code)
    rows.node(b)
    zones = [(0, len(code), 0)]
    if transparent:
        for m in re.finditer(transparent, code, re.M):
            lo, hi = body(code, m.start())
            if hi > lo:
                zones.append((lo, hi, depth[lo]))
    found = [(m, at) for lo, hi, want in zones for m, at in _level(code, depth, lo, hi, want, heads)]
    local = {m["name"] for m, _ in found if m["kind"] not in ("enum",) or kind in ("c", "php")}
    if functions:
        for lo, hi, want in zones:
            for m, at in _level(code, depth, lo, hi, want, functions):
                if m["name"] not in ("if", "for", "while", "switch", "return", "catch", "else", "new"):
                    _type(rows, m["name"], at, body(code, at)[1] + 1, b)
    for m, at in found:
        lo, hi = body(code, at)
        own = _type(rows, m["name"], at, hi + 1, b)
        _inherits(rows, own, bases(m), local)
        if methods and m["kind"] not in quiet and hi > lo:
            for f, where in _level(code, depth, lo, hi, depth[lo], methods):
                if f["name"] not in ("if", "for", "while", "switch", "return", "catch", "else", "new"):
                    _method(rows, own, f["name"], where, body(code, where)[1] + 1, plain)
    for pattern, targets in imports:
        for m in re.finditer(pattern, rows.text, re.M):
            if depth[m.start()] == 0 or transparent:
                for t in targets(m):
                    rows.edge(b, t.lower(), "imports_from")


def java(rows: Rows) -> None:
    mods = r"(?:(?:public|private|protected|static|final|abstract|sealed|default|synchronized|native|strictfp)\s+)*"
    heads = rf"^\s*{mods}(?P<kind>class|interface|enum)\s+(?P<name>\w+)(?P<rest>[^{{;]*)\{{"
    member = rf"^\s*{mods}(?:<[^>]+>\s*)?(?:[\w<>\[\].,? ]+\s+)?(?P<name>\w+)\s*\([^;{{]*\)\s*(?:throws[^{{;]*)?\{{"

    def bases(m: re.Match) -> list[str]:
        rest = re.sub(r"^\s*<.*?>", "", m["rest"])
        out = [x for part in re.findall(r"\b(?:extends|implements)\s+((?:(?!\bimplements\b|\bextends\b|\bpermits\b).)*)", rest, re.S) for x in _bases(part)]
        return [x for x in out if re.fullmatch(r"\w+", x)]

    _classes(rows, "c", heads, member, bases, [(r"^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;", lambda m: [m[1]])], quiet=("interface",))


def csharp(rows: Rows) -> None:
    mods = r"(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|virtual|override|async|extern|new|unsafe|ref)\s+)*"
    heads = rf"^\s*{mods}(?P<kind>class|interface|struct|enum)\s+(?P<name>\w+)(?P<rest>[^{{;]*)\{{"
    member = rf"^\s*{mods}(?:[\w<>\[\].,?]+\s+)?(?P<name>\w+)\s*(?:<[^>(]*>)?\([^;{{]*\)\s*(?::[^{{;]*)?(?:where[^{{;]*)?(?:\{{|=>)"

    def bases(m: re.Match) -> list[str]:
        return [x for x in _bases(m["rest"].split(":", 1)[1].split("where")[0]) if re.fullmatch(r"\w+", x)] if ":" in m["rest"] and m["kind"] != "interface" else []

    _classes(rows, "c", heads, member, bases, [(r"^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;", lambda m: [m[1]])], transparent=r"^\s*namespace\s+[\w.]+\s*\{", quiet=("interface", "enum"))


def c(rows: Rows) -> None:
    code, b = blank(rows.text, "c"), rows.stem
    depth = depths(code)
    rows.node(b)
    for m, at in _level(code, depth, 0, len(code), 0, r"^(?!typedef\b)(?:[\w*]+[\s*]+)+(\w+)\s*\([^;{}]*\)\s*\{"):
        if m[1] not in ("if", "for", "while", "switch"):
            _type(rows, m[1], at, body(code, at)[1] + 1, b)
    for m, at in _level(code, depth, 0, len(code), 0, r"^(typedef\s+)?(?:struct|union)\s+(\w+)\s*\{"):
        _type(rows, m[2], at, body(code, at)[1] + 1, b)
    for m, at in _level(code, depth, 0, len(code), 0, r"^typedef\b"):
        end = at
        while end < len(code) and not (code[end] == ";" and depth[end] == 0):
            end += 1
        if name := re.search(r"(\w+)\s*(?:\[[^\]]*\])?\s*$|\(\s*\*\s*(\w+)\s*\)\s*\([^)]*\)\s*$", code[at:end]):
            _type(rows, name[2] or name[1], at, end, b)
    conditional = 0
    for line in rows.text.split("\n"):
        if m := re.match(r"\s*#\s*(if|ifdef|ifndef|endif|include)\b\s*(?:[<\"]([^>\"]+)[>\"])?", line):
            conditional += m[1].startswith("if") - (m[1] == "endif")
            if m[1] == "include" and m[2] and conditional <= 0:
                rows.edge(b, m[2].lower(), "imports_from")


def cpp(rows: Rows) -> None:
    heads = r"^\s*(?P<kind>class|struct)\s+(?P<name>\w+)(?P<rest>[^{;()]*)\{"
    member = r"^\s*(?:(?:virtual|static|inline|explicit|constexpr|friend)\s+)*(?:[\w:<>,&*]+[\s&*]+)+(?P<name>\w+)\s*\([^;{]*\)[^;{]*\{"
    function = r"^(?:(?:static|inline|constexpr|extern)\s+)*(?:[\w:<>,&*]+[\s&*]+)+(?:\w+::)*(?P<name>\w+)\s*\([^;{]*\)[^;{]*\{"

    def bases(m: re.Match) -> list[str]:
        rest = m["rest"].split(":", 1)[1] if ":" in m["rest"] else ""
        return [re.sub(r"\b(?:public|private|protected|virtual)\b", "", x).strip().split("::")[-1] for x in _bases(rest)]

    _classes(rows, "c", heads, member, bases, [(r"^\s*#\s*include\s*[<\"]([^>\"\n]+)", lambda m: [m[1]])], functions=function, transparent=r"^\s*namespace\b[^{;]*\{", plain=False)


def kotlin(rows: Rows) -> None:
    mods = r"(?:(?:public|private|internal|protected|open|abstract|sealed|data|inner|enum|annotation|override|suspend|inline|operator|infix|tailrec|const|companion|fun(?=\s+interface))\s+)*"
    heads = rf"^\s*{mods}(?P<kind>class|interface|object)\s+(?P<name>\w+)(?P<rest>[^{{\n]*)"
    member = rf"^\s*{mods}(?:fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?(?P<name>\w+)\s*\()"

    def bases(m: re.Match) -> list[str]:
        rest = re.sub(r"^\s*(?:<[^>]*>)?\s*(?:private\s+constructor\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?", "", m["rest"])
        return [x.split(".")[-1] for x in _bases(rest.split(":", 1)[1]) if " by " not in f" {x} "] if rest.lstrip().startswith(":") else []

    _classes(rows, "c", heads, member, bases, [(r"^import\s+([\w.]+?)(?:\.\*)?(?:\s+as\s+\w+)?\s*$", lambda m: [m[1]])], functions=member)


def scala(rows: Rows) -> None:
    mods = r"(?:(?:private|protected|final|sealed|abstract|implicit|lazy|override|case)\s+)*"
    heads = rf"^\s*{mods}(?P<kind>class|trait|object)\s+(?P<name>\w+)(?P<rest>[^{{\n]*)"
    member = rf"^\s*{mods}def\s+(?P<name>\w+)"

    def bases(m: re.Match) -> list[str]:
        e = re.search(r"\bextends\s+(.*)", m["rest"], re.S)
        return [x.split(".")[-1] for x in _bases(e[1])] if e else []

    def imports(m: re.Match) -> list[str]:
        head, _, chosen = m[1].strip().partition(".{")
        if chosen:
            return [f"{head}.{re.split('=>|as', x)[0].strip()}" for x in chosen.rstrip("} ").split(",") if x.strip()]
        return [re.sub(r"\._$|\.\*$", "", head)]

    _classes(rows, "c", heads, member, bases, [(r"^import\s+([^\n]+)", imports)], functions=member)


def php(rows: Rows) -> None:
    mods = r"(?:(?:public|private|protected|static|final|abstract|readonly)\s+)*"
    heads = rf"^\s*{mods}(?P<kind>class|interface|trait|enum)\s+(?P<name>\w+)(?P<rest>[^{{;]*)\{{"
    member = rf"^\s*{mods}function\s+&?(?P<name>\w+)\s*\("

    def bases(m: re.Match) -> list[str]:
        out = [x for part in re.findall(r"\b(?:extends|implements)\s+((?:(?!\bimplements\b).)*)", m["rest"], re.S) for x in _bases(part)]
        return [x.lstrip("\\") for x in out]

    def uses(m: re.Match) -> list[str]:
        head, _, chosen = m[1].partition("{")
        if chosen:
            return [head.strip() + x.split(" as ")[0].strip() for x in chosen.rstrip("} ").split(",") if x.strip()]
        return [x.split(" as ")[0].strip().lstrip("\\") for x in head.split(",")]

    _classes(rows, "php", heads, member, bases, [(r"^use\s+(?:function\s+|const\s+)?([^;(]+);", uses)], functions=r"^function\s+&?(?P<name>\w+)\s*\(")


def ruby(rows: Rows) -> None:
    """By indentation of ``end``: types and methods at the top, methods of types."""
    b = rows.stem
    rows.node(b)
    lines, at, stack, local = rows.text.split("\n"), 0, [], set()
    local = {m[1] for m in re.finditer(r"^(?:class|module)\s+(\w+)", rows.text, re.M)}
    for line in lines:
        start, plain = at, line.strip()
        at += len(line) + 1
        end = start + len(line)
        if m := re.match(r"(class|module)\s+([A-Z]\w*)(?:\s*<\s*([A-Z]\w*)\s*$)?", plain):
            if not stack:
                own = _type(rows, m[2], start, end, b)
                if m[1] == "class" and m[3]:
                    _inherits(rows, own, [m[3]], local)
                stack.append(("type", own))
            else:
                stack.append(("inner", ""))
        elif m := re.match(r"def\s+(?:self\.)?([\w?!=]+)", plain):
            if not stack:
                _type(rows, method_id(m[1]), start, end, b)
            elif len(stack) == 1 and stack[0][0] == "type":
                _method(rows, stack[0][1], m[1], start, end)
            if not re.search(r"\bend\s*$|=\s*\S", plain[m.end() :]) or plain.endswith("="):
                stack.append(("def", ""))
        elif re.match(r"(if|unless|while|until|case|begin|for)\b", plain) or re.search(r"\bdo\b(\s*\|[^|]*\|)?\s*$", plain):
            stack.append(("block", ""))
        elif re.match(r"end\b", plain) and stack:
            stack.pop()
        elif not stack and (m := re.match(r"require(?:_relative)?\s*\(?\s*['\"]([^'\"]+)['\"]", plain)):
            rows.edge(b, m[1].lower(), "imports_from")


EXTRACTORS: dict[str, tuple[tuple[str, ...], Callable[[Rows], None]]] = {
    "rust": (("rs",), rust),
    "python": (("py",), python),
    "typescript": (("ts", "tsx", "mts", "cts"), typescript),
    "javascript": (("js", "jsx", "mjs", "cjs"), javascript),
    "go": (("go",), go),
    "text": (("md", "markdown", "txt", "rst"), markdown),
    "java": (("java",), java),
    "c": (("c", "h"), c),
    "cpp": (("cpp", "cc", "cxx", "hpp", "hxx"), cpp),
    "ruby": (("rb",), ruby),
    "csharp": (("cs",), csharp),
    "kotlin": (("kt", "kts"), kotlin),
    "scala": (("scala", "sc"), scala),
    "php": (("php",), php),
}
BY_EXTENSION = {e: f for exts, f in EXTRACTORS.values() for e in exts}


def extract_one(path: str, content: bytes) -> Rows | None:
    """Rows of one file; None for extensions that no extractor knows."""
    f = BY_EXTENSION.get(path.rsplit(".", 1)[-1].lower())
    if not f:
        return None
    rows = Rows(path, content.decode("utf-8", "replace"))
    f(rows)
    return rows


SCHEMA = "kind string, path string, label string, start_byte bigint, end_byte bigint, start_line bigint, end_line bigint, source string, target string, relation string, confidence string, row_ord bigint, error string"


def extract(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Rows of all files (path, content), of kind node, edge or error: a file that fails doesn't fail the others."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {n: pa.int64() if "bigint" in x else pa.string() for n, x in zip(names, SCHEMA.split(", "), strict=True)}

    def run(batches):
        for b in batches:
            out = []
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = extract_one(p, bytes(data or b""))
                except Exception as x:  # one bad file is a row, not a failed job
                    out.append({"kind": "error", "path": p, "error": str(x)[:500]})
                    continue
                if rows:
                    out += [dict(zip(names[2:7], n, strict=True)) | {"kind": "node", "path": p, "row_ord": k} for k, n in enumerate(rows.nodes)]
                    out += [dict(zip(names[7:11], e, strict=True)) | {"kind": "edge", "path": p, "row_ord": k} for k, e in enumerate(rows.edges)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], kinds[n]) for n in names], names=names)

    return files.select(F.col(path), F.col(content).cast("binary")).mapInArrow(run, SCHEMA)


def raw_tables(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw_nodes and raw_edges with file order by path components, so that ``assemble`` keeps first occurrences."""
    order = F.split("path", "/")
    paths = extracted.select("path").distinct().withColumn("parts", order)
    own = extracted.join(ranked(paths, ["parts"], name="file_ord").select("path", "file_ord"), "path")
    nodes = own.where("kind = 'node'").select("label", F.col("path").alias("source_file"), "start_byte", "end_byte", "start_line", "end_line", "file_ord", "row_ord")
    return nodes, own.where("kind = 'edge'").select("source", "target", "relation", "confidence", "file_ord", "row_ord")
