"""Pass 1 of parsing: one source file to its declarations and references, without looking at other files.

Python goes through the standard library's ast. The other languages go through a small scanner: comments and literals are
blanked out in place, braces give the depth, and declarations are recognised by their heads. Constructs beyond those
named in each function are not seen. A file that cannot be read gives an `error` and no entities.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

# Suffixes by language (one table for discovery, parsing and caching).
EXTENSIONS = {
    "java": (".java",), "python": (".py",), "kotlin": (".kt", ".kts"), "go": (".go",),
    "typescript": (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), "c": (".c", ".h", ".cpp", ".hpp", ".cc", ".cxx"),
}
LANGUAGE_OF = {ext: language for language, exts in EXTENSIONS.items() for ext in exts}
#: Go and TypeScript files beyond this size are not parsed.
SIZE_LIMIT = 1_000_000


@dataclass
class Declared:
    fqn: str
    name: str
    kind: str
    imports: list[str] = field(default_factory=list)
    superclass: str | None = None
    interfaces: list[str] = field(default_factory=list)
    owner: str | None = None
    is_data: bool = False
    is_sealed: bool = False
    refs: list[str] = field(default_factory=list)


@dataclass
class Facts:
    package: str = ""
    entities: list[Declared] = field(default_factory=list)
    imports: list[tuple[str, list[str]]] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    language: str | None = None  # where the file's is not that of its suffix group
    error: str | None = None


def extract(language: str, rel_path: str, text: str) -> Facts:
    try:
        return {"python": python, "java": java, "kotlin": kotlin, "go": go, "typescript": typescript, "c": c_family}[language](rel_path, text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return Facts(error=f"{type(e).__name__}: {e}"[:200])


# Python ------------------------------------------------------------------------------------------------------------------


def _name_of(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (base := _name_of(node.value)):
        return f"{base}.{node.attr}"
    return None


def _used(node: ast.AST) -> set[str]:
    """Names used at run time: annotations are passed over."""
    out: set[str] = set()
    todo: list[ast.AST] = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, ast.Name):
            out.add(n.id)
        elif isinstance(n, ast.Attribute) and (full := _name_of(n)):
            out.add(full)
        for name, value in ast.iter_fields(n):
            if name not in ("annotation", "returns"):
                todo += [v for v in (value if isinstance(value, list) else [value]) if isinstance(v, ast.AST)]
    if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
        out.add(node.name)
    return out


def python(rel_path: str, text: str) -> Facts:
    """Top-level classes, their methods, top-level functions, else the module itself; plain and from-imports."""
    parts = rel_path.removesuffix(".py").split("/")
    if parts[-1] == "__init__":
        parts.pop()
    module = ".".join(parts)
    out = Facts(package=".".join(parts[:-1]) if len(parts) > 1 else module)
    tree = ast.parse(text)
    for node in tree.body:
        if isinstance(node, ast.Import):
            out.imports += [(a.name, []) for a in node.names if a.asname is None]
        elif isinstance(node, ast.ImportFrom):
            out.imports.append(("." * node.level + (node.module or ""), [a.name for a in node.names if a.asname is None and a.name != "*"]))
    flat = [f"{m}.{n}" for m, names in out.imports for n in names] + [m for m, names in out.imports if not names]
    dot = f"{module}." if module else ""
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            bases = [b for b in map(_name_of, node.bases) if b]
            fqn = dot + node.name
            out.entities.append(Declared(fqn, node.name, "class", flat, bases[0] if bases else None, bases[1:], refs=sorted(_used(node))))
            for sub in node.body:
                if isinstance(sub, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    out.entities.append(Declared(f"{fqn}.{sub.name}", sub.name, "method", flat, owner=fqn, refs=sorted(_used(sub))))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.entities.append(Declared(dot + node.name, node.name, "function", flat, refs=sorted(_used(node))))
    if not out.entities and not rel_path.endswith("__init__.py") and module:
        out.entities.append(Declared(module, parts[-1], "module", flat, refs=sorted(_used(tree))))
    return out


# Brace languages ---------------------------------------------------------------------------------------------------------

_LITERAL = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`[^`]*`?", re.S)


#: The same with regular expressions, which stand where a value may begin.
_LITERAL_OR_PATTERN = re.compile(_LITERAL.pattern + r"|(?<=[=(,:;!&|?{}\[+\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*", re.S)


def blank(text: str, keep: str = "", patterns: bool = False) -> str:
    """Comments and the insides of literals as spaces, so that positions stay. keep: quotes whose text is needed."""

    def wipe(m: re.Match) -> str:
        s = m.group()
        if s[0] in keep and s[0] in "\"'`":
            return s
        return re.sub(r"[^\n]", " ", s)

    return (_LITERAL_OR_PATTERN if patterns else _LITERAL).sub(wipe, text)


def depths(code: str) -> list[int]:
    """Brace depth before each character."""
    out, d = [], 0
    for ch in code:
        if ch == "}":
            d = max(0, d - 1)
        out.append(d)
        if ch == "{":
            d += 1
    return out


def _end(code: str, at: int) -> int:
    """Behind the brace that closes the one at `at`."""
    d = 0
    for k in range(at, len(code)):
        d += (code[k] == "{") - (code[k] == "}")
        if d == 0:
            return k + 1
    return len(code)


def _bare(text: str) -> str:
    """Without type parameters and arguments."""
    while (cut := re.sub(r"<[^<>]*>", "", text)) != text:
        text = cut
    return text


def _types(text: str) -> list[str]:
    """Type names of a comma-separated list, type arguments dropped."""
    return [m.group() for part in _bare(text).split(",") if (m := re.search(r"[A-Za-z_][\w.]*", part))]


_NOT_METHODS = frozenset("if for while switch catch return new throw synchronized else try do super this assert when yield".split())


def java(rel_path: str, text: str) -> Facts:
    """Top-level classes, interfaces and enums with their methods and constructors."""
    code = blank(text)
    depth = depths(code)
    pack = re.search(r"^\s*package\s+([\w.]+)\s*;", code, re.M)
    out = Facts(package=pack[1] if pack else "")
    out.imports = [(m[1], []) for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", code, re.M)]
    flat = [m for m, _ in out.imports]
    dot = f"{out.package}." if out.package else ""
    for m in re.finditer(r"(?<!@)\b(class|interface|enum)\s+([A-Za-z_]\w*)([^{;]*)\{", code):
        if depth[m.start()] != 0:
            continue
        head = _bare(m[3])
        sup = re.search(r"\bextends\s+([A-Za-z_][\w.]*)", head) if m[1] == "class" else None
        impl = re.search(r"\bimplements\s+(.*)", head, re.S)
        fqn = dot + m[2]
        out.entities.append(Declared(fqn, m[2], m[1], flat, sup[1] if sup else None, _types(impl[1]) if impl else []))
        start, end = m.end() - 1, _end(code, m.end() - 1)
        for f in re.finditer(r"([A-Za-z_]\w*)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:throws\s+[\w.,\s]+)?(?=[{;])", code[start:end]):
            at = start + f.start()
            before = code[max(0, at - 2) : at]
            if depth[at] == 1 and f[1] not in _NOT_METHODS and not before.rstrip().endswith((".", "=", "@")) and not re.search(r"\bnew\s*$", code[max(0, at - 8) : at]) and "=" not in code[max(code.rfind(";", 0, at), code.rfind("}", 0, at), code.rfind("{", 0, at)) + 1 : at]:
                out.entities.append(Declared(f"{fqn}.{f[1]}", f[1], "method", flat, owner=fqn))
    return out


_KOTLIN_TYPE = re.compile(r"((?:\b(?:public|private|internal|protected|abstract|open|final|data|sealed|enum|annotation|inner|value|companion|fun)\s+)*)\b(class|interface|object)\b[ \t]*([A-Za-z_]\w*)?")


def kotlin(rel_path: str, text: str) -> Facts:
    """Classes, objects, interfaces and enums, nested and companion ones too, their methods, and top-level functions."""
    code = blank(text)
    depth = depths(code)
    pack = re.search(r"^\s*package\s+([\w.]+)", code, re.M)
    out = Facts(package=pack[1] if pack else "")
    for m in re.finditer(r"^\s*import\s+([\w.]+(?:\.\*)?)(?:\s+as\s+(\w+))?", code, re.M):
        out.imports.append((m[1], []))
        if m[2]:
            out.aliases[m[2]] = m[1]
    flat = [m for m, _ in out.imports]
    dot = f"{out.package}." if out.package else ""
    spans: list[tuple[int, int, str]] = []  # bodies of the types found so far
    for m in _KOTLIN_TYPE.finditer(code):
        owners = [s for s in spans if s[0] < m.start() < s[1]]
        if depth[m.start()] != len(owners):
            continue
        name = m[3] or ("Companion" if "companion" in m[1] else None)
        if name is None:
            continue
        owner = owners[-1][2] if owners else None
        fqn = f"{owner}.{name}" if owner else dot + name
        k, level = m.end(), 0  # the head ends at the body, or at a line that does not go on
        while k < len(code) and not (level == 0 and (code[k] == "{" or (code[k] == "\n" and not re.match(r"\s*[:({,]", code[k:]) and not code[m.end() : k].rstrip().endswith((",", ":"))))):
            level += (code[k] in "(<") - (code[k] in ")>")
            k += 1
        head = code[m.end() : k]
        parents = re.search(r"(?:\)|^|>|\w)\s*:\s*(.+)$", re.sub(r"^\s*(?:<[^>]*>)?\s*(?:\w+\s+constructor\s*)?(?:\((?:[^()]|\([^()]*\))*\))?", "", head), re.S)
        sup, faces = None, []
        if parents:
            for part in re.split(r",(?![^(<]*[)>])", parents[1]):
                if t := re.match(r"\s*([A-Za-z_][\w.]*)\s*(?:<[^>]*>)?\s*(\()?", part):
                    if t[2] and m[2] != "interface" and sup is None:
                        sup = t[1]
                    else:
                        faces.append(t[1])
        kind = "enum" if "enum" in m[1].split() else m[2]
        out.entities.append(Declared(fqn, name, kind, flat, sup, faces, owner, "data" in m[1].split(), "sealed" in m[1].split()))
        if k < len(code) and code[k] == "{":
            spans.append((k, _end(code, k), fqn))
    for m in re.finditer(r"\bfun\s+(?:<[^>]*>\s*)?(?:[A-Za-z_][\w.<>?]*\.)?([A-Za-z_]\w*)\s*\(", code):
        owners = [s for s in spans if s[0] < m.start() < s[1]]
        if depth[m.start()] == len(owners):
            owner = owners[-1][2] if owners else None
            out.entities.append(Declared(f"{owner}.{m[1]}" if owner else dot + m[1], m[1], "method" if owner else "function", flat, owner=owner))
    return out


def go(rel_path: str, text: str) -> Facts:
    """Types, structs, interfaces, functions and methods; the package is the directory. Tests and large files are skipped."""
    if rel_path.endswith("_test.go") or len(text.encode()) > SIZE_LIMIT:
        return Facts()
    code = blank(text, keep='"')
    depth = depths(code)
    out = Facts(package=".".join(rel_path.split("/")[:-1]))
    for block in re.finditer(r"^import\s*(?:\(([^)]*)\)|((?:\w+\s+)?\"[^\"]+\"))", code, re.M):
        for m in re.finditer(r"(?:([\w.]+)\s+)?\"([^\"]+)\"", block[1] or block[2]):
            out.imports.append((m[2], [m[1] or m[2].rsplit("/", 1)[-1]]))
    flat = [m for m, _ in out.imports]
    dot = f"{out.package}." if out.package else ""
    code = blank(code)
    heads: list[tuple[int, int, Declared]] = []
    for m in re.finditer(r"^(?:type\s+([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?(struct|interface)?|func\s*(?:\(\s*(?:\w+\s+)?\*?([A-Za-z_]\w*)[^)]*\)\s*)?([A-Za-z_]\w*)\s*[\[(])", code, re.M):
        if depth[m.start()] != 0:
            continue
        if m[1]:
            d = Declared(dot + m[1], m[1], m[2] or "type", flat)
        elif m[3]:
            d = Declared(f"{dot}{m[3]}.{m[4]}", m[4], "method", flat, owner=dot + m[3])
        else:
            d = Declared(dot + m[4], m[4], "function", flat)
        heads.append((m.start(), m.end(), d))
    for group in re.finditer(r"^type\s*\(", code, re.M):
        level, end = 1, group.end()
        while end < len(code) and level:
            level += (code[end] == "(") - (code[end] == ")")
            end += 1
        for m in re.finditer(r"^[ \t]*([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?=?\s*(struct|interface)?", code[group.end() : end], re.M):
            if depth[group.end() + m.start(1)] == 0:
                heads.append((group.end() + m.start(1), group.end() + m.end(), Declared(dot + m[1], m[1], m[2] or "type", flat)))
    heads.sort(key=lambda h: h[0])
    for k, (start, _, d) in enumerate(heads):
        body = code[start : heads[k + 1][0] if k + 1 < len(heads) else len(code)]
        qualified = set(re.findall(r"\b([A-Za-z_]\w*\.[A-Z]\w*)", body))
        bare = set(re.findall(r"(?<![.\w])([A-Za-z_]\w*)", body)) - {d.name}
        d.refs = sorted(qualified | bare)
        out.entities.append(d)
    return out


def typescript(rel_path: str, text: str) -> Facts:
    """Classes with methods, interfaces, enums, functions and constant arrow functions, else the module."""
    if len(text.encode()) > SIZE_LIMIT:
        return Facts()
    module = re.sub(r"\.(?:d\.ts|tsx?|jsx?|mjs|cjs)$", "", rel_path)
    out = Facts(package="/".join(module.split("/")[:-1]))
    kept = blank(text, keep="\"'", patterns=True)
    for m in re.finditer(r"\bimport\s+(?:type\s+)?(?:([\w$*]+)(?:\s+as\s+(\w+))?\s*,?\s*)?(?:\{([^}]*)\}\s*)?from\s*[\"']([^\"']+)[\"']", kept):
        names = [n.split(" as ")[0].replace("type ", "").strip() for n in (m[3] or "").split(",")]
        if m[1] and m[1] != "*":
            names.append(m[1])  # a default import goes by its local name
        elif m[2]:
            names += sorted(set(re.findall(rf"\b{m[2]}\.([A-Za-z_$][\w$]*)", kept)))  # of a namespace, what is used
        out.imports.append((m[4], [n for n in names if n]))
    flat = [m for m, _ in out.imports]
    code = blank(text, patterns=True)
    depth = depths(code)
    head = re.compile(
        r"\b(?:(class|interface|enum)\s+([A-Za-z_$][\w$]*)([^{;]*)\{|function\s*\*?\s*([A-Za-z_$][\w$]*)\s*[(<]|const\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>)"
    )
    for m in head.finditer(code):
        if depth[m.start()] != 0:
            continue
        name = m[2] or m[4] or m[5]
        open_ = code.find("{", m.end() - 1)
        body = code[m.start() : _end(code, open_)] if open_ >= 0 and (m[1] or ";" not in code[m.end() : open_]) else code[m.start() : code.find("\n", m.end()) % (len(code) + 1)]
        refs = sorted(set(re.findall(r"[A-Za-z_$][\w$]*", body)) - {name})
        fqn = f"{module}.{name}"
        d = Declared(fqn, name, m[1] or "function", flat, refs=refs)
        if m[1] == "class":
            sup = re.search(r"\bextends\s+([A-Za-z_$][\w$.]*)", m[3])
            impl = re.search(r"\bimplements\s+(.*)", m[3], re.S)
            d.superclass, d.interfaces = sup[1] if sup else None, _types(impl[1]) if impl else []
        elif m[1] == "interface" and (ext := re.search(r"\bextends\s+(.*)", m[3], re.S)):
            d.interfaces = _types(ext[1])
        out.entities.append(d)
        if m[1] == "class":
            start, end = m.end(), _end(code, m.end() - 1)
            for f in re.finditer(r"(?:^|[;{}\n])\s*(?:(?:public|private|protected|static|async|readonly|abstract|override|get|set)\s+)*([A-Za-z_$#][\w$]*)\s*(?:<[^>]*>)?\([^)]*\)\s*(?::[^{;]+)?\{", code[start:end]):
                at = start + f.start(1)
                if depth[at] == 1 and f[1] not in _NOT_METHODS:
                    inner = code[at : _end(code, code.find("{", start + f.end() - 1))]
                    out.entities.append(Declared(f"{fqn}.{f[1]}", f[1], "method", flat, owner=fqn, refs=sorted(set(re.findall(r"[A-Za-z_$][\w$]*", inner)))))
    if not out.entities:
        out.entities.append(Declared(module, module.split("/")[-1], "module", flat, refs=sorted(set(re.findall(r"[A-Za-z_$][\w$]*", code)))))
    return out


def c_family(rel_path: str, text: str) -> Facts:
    """Functions, structs, unions, enums and, in C++, classes, wherever they stand; else the file as a module."""
    cpp = rel_path.endswith((".cpp", ".hpp", ".cc", ".cxx"))
    out = Facts(package="/".join(rel_path.split("/")[:-1]), language="cpp" if cpp else "c")
    kept = blank(text, keep='"')
    out.imports = [(m[1], []) for m in re.finditer(r"^\s*#\s*include\s*[\"<]([^\">]+)[\">]", kept, re.M)]
    flat = [m for m, _ in out.imports]
    code = re.sub(r"^\s*#[^\n]*", lambda m: " " * len(m.group()), blank(text), flags=re.M)
    key = re.sub(r"\.[^./]*$", "", rel_path)
    seen: set[str] = set()

    def add(name: str, kind: str, bases: list[str]) -> None:
        if name not in seen:
            seen.add(name)
            out.entities.append(Declared(f"{key}::{name}", name, kind, flat, bases[0] if bases else None, bases[1:]))

    words = "struct|union|enum(?:\\s+class)?" + ("|class" if cpp else "")
    for m in re.finditer(rf"\b({words})\s+([A-Za-z_]\w*)\s*(?:final\s*)?(?::([^{{;]*))?\{{", code):
        bases = [re.sub(r"\b(?:public|private|protected|virtual)\b", "", b).strip() for b in (m[3] or "").split(",")] if not m[1].startswith("enum") else []
        add(m[2], m[1].split()[0], [b for b in _types(",".join(bases))])
    for m in re.finditer(r"(?:^|[;}\n])\s*(?:[A-Za-z_][\w:<>,*&\s]*?[\s*&])([A-Za-z_][\w:~]*)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:const\s*)?(?:noexcept\s*)?\{", code):
        name = m[1].split("::")[-1]
        if name not in _NOT_METHODS:
            add(name, "function", [])
    if not out.entities:
        out.entities.append(Declared(key, key.split("/")[-1], "module", flat))
    return out
