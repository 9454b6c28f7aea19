"""Import statements of ten languages as rows of ordered candidates.

Each function reads one file's text and yields its import targets; which file a target means is left to a join with the
known paths. Without a grammar library the languages other than Python are read by patterns, comments taken out first.
"""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: A candidate: priority, file or directory, key, whether it is tried under the language's roots, suffix of a directory's files.
CANDIDATE = "struct<prio:int,kind:string,key:string,rooted:boolean,ext:string>"
TARGETS = f"src string, lang string, pos int, tgt int, spec string, kind string, resolvable boolean, fallback boolean, cands array<{CANDIDATE}>"

_C_LIKE = re.compile(r'("(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`[^`]*`)|//[^\n]*|/\*.*?\*/', re.S)
_PHP_LIKE = re.compile(r'("(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\')|//[^\n]*|#(?!\[)[^\n]*|/\*.*?\*/', re.S)
#: Probes for a specifier without its suffix, in order.
JS_PROBES, TS_PROBES = [".js", ".jsx", ".mjs", ".cjs"], [".ts", ".tsx"]
C_PROBES = [".h", ".c", ".hpp", ".cpp", ".hh", ".cc", ".hxx", ".cxx"]


def _plain(code: str, comments: re.Pattern = _C_LIKE) -> str:
    return comments.sub(lambda m: m.group(1) or " ", code)


def _target(spec, kind, cands, resolvable=True, fallback=False, tgt=0):
    out = [(c if len(c) == 5 else (*c, False, "")) for c in cands]
    return {"tgt": tgt, "spec": spec, "kind": kind, "resolvable": resolvable, "fallback": fallback, "cands": [dict(zip(("prio", "kind", "key", "rooted", "ext"), (i, *c[1:]), strict=True)) if c[0] is None else dict(zip(("prio", "kind", "key", "rooted", "ext"), c, strict=True)) for i, c in enumerate(out)]}


def _files(keys, rooted=False):
    return [(None, "file", k, rooted, "") for k in keys]


def _joined(src: str, spec: str) -> str | None:
    """A path relative to a file, without dots; None if it leaves the tree."""
    p = posixpath.normpath(posixpath.join(posixpath.dirname(src), spec.replace("\\", "/").strip()))
    return None if p == ".." or p.startswith(("../", "/")) else "" if p == "." else p


def _module_files(dotted: str) -> list[str]:
    p = dotted.replace(".", "/")
    return [f"{p}.py", f"{p}/__init__.py"] if dotted else []


def _python_statements(code: str) -> Iterator[tuple[str, list[str] | None, int]]:
    try:
        body = ast.parse(code).body
    except (SyntaxError, ValueError, RecursionError):
        # A file that does not parse still says what it imports, at the start of its lines.
        for m in re.finditer(r"^(?:import[ \t]+([^\n#;]+)|from[ \t]+(\.*)([\w.]*)[ \t]+import[ \t]+(\([^)]*\)|[^\n#;]+))", code, re.M):
            names = lambda s: [x.split()[0] for x in re.sub(r"#[^\n]*|[()\\\n]", " ", s).split(",") if x.split()]
            if m[1]:
                yield from ((x, None, 0) for x in names(m[1]))
            else:
                yield m[3], names(m[4]), len(m[2])
        return
    for s in body:
        if isinstance(s, ast.Import):
            yield from ((a.name, None, 0) for a in s.names)
        elif isinstance(s, ast.ImportFrom):
            yield s.module or "", [a.name for a in s.names], s.level


def python_imports(src: str, code: str):
    for module, names, level in _python_statements(code):
        if level:
            parents = posixpath.dirname(src).split("/") if "/" in src else []
            if level - 1 > len(parents):
                continue
            module = ".".join([*parents[: len(parents) - level + 1], *[x for x in module.split(".") if x]])
        own = _files(_module_files(module), True)
        if names is None:
            yield [_target(module, "import", own)]
            continue
        subs = [_target(n, "from", _files(_module_files(f"{module}.{n}" if module else n), True), tgt=i + 1) for i, n in enumerate(names) if n != "*"]
        # The package itself comes last, and only if a name is no module.
        yield [*subs, _target(module, "from", own, fallback=bool(subs) and "*" not in names, tgt=len(names) + 1)]


def js_imports(src: str, code: str):
    code = _plain(code)
    found = [(m.start(), m[1], "import") for m in re.finditer(r"\b(?:import|export)\b(?:[^'\"`;()]*?\bfrom)?\s*['\"]([^'\"]+)['\"]", code)]
    found += [(m.start(), m[2], "require" if m[1] == "require" else "import") for m in re.finditer(r"\b(require|import)\s*\(\s*['\"`]([^'\"`$]+)['\"`]\s*\)", code)]
    first = JS_PROBES + TS_PROBES if src.endswith(tuple(JS_PROBES)) else TS_PROBES + JS_PROBES
    for _, spec, kind in sorted(found):
        if not spec.startswith("."):
            yield [_target(spec, kind, [], resolvable=False)]
            continue
        p = _joined(src, spec)
        yield [_target(spec, kind, _files(dict.fromkeys([p, *(p + e for e in first), *(f"{p}/index{e}" for e in first)])) if p else [])]


def java_imports(src: str, code: str):
    code = _plain(code)
    package = re.search(r"^\s*package\s+([\w.]+)\s*;", code, re.M)
    expected = "/".join([*(package[1].split(".") if package else []), posixpath.basename(src)])
    root = src[: -len(expected)] if src.endswith("/" + expected) else ""
    for m in re.finditer(r"^\s*import\s+(static\s+)?([\w.]+?)(\.\*)?\s*;", code, re.M):
        parts, kind = m[2].split("."), "static" if m[1] else "import"
        if m[3] and not m[1]:
            yield [_target(m[2], kind, [], resolvable=False)]
            continue
        if m[1] and not m[3] and len(parts) > 1:
            parts = parts[:-1]
        keys = ["/".join(parts) + ".java"]
        if len(parts) > 1 and parts[-1][:1].isupper() and parts[-2][:1].isupper():
            keys.append("/".join(parts[:-1]) + ".java")
        own = [(i * 1, "file", root + k, False, "") for i, k in enumerate(keys)] if root else []
        yield [_target(m[2], kind, own + [(i, "file", k, True, "") for i, k in enumerate(keys)])]


def csharp_imports(src: str, code: str):
    for m in re.finditer(r"^\s*(?:global\s+)?using\s+(static\s+)?(?:(\w+)\s*=\s*)?([A-Za-z_][\w.]*)\s*;", _plain(code), re.M):
        parts, kind = m[3].split("."), "static" if m[1] else "import"
        if parts[0].lower() in ("system", "microsoft", "windows"):
            yield [_target(m[3], kind, [])]
            continue
        parent = "/".join(parts[:-1]) + ".cs"
        cands = [(0, "file", "/".join(parts) + ".cs", True, "")]
        cands += [(1, "file", parent, True, "")] if m[1] and len(parts) > 1 else []
        cands += [(2, "dir", "/".join(parts), True, ".cs")]
        cands += [(3, "file", parent, True, "")] if m[2] and len(parts) > 1 else []
        yield [_target(m[3], kind, cands)]


def c_imports(src: str, code: str):
    for m in re.finditer(r'^[ \t]*#[ \t]*include[ \t]*(?:"([^"\n]+)"|<[^>\n]*>|([A-Za-z_]\w*))', _plain(code), re.M):
        if m[2]:
            yield [_target(m[2], "include", [], resolvable=False)]
        elif m[1]:
            p = _joined(src, m[1])
            probes = C_PROBES if "." not in m[1].replace("\\", "/").rsplit("/", 1)[-1] else []
            yield [_target(m[1], "include", _files([p, *(p + e for e in probes)]) if p else [])]


def go_imports(src: str, code: str):
    code = _plain(code)
    for block in re.finditer(r"^import\s*(?:\(([^)]*)\)|([^\n]*))", code, re.M):
        for m in re.finditer(r"[\"`]([^\"`]+)[\"`]", block[1] or block[2] or ""):
            spec = m[1].strip()
            if spec.startswith("."):
                p = _joined(src, spec)
                yield [_target(spec, "import", [] if p is None else [(0, "dir", p, False, ".go")])]
            elif "." in spec:
                parts = [x for x in spec.split("/") if x and x != "."]
                yield [_target(spec, "import", [(i, "dir", "/".join(parts[i:]), False, ".go") for i in range(len(parts))])]
            else:
                yield [_target(spec, "import", [])]


def php_imports(src: str, code: str):
    code = _plain(code, _PHP_LIKE)
    found = []
    for m in re.finditer(r"^\s*use\s+(function\s+|const\s+)?([\w\\]+)\s*(?:\{([^}]*)\})?([^;{]*);", code, re.M):
        names = [n.strip() for n in m[3].split(",") if n.strip()] if m[3] else [m[2], *(n.strip() for n in m[4].split(",")[1:] if n.strip())]
        for n in names:
            member = bool(m[1]) or bool(re.match(r"(function|const)\s", n))
            fqn = re.sub(r"^(function|const)\s+", "", n).split(" as ")[0].split()[0]
            fqn = m[2].strip("\\") + "\\" + fqn if m[3] and "\\" not in fqn else fqn
            parts = [p for p in fqn.split("\\") if p]
            keys = ["/".join(parts) + ".php"] + (["/".join(parts[:-1]) + ".php"] if member and len(parts) > 1 else [])
            found.append((m.start(), _target(fqn, "import", _files(keys, True))))
    for m in re.finditer(r"\b(?:require|include)(?:_once)?\b\s*([^;]*);", code):
        lit = re.match(r"^\(*\s*(?:'([^']+)'|\"([^\"$]+)\")\s*\)*\s*(?:(?:or|and)\b.*|(?:\|\||&&).*)?$", m[1].strip(), re.S)
        spec = lit and (lit[1] or lit[2])
        p = _joined(src, spec) if spec else None
        found.append((m.start(), _target(spec or m[1].strip(), "include", _files([p]) if p else [], resolvable=bool(spec))))
    for _, t in sorted(found, key=lambda x: x[0]):
        yield [t]


def _use_paths(tree: str, prefix: tuple[str, ...] = ()) -> Iterator[tuple[str, ...]]:
    """The paths of a use tree: lists are opened, aliases and stars dropped."""
    tree = tree.strip()
    brace = tree.find("{")
    if brace < 0:
        parts = tuple(x.strip() for x in re.sub(r"\s+as\s+\w+$", "", tree).split("::") if x.strip() not in ("", "*"))
        yield prefix if parts == ("self",) and prefix else prefix + parts
        return
    head = prefix + tuple(x.strip() for x in tree[:brace].split("::") if x.strip())
    depth, item = 0, ""
    for c in tree[brace + 1 : tree.rfind("}")]:
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            yield from _use_paths(item, head) if item.strip() else ()
            item = ""
        else:
            item += c
    if item.strip():
        yield from _use_paths(item, head)


def _without_inline_modules(code: str) -> Iterator[tuple[str, str | None]]:
    """("policy", None) for each inline module, whose body is not read, and ("code", rest) at the end."""
    rest = ""
    while m := re.search(r"\bmod\s+\w+\s*\{", code):
        depth, i = 1, m.end()
        while i < len(code) and depth:
            depth += (code[i] == "{") - (code[i] == "}")
            i += 1
        yield "policy", None
        rest, code = rest + code[: m.start()], code[i:]
    yield "code", rest + code


def rust_imports(src: str, code: str):
    """Modules are files; uses are paths of modules, resolved against the crate's module table (``kind`` use)."""
    name, here = posixpath.basename(src), posixpath.dirname(src)
    base = here if name in ("lib.rs", "main.rs", "mod.rs") else posixpath.join(here, name[:-3])
    for what, rest in _without_inline_modules(_plain(code)):
        if what == "policy":
            yield [_target("mod", "include", [], resolvable=False)]
            continue
        for m in re.finditer(r"((?:#\[[^\]]*\]\s*)*)(?:pub(?:\([^)]*\))?\s+)?\b(?:mod\s+(\w+)\s*;|use\s+([^;]+);)", rest):
            if m[2]:
                by_path = re.search(r"#\[\s*path\b", m[1])
                yield [_target(m[2], "include", [] if by_path else _files([posixpath.join(base, m[2] + ".rs"), posixpath.join(base, m[2], "mod.rs")]), resolvable=not by_path)]
            else:
                for path in _use_paths(m[3]):
                    if path and path[0] in ("crate", "super", "self"):
                        yield [_target("::".join(path), "import", [(0, "use", "::".join(path), False, "")])]


EXTRACTORS = {"python": python_imports, "javascript": js_imports, "typescript": js_imports, "java": java_imports, "csharp": csharp_imports, "c": c_imports, "cpp": c_imports, "go": go_imports, "php": php_imports, "rust": rust_imports}


def import_targets(files: DataFrame) -> DataFrame:
    """A row for each import target of ``files(path, lang, raw)``; languages without an extractor give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["src", "lang", "pos", "tgt", "spec", "kind", "resolvable", "fallback", "cands"]
        for batch in batches:
            out = []
            for path, lang, raw in zip(batch["path"], batch["lang"], batch["raw"], strict=True):
                if lang in EXTRACTORS:
                    for pos, targets in enumerate(EXTRACTORS[lang](path, raw or "")):
                        out += [{"src": path, "lang": lang, "pos": pos, **t} for t in targets]
            yield pd.DataFrame(out, columns=columns)

    return files.select("path", "lang", "raw").mapInPandas(run, TARGETS)
