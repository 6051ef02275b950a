"""Symbols, imports and calls of source files: one Arrow pass over (path, content), with a registry of parsers by language.

Python is parsed with the standard library's ast, JavaScript and TypeScript
with a small tokenizer-free scan of declarations. A file that can't be parsed
has no rows. Fingerprints are SHA-256 digests of the syntax nodes' types in
preorder; they agree between files, not with other parsers'.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SYMBOLS = "path string, name string, qualified_name string, kind string, start_line long, end_line long, signature string, docstring string, fingerprint string"
REFERENCES = "path string, what string, target string, receiver string, line long, level long"
COLUMNS = [c.split()[0] for c in SYMBOLS.split(", ")]
REFERENCE_COLUMNS = [c.split()[0] for c in REFERENCES.split(", ")]


def _preorder(node: ast.AST) -> Iterator[str]:
    yield type(node).__name__
    for child in ast.iter_child_nodes(node):
        yield from _preorder(child)


def python_symbols(content: str) -> list[tuple]:
    """Classes, functions and methods; functions inside functions are left out; a nested class is qualified by its parent alone."""
    lines, out = content.split("\n"), []

    def signature(start: int) -> str:
        text = lines[start - 1].strip()
        for extra in lines[start : start + 9] if text.endswith(("(", ",")) else ():
            text += " " + extra.strip()
            if text.endswith(":"):
                break
        return text

    def visit(body: list[ast.stmt], parent: str | None) -> None:
        for node in body:
            if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                is_class = isinstance(node, ast.ClassDef)
                kind = "class" if is_class else "method" if parent else "function"
                digest = hashlib.sha256("\n".join(_preorder(node)).encode()).hexdigest()
                out.append((node.name, f"{parent}.{node.name}" if parent else node.name, kind, node.lineno, node.end_lineno, signature(node.lineno), ast.get_docstring(node), digest))
                if is_class:
                    visit(node.body, node.name)

    visit(ast.parse(content).body, None)
    return out


def python_references(content: str) -> list[tuple]:
    """Imports ('import', module or name, module, line, level) and calls ('call' or, in capitals, 'construct')."""
    out = []
    for node in ast.walk(ast.parse(content)):
        if isinstance(node, ast.Import):
            out += [("import", a.name, a.asname or a.name.rpartition(".")[2], node.lineno, 0) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [("from", a.name, node.module, node.lineno, node.level) for a in node.names]
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                out.append(("construct" if f.id[:1].isupper() else "call", f.id, None, node.lineno, 0))
            elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                out.append(("call", f.attr, f.value.id, node.lineno, 0))
    return out


_JS = re.compile(r"^(?P<pad>\s*)(?:export\s+)?(?:default\s+)?(?:(?:async\s+)?function\s*\*?\s*(?P<function>[\w$]+)|class\s+(?P<klass>[\w$]+)|(?:const|let|var)\s+(?P<arrow>[\w$]+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>|(?:async\s+|static\s+|get\s+|set\s+)*(?P<method>[\w$]+)\s*\([^)]*\)\s*\{)")
_JS_WORDS = {"if", "for", "while", "switch", "catch", "function", "return", "with"}


def javascript_symbols(content: str) -> list[tuple]:
    """Classes, functions, methods inside classes and arrow functions, with the line at which their braces close."""
    lines, out, open_classes = content.split("\n"), [], []
    for i, line in enumerate(lines, 1):
        m = _JS.match(line)
        while open_classes and open_classes[-1][1] < i:
            open_classes.pop()
        if not m:
            continue
        kind, name = next((k, v) for k, v in (("function", m["function"]), ("class", m["klass"]), ("function", m["arrow"]), ("method", m["method"])) if v)
        if kind == "method" and (not open_classes or name in _JS_WORDS):
            continue
        depth, end, seen = 0, i, False
        for j in range(i - 1, len(lines)):
            depth += lines[j].count("{") - lines[j].count("}")
            seen |= "{" in lines[j]
            if (seen and depth <= 0) or (not seen and lines[j].rstrip().endswith(";")):
                end = j + 1
                break
        body = "\n".join(re.sub(r"[\w$]+", "w", x) for x in lines[i - 1 : end])
        qualified = f"{open_classes[-1][0]}.{name}" if kind == "method" else name
        out.append((name, qualified, kind, i, end, line.strip(), None, hashlib.sha256(body.encode()).hexdigest()))
        if kind == "class":
            open_classes.append((name, end))
    return out


def javascript_references(content: str) -> list[tuple]:
    out = []
    for i, line in enumerate(content.split("\n"), 1):
        out += [("import", m[1], None, i, 0) for m in re.finditer(r"""(?:import\s[^'"]*?from\s*|import\s*|require\(\s*)['"]([^'"]+)['"]""", line)]
        out += [("construct", m[1], None, i, 0) for m in re.finditer(r"\bnew\s+([\w$]+)\s*\(", line)]
        out += [("call", m[2], m[1], i, 0) for m in re.finditer(r"(?<![\w$.])(?:([\w$]+)\.)?([\w$]+)\s*\(", line) if m[2] not in _JS_WORDS and not re.search(r"\b(?:new|function)\s+$", line[: m.start()])]
    return out


Extractor = Callable[[str], list[tuple]]
SYMBOL_PARSERS: dict[str, Extractor] = {".py": python_symbols, ".js": javascript_symbols, ".ts": javascript_symbols, ".jsx": javascript_symbols, ".tsx": javascript_symbols}
REFERENCE_PARSERS: dict[str, Extractor] = {".py": python_references, ".js": javascript_references, ".ts": javascript_references, ".jsx": javascript_references, ".tsx": javascript_references}


def register_extractor(suffix: str, symbols: Extractor, references: Extractor | None = None) -> None:
    """Adds a language by its files' suffix."""
    SYMBOL_PARSERS[suffix] = symbols
    if references:
        REFERENCE_PARSERS[suffix] = references


def _pass(parsers: dict[str, Extractor], columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                parser = parsers.get("." + path.rpartition(".")[2])
                if parser and content is not None:
                    try:
                        rows += [(path, *r) for r in parser(content if isinstance(content, str) else bytes(content).decode("utf-8", "replace"))]
                    except (SyntaxError, ValueError, RecursionError):
                        continue
            yield pd.DataFrame(rows, columns=columns)

    return run


def parse_symbols(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInPandas(_pass(dict(SYMBOL_PARSERS), COLUMNS), SYMBOLS)


def parse_references(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInPandas(_pass(dict(REFERENCE_PARSERS), REFERENCE_COLUMNS), REFERENCES)
