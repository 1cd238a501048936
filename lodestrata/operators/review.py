"""Reviews of code: findings by line, and an estimate of its complexity from the nesting of loops."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import parsing as P
from lodestrata.runtime import extended, ship

# What begins a loop, sorts, binds a list or a string, defines a function, and halves.
LOOP_LINE = re.compile(r"^\s*(?:for|while)\b")
LOOP_BRACE = re.compile(r"\b(?:for|while)\s*\(([^()]|\([^()]*\))*\)\s*\{")
SORTS = re.compile(r"\.sort\(|sorted\(")
LIST_BOUND = re.compile(r"\b(\w+)\s*=\s*\[")
STRING_BOUND = re.compile(r"\b(\w+)\s*=\s*(['\"])\2")
DEFINES = re.compile(r"^\s*def\s+(\w+)\s*\(", re.MULTILINE)
MEMBER = re.compile(r"\bin\s+(?=(\w+))")
GROWN = re.compile(r"\b(\w+)\s*\+=")
CALLED = re.compile(r"\b(\w+)\s*\(")
HALVES = re.compile(r"//\s*2|>>\s*1")
BRACED = {"java", "javascript", "cpp", "go"}
_RULES = [(name, kind, re.compile(pattern)) for name, kind, pattern in P.CODE_RULES]


def indent_depths(code: str) -> dict[int, int]:
    """How many loops are open on each line, told by indentation; empty lines and comments have no entry."""
    open_, out = [], {}
    for number, line in enumerate(code.splitlines(), 1):
        bare = line.strip()
        if not bare or bare[0] == "#":
            continue
        indent = len(line) - len(line.lstrip())
        while open_ and open_[-1] >= indent:
            open_.pop()
        if LOOP_LINE.match(line):
            open_.append(indent)
        out[number] = len(open_)
    return out


def brace_depths(code: str) -> dict[int, int]:
    """How many loops are open behind the brace of each loop, on the line of that brace."""
    loops = {m.end() - 1 for m in LOOP_BRACE.finditer(code)}
    open_, depth, line, out = [], 0, 1, {}
    for m in re.finditer(r"[\n{}]", code):
        if m[0] == "\n":
            line += 1
        elif m[0] == "{":
            open_.append(m.start() in loops)
            if open_[-1]:
                depth += 1
                out[line] = depth
        elif open_:
            depth -= open_.pop()
    return out


def loop_depths(code: str, language: str) -> dict[int, int]:
    """By indentation for Python, by braces for languages with braces, and for others what nests deeper."""
    if language == "python":
        return indent_depths(code)
    braces = brace_depths(code)
    if language in BRACED:
        return braces
    lines = indent_depths(code)
    return braces if max(braces.values(), default=0) > max(lines.values(), default=0) else lines


def complexity(depth: int, sorts: bool, halves: bool) -> str:
    """A power of n from the nesting of loops; log n for a search that halves, and a factor for sorting beside a loop."""
    base = "log n" if halves and depth <= 1 else ("1 to n", "n")[max(depth, 0)] if depth < 2 else f"n^{depth}"
    return base + (" * n log n" if sorts and depth >= 1 else "")


def _first_use(code: str, depths: dict[int, int], names: set[str], use: re.Pattern[str]) -> int:
    """The first line within a loop that uses one of some names in a certain way, 0 if there is none.

    The pattern finds any name, as one made for a text's own names would be compiled for each text.
    """
    if not names:
        return 0
    lines = code.splitlines()
    return next((n for n in sorted(depths) if depths[n] and n <= len(lines) and any(m[1] in names for m in use.finditer(lines[n - 1]))), 0)


def findings(code: str, language: str) -> list[tuple[int, str]]:
    """(line, name) of what a review finds, in order; 0 is the line of findings on the whole."""
    depths = loop_depths(code, language)
    deepest = max(depths.values(), default=0)
    lines, out = code.splitlines(), []
    if deepest >= 2:
        out.append((min(n for n, d in depths.items() if d == deepest), "nested_loops"))
    if language in ("python", ""):
        sorting = next((n for n in sorted(depths) if depths[n] and n <= len(lines) and SORTS.search(lines[n - 1])), 0)
        member = _first_use(code, depths, {m[1] for m in LIST_BOUND.finditer(code)}, MEMBER)
        joined = _first_use(code, depths, {m[1] for m in STRING_BOUND.finditer(code)}, GROWN)
        out += [(n, name) for n, name in ((sorting, "sort_in_loop"), (member, "list_search_in_loop"), (joined, "string_grown_in_loop")) if n]
        defined = set(DEFINES.findall(code))
        called = Counter(CALLED.findall(code)) if defined else {}
        if any(called[f] >= 2 for f in defined) and not any(hint in code for hint in P.MEMORY_HINTS):
            out.append((0, "plain_recursion"))
    for name, kind, pattern in _RULES:
        fits = not kind or language == kind or (kind == "python" and not language)
        if fits and pattern.search(code) and not (name == "endless_loop" and "break" in code):
            out.append((0, name))
    return sorted(out)


def reviews(docs: DataFrame, code: str = "code", language: str | None = None) -> DataFrame:
    """The other columns with ``language``, ``depth``, ``complexity`` and ``findings``, an array of (line, name).

    ``language`` names a column; without it, or where it is empty, the language is told by
    hints. Null code is empty code. Rows are independent and mapped in Arrow batches.
    """
    ship(docs.sparkSession)
    text = F.coalesce(code, F.lit(""))
    told = P.code_language(text)
    if language:
        told = F.coalesce(F.when(F.trim(language) != "", F.lower(F.trim(language))), told)
    keep = [c for c in docs.columns if c not in (code, "language", "depth", "complexity", "findings")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("language").to_pylist()
            depth, order, found = [], [], []
            for body, name in zip(batch.column("code_").to_pylist(), names):
                depth.append(max(loop_depths(body, name).values(), default=0))
                order.append(complexity(depth[-1], bool(SORTS.search(body)), bool(HALVES.search(body) and re.search(r"\bwhile\b", body))))
                found.append([{"line": n, "name": x} for n, x in findings(body, name)])
            made = [batch.column("language"), pa.array(depth, pa.int32()), pa.array(order, pa.string()), pa.array(found, pa.list_(pa.struct([("line", pa.int32()), ("name", pa.string())])))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, "language", "depth", "complexity", "findings"])

    rows = docs.select(*keep, text.alias("code_"), told.alias("language"))
    return rows.mapInArrow(run, extended(docs.select(*keep).schema, "language string, depth int, complexity string, findings array<struct<line:int,name:string>>"))
