from __future__ import annotations

import pytest

from lodestrata.operators import review as V


@pytest.mark.parametrize(
    "code,language,want",
    [
        ("", "", []),
        ("for a in b:\n\n  # for x in y:\n  while c:\n    for d in e:\n      f()\ng()", "python", [(5, "nested_loops")]),
        ("for a in b:\n    pass\nfor c in d:\n    pass", "python", []),
        ("xs=[]\nif 1 in xs: pass", "python", []),
        ("for a in b:\n  xs = [1]\n  if a not in xs: pass", "", [(3, "list_search_in_loop")]),
        ("s = \"\"\nt = 'a'\nfor a in b:\n  t += a\n  s += a", "python", [(5, "string_grown_in_loop")]),
        ("s = ''\nfor (;;) {\n s += 1 }", "go", []),
        ("for (i = 0; f(i); i++) { }\nfor (a : b) {\n if (x) {\n while (y(1)) {\n}}}", "java", [(4, "nested_loops")]),
        ("def f(n):\n  memo = {}\n  return f(n - 1)", "python", []),
        ("while True:\n  break", "python", []),
        ("for x in range(len(y)): x.sort()", "", [(0, "range_of_length"), (1, "sort_in_loop")]),
        ("} } {", "cpp", []),
    ],
)
def test_findings(code, language, want):
    assert V.findings(code, language) == want


@pytest.mark.parametrize("args,want", [((0, True, False), "1 to n"), ((1, True, True), "log n * n log n"), ((1, False, False), "n"), ((2, False, True), "n^2"), ((5, True, False), "n^5 * n log n"), ((0, False, True), "log n")])
def test_complexity(args, want):
    assert V.complexity(*args) == want


def test_long_code_takes_linear_time():
    names = "\n".join(f"v{i} = []" for i in range(3000))
    assert V.findings(names + "\nfor a in b:\n" + "  x in y\n" * 20_000, "python") == []


def test_columns(spark):
    docs = spark.createDataFrame([(1, None, "x", " Java "), (2, "while True: pass", "y", "")], "id long, code string, depth string, given string")
    got = sorted(tuple(r) for r in V.reviews(docs, language="given").collect())
    assert [(r[0], r[2], r[3], r[4]) for r in got] == [(1, "java", 0, "1 to n"), (2, "", 1, "n")] and [tuple(f) for f in got[1][5]] == [(0, "endless_loop")]


def test_names_of_a_text_make_no_patterns(monkeypatch):
    made = []
    monkeypatch.setattr(V.re, "compile", lambda *a: made.append(a) or pytest.fail("compiled for one text"))
    monkeypatch.setattr(V.re, "findall", lambda *a: made.append(a) or pytest.fail("compiled for one text"))
    code = "def f(n):\n  xs = [1]\n  s = ''\n  for a in xs:\n    if in in xs: s += a\n  return f(n)"
    assert V.findings(code, "python") == [(0, "plain_recursion"), (4, "list_search_in_loop"), (5, "string_grown_in_loop")] and not made
