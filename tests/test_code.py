"""Chunks of source files, this library's own among them."""

import ast
from pathlib import Path

from pyspark.sql import functions as F

from tallgrass.operators import code as C

ROOT = Path(__file__).resolve().parents[1]

SOURCE = '''"""Doc."""
class A:
    """Of A."""
    class B:
        def f(self, a, /, b, *c, d=1, **e):
            if b:
                def g(): pass
            return 1
    async def h(self): ...
def top(x):
    """Of top."""
    class Inner:
        def m(self): pass
'''


def test_names_and_lines():
    got = {(i, k, a, b, n) for i, k, _, a, b, n, _ in C.python_chunks_of("p/x.py", SOURCE)}
    want = [("module", 1, 13, "x"), ("class", 2, 9, "A"), ("class", 4, 8, "B"), ("method", 5, 8, "B.f"), ("method", 7, 7, "B.g"), ("method", 9, 9, "A.h"), ("function", 10, 13, "top"), ("class", 12, 13, "Inner"), ("method", 13, 13, "Inner.m")]
    assert got == {(f"p/x.py:{k}:1" if k == "module" else f"p/x.py:{k}:{n}:{a}", k, a, b, n) for k, a, b, n in want}
    texts = {n: t for *_, n, t in C.python_chunks_of("p/x.py", SOURCE)}
    assert texts["B.f"].split("\n")[:3] == ["p/x.py", "B.f", "def f(self, a, b, *c, d, **e)"] and texts["A.h"].split("\n")[2] == "async def h(self)"
    assert texts["top"].startswith("p/x.py\ntop\ndef top(x)\nOf top.\ndef top(x):") and texts["A"].startswith("p/x.py\nclass A\nOf A.\nclass A:")


def test_odd_files():
    assert [c[1] for c in C.python_chunks_of("e.py", "")] == ["module"] and [c[1] for c in C.python_chunks_of("e.py", None)] == ["module"]
    assert not list(C.python_chunks_of("e.py", "def (")) and not list(C.python_chunks_of("e.py", "x = '\0'")) and not list(C.python_chunks_of("e.py", "(" * 5000 + ")" * 5000))
    long = "def f():\n" + "    x = 1\n" * 500
    (_, f) = C.python_chunks_of("e.py", long)
    assert f[3:5] == (1, 501) and len(f[6].split("\n")) == 3 + C.BODY


def test_this_library_as_a_table(spark):
    files = [(str(p.relative_to(ROOT)), p.read_text()) for p in sorted((ROOT / "tallgrass").rglob("*.py"))] + [("README.md", (ROOT / "README.md").read_text()), ("x.txt", "none"), (None, "x = 1"), ("bad.py", "def (")]
    got = C.file_chunks(spark.createDataFrame(files, "path string, text string")).collect()
    count = lambda t: 1 + sum(isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) for n in ast.walk(ast.parse(t)))
    for path, text in files[:-4]:
        own = [r for r in got if r.path == path]
        assert len(own) == count(text) and all(text.split("\n")[r.start_line - 1].lstrip().startswith(("def ", "class ", "async def ", "@")) for r in own if r.kind != "module")
    heads = [r for r in got if r.path == "README.md"]
    assert heads and all(r.kind == "heading" for r in heads) and {r.path for r in got} == {p for p, _ in files[:-3]}


def test_identifiers(spark):
    rows = [("Get the snake_case_of x, __init__ 9lives getHTTPCode",), (None,), ("",)]
    got = [r.t for r in spark.createDataFrame(rows, "t string").select(C.identifiers(F.col("t")).alias("t")).collect()]
    assert got == [["snake_case_of", "snake", "case", "__init__", "init", "lives", "gethttpcode"], [], []]
