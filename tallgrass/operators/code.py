"""Source files as chunks for retrieval: one for the module and for each class and function, with their lines; words of identifiers."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieve import heading_chunks

#: Lines of a body that a chunk holds at most, which is the feature.
BODY = 40
#: Words that say nothing about what is sought.
STOP = (
    "the a an is are was were be been being to of in on for and or as at by with that this it from do does did how what where which who we our into not if when before after actually get gets"
).split()
CHUNK = "id string, kind string, path string, start_line int, end_line int, name string, text string"


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """What a function is called with, without defaults and types."""
    a = node.args
    given = [x.arg for x in [*a.posonlyargs, *a.args]]
    given += [f"*{a.vararg.arg}"] if a.vararg else []
    given += [x.arg for x in a.kwonlyargs]
    given += [f"**{a.kwarg.arg}"] if a.kwarg else []
    word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    return f"{word} {node.name}({', '.join(given)})"


def definitions(tree: ast.Module) -> Iterator[tuple[ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef, str | None]]:
    """Classes and functions, at any depth and in the order of the source, each with the innermost class around it."""
    open_ = [(iter(ast.iter_child_nodes(tree)), None)]
    while open_:
        nodes, owner = open_[-1]
        node = next(nodes, None)
        if node is None:
            open_.pop()
            continue
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            yield node, owner
        open_.append((iter(ast.iter_child_nodes(node)), node.name if isinstance(node, ast.ClassDef) else owner))


def python_chunks_of(path: str, text: str | None) -> Iterator[tuple]:
    """The chunks of one file; a text that isn't Python, or nests too deep for the parser, has none."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    lines, stem = (text or "").splitlines(), PurePosixPath(path).stem
    joined = lambda *parts: "\n".join(p for p in parts if p)
    yield f"{path}:module:1", "module", path, 1, min(len(lines), BODY) or 1, stem, joined(path, f"module {stem}", ast.get_docstring(tree), "\n".join(lines[:BODY]))
    for node, owner in definitions(tree):
        first, last = node.lineno, node.end_lineno or node.lineno
        body, doc = "\n".join(lines[first - 1 : last][:BODY]), ast.get_docstring(node)
        if isinstance(node, ast.ClassDef):
            kind, name, head = "class", node.name, (f"class {node.name}",)
        else:
            kind, name = ("method", f"{owner}.{node.name}") if owner else ("function", node.name)
            head = name, signature(node)
        yield f"{path}:{kind}:{name}:{first}", kind, path, first, last, name, joined(path, *head, doc, body)


class PythonChunks:
    """A table function: the chunks of (path, text)."""

    def eval(self, path: str, text: str):
        if path is not None:
            yield from python_chunks_of(path, text)


def python_chunks(files: DataFrame) -> DataFrame:
    """Chunks (CHUNK) of Python files (path, text); null paths have none."""
    chunks = F.udtf(PythonChunks, returnType=CHUNK)
    rows = files.select(F.col("path").alias("_path"), F.col("text").alias("_text"))
    return rows.lateralJoin(chunks(F.col("_path").outer(), F.col("_text").outer())).drop("_path", "_text")


def file_chunks(files: DataFrame) -> DataFrame:
    """Chunks of .py and .md files (path, text); other files have none."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    marked = files.filter(F.col("path").endswith(".md")).select("path", F.explode(heading_chunks(F.col("text"), stem)).alias("c"))
    c = lambda name: F.col(f"c.{name}")
    docs = marked.select(
        F.concat("path", F.lit(":heading:"), c("name"), F.lit(":"), c("start_line")).alias("id"), F.lit("heading").alias("kind"), "path", c("start_line").cast("int").alias("start_line"),
        c("end_line").cast("int").alias("end_line"), c("name").alias("name"), F.concat_ws("\n", "path", c("name"), c("body")).alias("text"),
    )
    return python_chunks(files.filter(F.col("path").endswith(".py"))).unionByName(docs)


def identifiers(text: Column) -> Column:
    """Words that may be identifiers, in lower case, each followed by its parts between underscores; without stop words and single letters."""
    good = lambda w: (F.length(w) > 1) & ~w.isin(STOP)
    whole = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z_][a-z0-9_]*"), F.lit(0)), good)
    return F.flatten(F.transform(whole, lambda w: F.when(F.contains(w, F.lit("_")), F.concat(F.array(w), F.filter(F.split(w, "_"), good))).otherwise(F.array(w))))
