import ast
import random
import re

import pytest

from codelode import fixed
from codelode.operators import chunking

SCHEMA = "file_path string, language string, text string"


def chunks_of(df, *columns):
    rows = df.orderBy("file_path", "start_line").select(*columns).collect()
    return [tuple(r) for r in rows]


def test_windows(spark):
    text = "\n".join(f"line {i}" for i in range(1, 101))
    files = spark.createDataFrame([("a", None, text)], SCHEMA)
    assert chunks_of(chunking.chunk_windows(files, 40, 10), "start_line", "end_line") == [(1, 40), (31, 70), (61, 100)]
    with pytest.raises(ValueError):
        chunking.chunk_windows(files, 10, 10)


def test_final_newline_counts_as_a_line(spark):
    files = spark.createDataFrame([("a", None, "x\ny\n"), ("b", None, " \n\t\n")], SCHEMA)
    assert chunks_of(chunking.chunk_windows(files), "file_path", "start_line", "end_line") == [("a", 1, 3)]


def test_declared_blocks(spark):
    text = "package x\n\ntype Server struct {\n}\n\nfunc StartServer() {\n}\n"
    files = spark.createDataFrame([("s.go", "Go", text)], SCHEMA)
    assert chunks_of(chunking.chunk_files(files), "name", "start_line", "end_line", "chunk_type") == [("StartServer", 6, 7, "block")]


def test_python_definitions(spark):
    text = "import os\n\ndef add(a, b):\n    return a + b\n\nasync def fetch_data():\n    pass\n\nclass Calculator:\n    x = 1\n"
    files = spark.createDataFrame([("a.py", "Python", text), ("bad.py", "Python", "def (:\n"), ("v.py", "Python", "x = 1")], SCHEMA)
    got = chunks_of(chunking.chunk_files(files), "file_path", "name", "start_line", "chunk_type")
    assert got == [
        ("a.py", "add", 3, "function"), ("a.py", "fetch_data", 6, "function"), ("a.py", "Calculator", 9, "class"),
        ("bad.py", None, 1, "block"), ("v.py", None, 1, "block"),
    ]


def by_loop(pattern: str, group: int, text: str):
    """The sections of a text, found one after another."""
    found = list(re.finditer(pattern, text, re.M))
    ends = [m.start() for m in found[1:]] + [len(text)]
    out = []
    for m, end in zip(found, ends):
        body = text[m.start() : end].rstrip()
        first = 1 + text[: m.start()].count("\n")
        out.append((first, first + body.count("\n"), m.group(group).strip(), body))
    return out


PIECES = ["# A", "## B b  ", "###", "#", "##### deep", "text", "", "  ", "\t", "#no", "```", "\r", "# x\r", " # y", " ", "# z",
          "export async function f(", "class X {", "  class Y {", "var q = 1", "let z:", "const a", "public static void m<T>", "﷐﷒ # t", "def n\x0b"]


@pytest.mark.parametrize("language, pattern, group", [("Markdown", fixed.HEADING_PATTERN, 2), ("Java", fixed.DECLARATION_PATTERN, 1)])
def test_sections_equal_a_sequential_scan(spark, language, pattern, group):
    draw = random.Random(7)
    texts = ["\n".join(draw.choice(PIECES) for _ in range(draw.randint(1, 12))) for _ in range(400)]
    rows = [(f"{i:04d}", language, t) for i, t in enumerate(texts)]
    found = chunking.chunk_files(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {}
    for r in found:
        got.setdefault(r.file_path, []).append((r.start_line, r.end_line, r.name, r.chunk_text))
    checked = 0
    for path, _l, text in rows:
        want = by_loop(pattern, group, text)
        if want:
            checked += 1
            assert sorted(got[path]) == want, text
        elif text.strip():
            assert [g[2] for g in got[path]] == [None]
        else:
            assert path not in got
    assert checked > 100


def test_definitions_equal_a_plain_walk(spark):
    source = open(chunking.__file__).read()
    files = spark.createDataFrame([("c.py", "Python", source)], SCHEMA)
    lines = source.split("\n")
    want = [
        (n.name, "\n".join(lines[n.lineno - 1 : n.end_lineno]))
        for n in ast.parse(source).body
        if isinstance(n, (ast.FunctionDef, ast.ClassDef))
    ]
    assert chunks_of(chunking.chunk_python_defs(files), "name", "chunk_text") == want


def test_corpus_filter_can_be_left_out(spark):
    rows = [("r", "src/a.ts", 6, b"let a;"), ("r", ".env", 3, b"K=1"), ("r", "node_modules/x.js", 3, b"x=1"), ("r", "b.txt", 5, b"ab\xffcd")]
    tree = spark.createDataFrame(rows, "repository_id string, path string, length bigint, content binary")
    kept = {r.file_path: r.chunk_text for r in chunking.chunk_corpus(tree).collect()}
    assert kept == {"src/a.ts": "let a;", "b.txt": "ab�cd"}
    everything = {r.file_path for r in chunking.chunk_corpus(tree, apply_filter=False).collect()}
    assert everything == {"src/a.ts", ".env", "node_modules/x.js", "b.txt"}
    rejected = {r.path: r.reason for r in chunking.rejected_corpus(tree).collect()}
    assert rejected == {".env": "secret_or_credential_file", "node_modules/x.js": "ignored_directory"}


def test_corpus_keeps_files_of_any_size(spark):
    text = b"a line of prose\n" * 140_000
    tree = spark.createDataFrame([("r", "big.txt", len(text), text)], "repository_id string, path string, length bigint, content binary")
    assert chunking.chunk_corpus(tree).agg({"end_line": "max"}).first()[0] >= 140_000
    assert chunking.chunk_corpus(tree, max_bytes=1 << 20).count() == 0
    assert chunking.rejected_corpus(tree, 1 << 20).first().reason == f"file_size_exceeded_{len(text)}_bytes"


def test_text_is_split_in_one_pass(spark):
    files = spark.createDataFrame([("a.md", "Markdown", "# x")], SCHEMA)
    plan = chunking.chunk_files(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan
