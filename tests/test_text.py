import pytest
from pyspark.sql import functions as F

from codelode.functions import scores, text as tx, urls, vectors as vx
from codelode.operators.filters import validate_requests


def evaluate(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, values, expr):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    width = len(rows[0]) - 1
    schema = "i int, " + ", ".join(f"c{k} string" for k in range(width))
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.orderBy("i").select(expr(*[F.col(f"c{k}") for k in range(width)])).collect()]


def test_line_count(spark):
    texts = ["line 1\nline 2\nline 3\n", "", "hello", "a\r\nb\rc", "\n\n"]
    assert one(spark, texts, tx.line_count) == [3, 0, 1, 3, 2]


def test_secret_files(spark):
    secret = [".env.local", "config/.env.production", "id_rsa.pub", "auth/service-account.json", "ssl/cert.pem", ".env.d/x", "A/ID_RSA"]
    plain = [".gitignore", ".eslintrc.json", "src/environment.ts", "app/key_handler.py", "config/.env.d/x"]
    assert all(one(spark, secret, tx.is_secret_file))
    assert not any(one(spark, plain, tx.is_secret_file))


def test_ignored_directories_leave_file_names_alone(spark):
    paths = ["node_modules/a.js", "src/Build/x.py", "build", "src/dist.py", ".git/config"]
    assert one(spark, paths, tx.in_ignored_dir) == [True, True, False, False, True]


def test_languages(spark):
    paths = ["a.py", "src/B.TSX", "Dockerfile", "docker/Dockerfile.dev", "CMakeLists.txt", "x.unknown", ".py", "a.b.h++", "Makefile.old"]
    assert one(spark, paths, tx.detect_language) == [
        "Python", "TypeScript", "Dockerfile", "Dockerfile", "CMake", None, None, "C++", None,
    ]


def test_binary_content(spark):
    rows = [(0, b""), (1, b"a\x00b"), (2, "é".encode()), (3, b"\xff" + b"\x01" * 9), (4, b"\xff" + b"a" * 9)]
    df = spark.createDataFrame(rows, "i int, content binary").orderBy("i")
    assert [r[0] for r in df.select(tx.is_binary_content(F.col("content"))).collect()] == [False, True, False, True, False]


def test_content_hash_ignores_outer_space(spark):
    a, b, c = one(spark, ["  x = 1\n", "x = 1", "x = 1 　"], tx.content_hash)
    assert a == b == c and len(a) == 64


@pytest.mark.parametrize(
    "path, query, hit",
    [
        ("src/indexing/run.py", "index the files", False),
        ("src/query_expander.py", "this and that", False),
        ("main.py", "open setup.py", False),
        ("app/auth/login.py", "how does auth work", True),
        ("src/build_index.py", "where is the index", True),
        ("src/images/load.py", "image loading", True),
        ("lib/TextRetriever.ts", "retriever class", True),
        ("lib/class.py", "classes", False),
    ],
)
def test_path_matches(spark, path, query, hit):
    assert one(spark, [(path, query)], tx.path_matches_query) == [hit]


def test_lexical_terms(spark):
    queries = ["How does image retrieval work?", "How does this work?", "Where is lib/util/paths.py used?",
               "Verify verify VERIFY_token. (it's) what's ++ 'x'", "café... naïve!"]
    assert one(spark, queries, tx.lexical_terms) == [
        ["image", "retrieval"], [], ["lib/util/paths.py"], ["Verify", "VERIFY_token", "x"], ["café", "naïve"],
    ]


def test_folds_differ_on_double_s(spark):
    words = ["images", "class", "bus", "boss"]
    assert one(spark, words, tx.fold) == ["image", "clas", "bus", "bos"]
    assert one(spark, words, tx.singular) == ["image", "class", "bus", "boss"]


def test_broad_questions(spark):
    broad = ["Explain the architecture", "Give me a high-level overview", "What does this repo do?", "How is this project structured?",
             "main components?", "walk me through it", "the big picture"]
    narrow = ["What data structure does the index use?", "Where is verify_token?", "fix the layout", "which project", "architectures"]
    assert all(one(spark, broad, tx.is_broad_question))
    assert not any(one(spark, narrow, tx.is_broad_question))


def test_overview_chunks(spark):
    rows = [
        ("README.md", "Intro", 1, True), ("README.md", "Features", 40, True), ("README.md", "License", 60, False),
        ("docs/README.md", "Features", 1, False), ("docs/architecture.md", "Any", 90, True), ("docs/my-overview.rst", None, 5, True),
        ("docs/redesign.md", None, 1, False), ("main.py", "main", 30, True), ("src/main.py", None, 1, True),
        ("src/main.py", "helper", 9, False), ("a/b/main.py", "main", 1, False), ("src/app.ts", "create_app", 5, True), ("src/util.py", None, 1, False),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, n string, s int, want boolean").orderBy("i")
    got = df.select(tx.is_overview_chunk(F.col("p"), F.col("n"), F.col("s")), "want").collect()
    assert [g for g, _w in got] == [w for _g, w in got]


def test_comment_only_and_non_evidence(spark):
    rows = [
        ("# Keep directory", ".gitkeep", "keep directory", True), ("node_modules/\n*.log", ".gitignore", "dependencies", True),
        ("node_modules/", ".gitignore", "what does the .gitignore exclude", False),
        ("# Retrieval module", "src/retrieval/__init__.py", "retrieval", True), ("# A heading", "README.md", "x", False),
        ("# c\nx = 1", "a.py", "x", False), ("// a\r\n\x0c/* b\n * c", "a.ts", "x", True), ("   \n", "a.py", "x", False),
    ]
    got = one(spark, [r[:3] for r in rows], tx.is_non_evidence)
    assert got == [r[3] for r in rows]


def test_locations_and_labels(spark):
    df = spark.createDataFrame([(1, "p", None, None), (2, "p", 3, None), (3, "p", 3, 3), (4, "p", 3, 9)], "i int, p string, a int, b int")
    got = df.orderBy("i").select(tx.location(F.col("p"), F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == ["p", "p:3", "p:3", "p:3-9"]
    assert one(spark, [("general", "a.py"), ("bugs", None)], tx.review_label) == ["[review:general] a.py", "[review:bugs] user-provided code"]


def test_request_queries(spark):
    assert one(spark, [("src/main.py", None, None), ("src/main.py", "f", "q"), ("a/.env", "", "why")], tx.explain_query) == ["main", "f", "why"]
    rows = [(None, None, "\n  x = 1\ny"), ("a/b.py", None, "z"), (None, None, "  \n "), (None, "s", None)]
    assert one(spark, rows, tx.review_query) == ["x = 1", "b", "code review", "s"]


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://github.com/octocat/Hello-World", "https://github.com/octocat/Hello-World"),
        (" https://github.com/octocat/Hello-World.git/ ", "https://github.com/octocat/Hello-World"),
        ("HTTPS://GITHUB.com:443/a/b?x=1#y", "https://github.com/a/b"),
        ("http://github.com/a/b", "scheme"), ("git://github.com/a/b", "scheme"), ("ftp://github.com/a/b", "scheme"),
        ("https://gitlab.com/a/b", "host"), ("https://me@github.com/a/b", "host"), ("https://github.com.evil.com/a/b", "host"),
        ("https://github.com/a", "too_few_segments"), ("https://github.com/a/b/tree/main", "too_many_segments"),
        ("https://github.com/a/.git", "empty_name"), ("   ", "empty"), (None, "empty"), ("https://[x/a/b", "malformed"),
    ],
)
def test_repo_urls(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string").select(urls.normalize_repo_url(F.col("u")).alias("r"))
    row = df.first().r
    assert (row.url or row.reason) == want
    assert (row.url is None) != (row.reason is None)


def test_scores(spark):
    df = spark.createDataFrame([(3, 4), (0, 0)], "m bigint, t bigint")
    assert [r[0] for r in df.select(scores.coverage(F.col("m"), F.col("t"))).collect()] == [0.75, 0.0]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vx.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    assert df.select(vx.l2_normalize(F.lit([3.0, 4.0]).cast("array<double>"))).first()[0] == [0.6, 0.8]


def test_validation(spark):
    df = spark.createDataFrame([(1, "", 5), (2, "x" * 1001, 5), (3, "ok", 0), (4, "ok", 100), (5, "ok", 50)], "i int, query string, top_k int")
    got = {r.i: (r.valid, r.errors) for r in validate_requests(df).collect()}
    assert got[5] == (True, [])
    assert got[1] == (False, ["query_empty"]) and got[2] == (False, ["query_too_long"])
    assert not got[3][0] and not got[4][0]
