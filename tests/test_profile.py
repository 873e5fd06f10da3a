from codelode.operators import profile

TREE = "repository_id string, path string, length bigint, content binary"


def tree(spark, files, repo="r"):
    return spark.createDataFrame([(repo, p, len(b), b) for p, b in files], TREE)


def test_profile_of_a_small_repository(spark):
    files = [("README.md", b"# Hi\n"), ("main.py", b"x = 1\ny = 2\n"), ("src/app.py", b"a"), ("src/utils.ts", b"let a;\n"),
             ("node_modules/dummy.js", b"x"), (".env", b"SECRET=1")]
    found = profile.profile_repository(profile.scan_files(tree(spark, files)))
    run = found.runs.first()
    assert (run.status, run.file_count, run.total_lines, run.primary_language) == ("completed", 4, 5, "Python")
    assert {k: v.files for k, v in run.language_stats.items()} == {"Python": 2, "TypeScript": 1, "Markdown": 1}
    assert {r.directory: r.files for r in found.directories.collect()} == {"<root>": 2, "src": 2}
    placed = profile.file_catalog(found.files).orderBy("place").collect()
    assert [(f.place, f.path) for f in placed] == list(enumerate(["README.md", "main.py", "src/app.py", "src/utils.ts"]))


def test_limits_are_a_verdict_and_cut_nothing(spark):
    many = profile.scan_files(tree(spark, [(f"f{i}.py", b"x" * 100) for i in range(10)]))
    found = profile.profile_repository(many, max_files=5)
    run = found.runs.first()
    assert run.status == "failed" and "5 files" in run.error_message
    assert (run.file_count, found.files.count(), found.directories.count()) == (10, 10, 1)
    run = profile.profile_repository(many, max_bytes=500).runs.first()
    assert run.status == "failed" and "500 bytes" in run.error_message


def test_no_limit_without_a_caller(spark):
    found = profile.profile_repository(profile.scan_files(tree(spark, [(f"d/f{i}.py", b"x") for i in range(2_001)])))
    run = found.runs.first()
    assert (run.status, run.file_count, run.error_message) == ("completed", 2_001, None)
    assert profile.file_catalog(found.files).agg({"place": "max"}).first()[0] == 2_000


def test_equal_bytes_go_to_the_first_name(spark):
    rows = profile.language_rows(profile.scan_files(tree(spark, [("a.ts", b"x"), ("b.go", b"y")])))
    assert profile.primary_language(rows).first().primary_language == "Go"
