"""The driver tables seen as repositories, files, chunks, queries and runs.

Each table is one SQL text that both Spark and DuckDB run; words in angle
brackets stand for the few functions whose names differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

DIALECTS = {
    "spark": {
        "<bytes>": "octet_length(text)",
        "<six_words>": "array_join(slice(split(b.text, ' '), 1, 6), ' ')",
        "<copies>": "explode(array(CAST(100 AS DOUBLE), CAST(200 AS DOUBLE)))",
        "<array>": "array(",
        "</array>": ")",
    },
    "duckdb": {
        "<bytes>": "strlen(text)",
        "<six_words>": "array_to_string(list_slice(string_split(b.text, ' '), 1, 6), ' ')",
        "<copies>": "unnest([CAST(100 AS DOUBLE), CAST(200 AS DOUBLE)])",
        "<array>": "[",
        "</array>": "]",
    },
}

# Sixteen kinds of paths, so that every filter and language rule meets data.
FILES = """
  SELECT doc_id, source AS repository_id,
    CASE CAST(floor(doc_id / 20) AS BIGINT) % 16
      WHEN 0 THEN concat(lang, '/doc_', doc_id, '.py')
      WHEN 1 THEN concat(lang, '/doc_', doc_id, '.md')
      WHEN 2 THEN concat('src/doc_', doc_id, '.ts')
      WHEN 3 THEN concat('notes/doc_', doc_id, '.txt')
      WHEN 4 THEN concat('config/doc_', doc_id, '.yml')
      WHEN 5 THEN concat('doc_', doc_id)
      WHEN 6 THEN concat(lang, '/Dockerfile.', doc_id)
      WHEN 7 THEN concat('node_modules/', lang, '/doc_', doc_id, '.js')
      WHEN 8 THEN concat('deploy/.env.', doc_id)
      WHEN 9 THEN concat('assets/doc_', doc_id, '.PNG')
      WHEN 10 THEN concat('README_', doc_id, '.md')
      WHEN 11 THEN concat('docs/architecture_', doc_id, '.md')
      WHEN 12 THEN concat('pkg_', doc_id, '/main.py')
      WHEN 13 THEN concat(lang, '/indexCard', doc_id, '.go')
      WHEN 14 THEN concat('d_', doc_id, '/.gitignore')
      ELSE concat(lang, '/thTable_', doc_id, '.rs')
    END AS path,
    CAST(<bytes> AS BIGINT) AS length, lang, text
  FROM documents
"""

RUNS = """
  SELECT event_id AS id, concat('src', user_id % 20) AS repository_id,
    CASE event_type WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'completed'
      WHEN 'error' THEN 'failed' ELSE 'ingesting' END AS status,
    CASE WHEN event_type = 'error' AND event_id % 3 = 0
      THEN 'Ingestion was interrupted by a service restart. Please retry.' END AS error_message,
    ts AS created_at
  FROM events
"""

LATEST = """
  SELECT repository_id, max(id) AS ingestion_id FROM (
    SELECT id, repository_id, created_at,
      max(created_at) OVER (PARTITION BY repository_id) AS newest
    FROM runs WHERE status = 'completed') AS r
  WHERE created_at = newest GROUP BY repository_id
"""

# One chunk per document; every tenth belongs to an older run, every 29th holds
# only comment lines, and documents without a vector keep NULL.
CHUNKS = """
  SELECT f.doc_id AS chunk_id, f.repository_id,
    CASE WHEN CAST(floor(f.doc_id / 20) AS BIGINT) % 10 = 9 THEN -1 ELSE l.ingestion_id END AS ingestion_id,
    f.path AS file_path,
    CASE WHEN f.doc_id % 4 <> 0 THEN f.lang END AS language,
    CASE WHEN f.doc_id % 3 = 0 THEN 'function' END AS chunk_type,
    CASE WHEN f.doc_id % 3 = 0 THEN nullif(regexp_extract(f.text, '[A-Z][a-z]', 0), '') END AS name,
    CASE WHEN f.doc_id % 2 = 0 THEN 1 ELSE 11 END AS start_line,
    CASE WHEN f.doc_id % 2 = 0 THEN 1 ELSE 11 END
      + CAST(length(f.text) - length(replace(f.text, chr(10), '')) AS INT) AS end_line,
    CASE WHEN f.doc_id % 29 = 0 THEN concat('# ', replace(f.text, chr(10), concat(chr(10), '# ')))
      ELSE f.text END AS chunk_text,
    e.embedding
  FROM files AS f JOIN latest AS l ON f.repository_id = l.repository_id
    LEFT JOIN embeddings AS e ON e.vec_id = f.doc_id
"""

REQUESTS = """
  SELECT b.item_id AS query_id, concat('src', b.item_id % 20) AS repository_id,
    CASE b.item_id % 5
      WHEN 0 THEN concat('Explain the architecture: ', <six_words>)
      WHEN 1 THEN CASE WHEN b.item_id % 2 = 0 THEN 'TH' ELSE lower(regexp_extract(b.text, '[A-Z][a-z]', 0)) END
      WHEN 2 THEN concat(<six_words>, ' thTable Dockerfile')
      WHEN 3 THEN concat('Where is ', <six_words>, ' gitignore used?')
      ELSE <six_words> END AS query,
    CASE b.item_id % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'semantic' ELSE 'keyword' END AS mode,
    CAST(3 + b.item_id % 8 AS INT) AS top_k,
    CASE WHEN b.item_id % 7 = 3 THEN <array>'.md', 'py', '.go'</array> END AS file_extensions,
    CASE WHEN b.item_id % 7 = 5 THEN <array>'docs/', 'pkg_', 'de/', 'en/'</array> END AS file_paths,
    CASE WHEN b.item_id % 4 = 2 THEN CAST(0.1 AS DOUBLE) END AS min_score,
    e.embedding AS query_vector
  FROM benchmark AS b LEFT JOIN embeddings AS e ON e.vec_id = b.item_id
"""


# Pages as Markdown: titles and paragraph starts become headings, some of them
# inside code fences or too deep to count.
MARKDOWN = """
  SELECT page_id, concat('site/page_', page_id, '.md') AS file_path,
    replace(replace(replace(replace(replace(replace(replace(replace(html,
      '<article><h1>', concat(chr(10), '## ')), '</h1>', concat('!  ', chr(10))),
      '<b>', concat(chr(10), '#b')), '<li>', concat(chr(10), '- ')),
      '<nav>', concat(chr(10), '##### nav')), '<p>', concat(chr(10), chr(10))),
      '. ', concat('.', chr(10), '# ')), concat('# ', chr(10)), concat('# x', chr(10))) AS text
  FROM pages
"""

# Documents as code: each line gets a declaration keyword by its first letter.
CODE = """
  SELECT doc_id, concat('src/unit_', doc_id, '.ts') AS file_path,
    replace(replace(replace(replace(replace(concat(chr(10), text),
      concat(chr(10), 'A'), concat(chr(10), 'class A')),
      concat(chr(10), 'T'), concat(chr(10), 'export  async function T')),
      concat(chr(10), 'D'), concat(chr(10), ' const D')),
      concat(chr(10), 'E'), concat(chr(10), 'let E')),
      concat(chr(10), 'I'), concat(chr(10), 'public static void I')) AS text
  FROM documents
"""

# Documents as Python: each line becomes a function, a class or a statement.
PYTHON = """
  SELECT doc_id, concat('lib/unit_', doc_id, '.py') AS file_path,
    concat('import os', chr(10), CASE WHEN doc_id % 10 = 3 THEN 'def (' ELSE '' END, chr(10), '@wrap', chr(10),
      CASE doc_id % 3 WHEN 0 THEN 'def ' WHEN 1 THEN 'async def ' ELSE 'class ' END,
      'unit_', doc_id, CASE WHEN doc_id % 3 = 2 THEN ':' ELSE '(a):' END, chr(10), '    s = ', chr(34), replace(replace(replace(text, chr(92), ' '), chr(34), ' '), chr(10), ' '), chr(34), chr(10),
      CASE WHEN doc_id % 3 = 2 THEN '    x = 1' ELSE '    return a' END, chr(10), chr(10), 'y = 2', chr(10)) AS text
  FROM documents
"""

# Twenty scored chunks per query, each also once with half its score.
RESULTS = """
  SELECT CAST(floor(doc_id / 20) AS BIGINT) AS query_id, doc_id AS chunk_id, path AS file_path,
    CAST(1 + doc_id % 30 AS INT) AS start_line, CAST(1 + doc_id % 30 + doc_id % 7 AS INT) AS end_line,
    CASE WHEN doc_id % 4 <> 0 THEN lang END AS language,
    CASE WHEN doc_id % 3 = 0 THEN concat('f', doc_id) END AS name,
    CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE text END AS chunk_text,
    CAST((doc_id * 37) % 100 AS DOUBLE) / d AS score
  FROM (SELECT *, <copies> AS d FROM files) AS copied
"""

QUESTIONS = """
  SELECT CAST(floor(doc_id / 20) AS BIGINT) AS query_id, min(doc_id) % 97 AS conversation_id,
    concat('Q ', CASE WHEN min(doc_id) % 140 = 0 THEN max(text) ELSE max(left(text, 80)) END) AS question,
    min(doc_id) % 60 <> 0 AS requires_evidence
  FROM documents GROUP BY CAST(floor(doc_id / 20) AS BIGINT)
"""

MESSAGES = """
  SELECT conv_id * 100 + turn AS id, conv_id AS conversation_id, role, text AS content,
    turn - turn % 2 AS created_at
  FROM conversations
"""

# Review texts of every shape: fenced, plain, prose, wrong top level, blank summary.
REVIEWS = """
  SELECT doc_id, CASE doc_id % 6
    WHEN 0 THEN concat('```json', chr(10), body, chr(10), '```')
    WHEN 2 THEN concat('  Looks fine ', doc_id, ' ')
    WHEN 3 THEN concat('[', body, ']')
    WHEN 4 THEN replace(body, 'Sum', ' ')
    WHEN 5 THEN concat('```', chr(10), body, '  ```')
    ELSE body END AS text
  FROM (SELECT doc_id, concat('{"summary": "Sum", "findings": [{"title": "T', doc_id,
    '", "severity": "high", "category": 3, "file_path": "', lang, '/f.py", "start_line": ', doc_id % 50,
    ', "end_line": "7", "evidence_sources": [1, 3, 99, true, "2"]}, {"title": " "}, 5, ',
    '{"severity": "low"}, {"title": "U", "explanation": " ", "recommendation": "fix ', source,
    '", "start_line": true, "end_line": ', doc_id, ', "file_path": null, "evidence_sources": 2}]}') AS body
  FROM documents) AS b
"""

_ALL = {
    "files": FILES, "runs": RUNS, "latest": LATEST, "chunks": CHUNKS, "requests": REQUESTS,
    "markdown": MARKDOWN, "code": CODE, "python_files": PYTHON,
    "results": RESULTS, "questions": QUESTIONS, "messages": MESSAGES, "reviews": REVIEWS,
}
_NEEDS = {
    "files": ("documents",),
    "runs": ("events",),
    "latest": ("runs",),
    "chunks": ("files", "latest", "embeddings"),
    "requests": ("benchmark", "embeddings"),
    "markdown": ("pages",),
    "code": ("documents",),
    "python_files": ("documents",),
    "results": ("files",),
    "questions": ("documents",),
    "messages": ("conversations",),
    "reviews": ("documents",),
}


def _text(name: str, dialect: str) -> str:
    body = _ALL[name]
    for mark, words in DIALECTS[dialect].items():
        body = body.replace(mark, words)
    return body


def with_tables(*names: str) -> str:
    """DuckDB ``WITH`` prefix that defines ``names`` and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in _ALL and name not in order:
            for needed in _NEEDS[name]:
                add(needed)
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({_text(n, 'duckdb')})" for n in order)


def spread(df: DataFrame) -> DataFrame:
    """Use every core on an input of fewer splits than cores, such as one small file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a DataFrame; raw driver tables are read as they are."""
    if name not in _ALL:
        return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    inputs = {n: table(spark, sf_dir, n) for n in _NEEDS[name]}
    body = _text(name, "spark").replace("{", "{{").replace("}", "}}")
    for needed in inputs:
        for word in ("FROM", "JOIN"):
            body = body.replace(f"{word} {needed}", f"{word} {{{needed}}}")
    return spark.sql(body, **inputs)


def binary_tree(files: DataFrame) -> DataFrame:
    """Files as a binary source would give them."""
    return files.select(
        "repository_id", "path", "length", F.col("text").cast("binary").alias("content")
    )
