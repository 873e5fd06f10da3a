"""Chunking (CHK-1 to CHK-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqltext as q
from checks.corpus import binary_tree, table, with_tables
from checks.registry import query
from codelode import fixed
from codelode.operators import chunking

OUT = "start_line, end_line, chunk_type, name, sha256(chunk_text) AS text_hash"


def _shown(df, key):
    return df.select(
        key, "start_line", "end_line", "chunk_type", "name", F.sha2("chunk_text", 256).alias("text_hash")
    )


def windows(src: str, key: str, size: int, overlap: int, where: str = "true") -> str:
    """Line windows of ``src(key, text)`` as rows."""
    step = size - overlap
    return f"""SELECT {key}, CAST(i * {step} + 1 AS INT) AS start_line,
      CAST(least(i * {step} + {size}, n) AS INT) AS end_line, 'block' AS chunk_type, NULL::VARCHAR AS name,
      array_to_string(lines[i * {step} + 1 : i * {step} + {size}], chr(10)) AS chunk_text
    FROM (SELECT {key}, lines, len(lines) AS n, unnest(range(0, CASE WHEN len(lines) <= {size} THEN 1
        ELSE CAST(ceil((len(lines) - {size}) / {step}.0) AS BIGINT) + 1 END)) AS i
      FROM (SELECT {key}, string_split(text, chr(10)) AS lines FROM {src} WHERE {q.has_text('text')} AND {where}))
    WHERE regexp_matches(array_to_string(lines[i * {step} + 1 : i * {step} + {size}], chr(10)), '\\S')"""


def sections(src: str, key: str, pattern: str, group: int, chunk_type: str) -> str:
    """Sections that start at each line that fits ``pattern``, from an ordered line table."""
    return f"""SELECT {key}, CAST(min(no) AS INT) AS start_line,
      CAST(min(no) + length(body) - length(replace(body, chr(10), '')) AS INT) AS end_line,
      '{chunk_type}' AS chunk_type, regexp_replace(regexp_extract(concat(body, chr(10)), '(?m){pattern}', {group}), '^\\s+|\\s+$', '', 'g') AS name,
      body AS chunk_text
    FROM (SELECT {key}, part, min(no) AS no, regexp_replace(string_agg(line, chr(10) ORDER BY no), '\\s+$', '') AS body
      FROM (SELECT {key}, no, line, sum(CASE WHEN regexp_matches(CASE WHEN no < n THEN concat(line, chr(10)) ELSE line END, '{pattern}')
          THEN 1 ELSE 0 END)
          OVER (PARTITION BY {key} ORDER BY no) AS part
        FROM (SELECT {key}, unnest(string_split(text, chr(10))) AS line,
          generate_subscripts(string_split(text, chr(10)), 1) AS no,
          len(string_split(text, chr(10))) AS n FROM {src}))
      WHERE part > 0 GROUP BY {key}, part)
    GROUP BY {key}, part, body"""


@query("chk_1_windows", f"{with_tables('files')}, w AS ({windows('files', 'doc_id', 8, 3)}) SELECT doc_id, {OUT} FROM w")
def chunk_windows(spark, sf_dir):
    files = table(spark, sf_dir, "files").select("doc_id", "text")
    return _shown(chunking.chunk_windows(files, 8, 3), "doc_id")


# RE2 has no look-ahead, so the twin finds headings line by line; the derived
# pages hold no heading line without a text on it.
HEADING = r"^(#{1,4})[ \t]+(\S.*)$"


@query("chk_2_headings", f"""{with_tables('markdown')}, s AS ({sections('markdown', 'page_id', HEADING[:-1], 2, 'doc_section')}),
  w AS ({windows('markdown', 'page_id', 50, 10)})
  SELECT page_id, {OUT} FROM s UNION ALL
  SELECT page_id, {OUT} FROM w WHERE page_id NOT IN (SELECT page_id FROM s)""")
def chunk_headings(spark, sf_dir):
    files = table(spark, sf_dir, "markdown").select("page_id", "file_path", "text")
    return _shown(chunking.chunk_headings(files), "page_id")


@query("chk_3_declarations", f"""{with_tables('code')}, s AS ({sections('code', 'doc_id', fixed.DECLARATION_PATTERN, 1, 'block')}),
  w AS ({windows('code', 'doc_id', 50, 10)})
  SELECT doc_id, {OUT} FROM s UNION ALL
  SELECT doc_id, {OUT} FROM w WHERE doc_id NOT IN (SELECT doc_id FROM s)""")
def chunk_declarations(spark, sf_dir):
    files = table(spark, sf_dir, "code").select("doc_id", "file_path", "text")
    return _shown(chunking.chunk_declarations(files), "doc_id")


# The derived Python files have one definition each, on lines 4 to 6.
DEFINED = """SELECT doc_id, 4 AS start_line, 6 AS end_line,
  CASE doc_id % 3 WHEN 2 THEN 'class' ELSE 'function' END AS chunk_type, concat('unit_', doc_id) AS name,
  array_to_string(string_split(text, chr(10))[4:6], chr(10)) AS chunk_text FROM python_files WHERE doc_id % 10 <> 3"""


@query("chk_4_python_defs", f"""{with_tables('python_files')}, s AS ({DEFINED}),
  w AS ({windows('python_files', 'doc_id', 50, 10, 'doc_id % 10 = 3')})
  SELECT doc_id, {OUT} FROM s UNION ALL SELECT doc_id, {OUT} FROM w""")
def chunk_python(spark, sf_dir):
    files = table(spark, sf_dir, "python_files").select("doc_id", "file_path", "text")
    return _shown(chunking.chunk_python_defs(files), "doc_id")


@query("chk_5_route", f"""{with_tables('markdown', 'code', 'python_files', 'files')},
  m AS ({sections('markdown', 'page_id', HEADING[:-1], 2, 'doc_section')}),
  mw AS ({windows('markdown', 'page_id', 50, 10)}),
  c AS ({sections('code', 'doc_id', fixed.DECLARATION_PATTERN, 1, 'block')}),
  cw AS ({windows('code', 'doc_id', 50, 10)}), p AS ({DEFINED}),
  pw AS ({windows('python_files', 'doc_id', 50, 10, 'doc_id % 10 = 3')}), f AS ({windows('files', 'doc_id', 50, 10)})
  SELECT concat('m', page_id) AS id, {OUT} FROM m UNION ALL
  SELECT concat('m', page_id), {OUT} FROM mw WHERE page_id NOT IN (SELECT page_id FROM m) UNION ALL
  SELECT concat('c', doc_id), {OUT} FROM c UNION ALL
  SELECT concat('c', doc_id), {OUT} FROM cw WHERE doc_id NOT IN (SELECT doc_id FROM c) UNION ALL
  SELECT concat('p', doc_id), {OUT} FROM p UNION ALL SELECT concat('p', doc_id), {OUT} FROM pw UNION ALL
  SELECT concat('f', doc_id), {OUT} FROM f""")
def route(spark, sf_dir):
    def part(name, key, mark, language):
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(mark), key).alias("id"), F.lit(language).alias("language"), "text"
        )

    files = (
        part("markdown", "page_id", "m", "Markdown")
        .unionByName(part("code", "doc_id", "c", "TypeScript"))
        .unionByName(part("python_files", "doc_id", "p", "Python"))
        .unionByName(part("files", "doc_id", "f", None))
    )
    return _shown(chunking.chunk_files(files), "id")


_KEPT = f"NOT {q.ignored_dir('path')} AND ({q.verdict('path', 'length', 1 << 62)}) IS NULL"  # no size limit


@query("chk_6_corpus", f"""{with_tables('files')}, kept AS (SELECT * FROM files WHERE {_KEPT}),
  w AS ({windows('kept', 'path', 50, 10)})
  SELECT path, start_line, end_line, sha256({q.strip('chunk_text')}) AS content_hash FROM w""")
def corpus(spark, sf_dir):
    # The documents are prose, so no rule finds a boundary and all are cut in windows.
    tree = binary_tree(table(spark, sf_dir, "files"))
    chunks = chunking.chunk_corpus(tree)
    return chunks.select(F.col("file_path").alias("path"), "start_line", "end_line", "content_hash")
