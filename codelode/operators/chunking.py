"""Splitting files into line-addressed chunks (CHK-1 to CHK-6).

A file is split inside its own row: no shuffle, no window, and the text is
read once whichever rule applies. ``files`` has ``file_path``, ``language``,
``text`` and any key columns; keys are carried through to the chunks.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from codelode import fixed
from codelode.functions import text as tx

# Boundary mark in front of a matched line. U+FDD0 is a noncharacter; one that
# does occur in a file is escaped first, so marks are never confused with text.
_ESCAPE, _ESCAPED, _MARK = "\ufdd0", "\ufdd0\ufdd1", "\ufdd0\ufdd2"

DEFINITIONS = T.ArrayType(
    T.StructType(
        [
            T.StructField("start_line", T.IntegerType()),
            T.StructField("end_line", T.IntegerType()),
            T.StructField("chunk_type", T.StringType()),
            T.StructField("name", T.StringType()),
        ]
    )
)


@dataclass(frozen=True)
class BoundaryRule:
    """Split at every match of ``pattern`` in files where ``applies`` holds."""

    applies: Column
    pattern: str
    name_group: int
    chunk_type: str

    @property
    def regex(self) -> str:
        # (?d): only \n ends a line; (?U): white space beyond ASCII counts.
        return "(?mdU)" + self.pattern


def heading_rule(applies: Column) -> BoundaryRule:
    return BoundaryRule(applies, fixed.HEADING_PATTERN, 2, "doc_section")


def declaration_rule(applies: Column) -> BoundaryRule:
    return BoundaryRule(applies, fixed.DECLARATION_PATTERN, 1, "block")


def _unmark(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_MARK), F.lit("")), F.lit(_ESCAPED), F.lit(_ESCAPE))


def _windows(lines: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    total = F.size(lines)
    more = F.ceil((total - size) / F.lit(step)).cast("int")
    last = F.when(total <= size, F.lit(0)).otherwise(more)

    def window(i: Column) -> Column:
        return F.struct(
            (i * step + 1).cast("int").alias("start_line"),
            F.least(i * step + size, total).cast("int").alias("end_line"),
            F.lit("block").alias("chunk_type"),
            F.lit(None).cast("string").alias("name"),
            F.array_join(F.slice(lines, i * step + 1, F.lit(size)), "\n").alias("chunk_text"),
        )

    return F.filter(
        F.transform(F.sequence(F.lit(0), last), window), lambda w: tx.has_text(w["chunk_text"])
    )


def _sections(starts: Column, pieces: Column, rules: list[BoundaryRule], kind: Column) -> Column:
    def section(start: Column, piece: Column) -> Column:
        body = tx.rstrip(piece)
        name = F.coalesce(
            *[
                F.when(kind == i, tx.strip(F.regexp_extract(piece, rule.regex, rule.name_group)))
                for i, rule in enumerate(rules)
            ]
        )
        chunk_type = F.coalesce(*[F.when(kind == i, r.chunk_type) for i, r in enumerate(rules)])
        return F.struct(
            start.cast("int").alias("start_line"),
            (start + tx.count_char(body, "\n")).cast("int").alias("end_line"),
            chunk_type.alias("chunk_type"),
            name.alias("name"),
            body.alias("chunk_text"),
        )

    return F.zip_with(starts, pieces, section)


def _definitions(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, name) of the definitions at the top of a module."""
    try:
        body = ast.parse(text).body if text else []
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    return [(n.lineno, n.end_lineno, kinds[type(n)], n.name) for n in body if type(n) in kinds]


@F.pandas_udf(DEFINITIONS)
def _find_definitions(texts: pd.Series) -> pd.Series:
    return texts.map(_definitions)


def _definition_pieces(found: Column, lines: Column) -> Column:
    def piece(d: Column) -> Column:
        body = F.slice(lines, d["start_line"], d["end_line"] - d["start_line"] + 1)
        return F.struct(
            d["start_line"], d["end_line"], d["chunk_type"], d["name"],
            F.array_join(body, "\n").alias("chunk_text"),
        )

    return F.transform(found, piece)


def split_files(
    files: DataFrame,
    rules: list[BoundaryRule],
    size: int = fixed.WINDOW_LINES,
    overlap: int = fixed.WINDOW_OVERLAP,
    python: Column | None = None,
) -> DataFrame:
    """Cut each file at its rule's matches, or in line windows where none match.

    Files for which ``python`` holds are cut at their top-level definitions.
    Only their text goes to a Python worker, and only positions come back.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    carried = [F.col(c) for c in files.columns if c != "text"]
    rows = files.where(tx.has_text(F.col("text")))
    source = F.col("text")
    found: list[Column] = []
    if python is not None:
        source_text = F.when(python, source)
        rows = rows.withColumn("_found", _find_definitions(source_text))
        found = [F.col("_found")]

    if not rules:
        rows = rows.select(*carried, *found, F.split(source, "\n").alias("_lines"))
        pieces = _windows(F.col("_lines"), size, overlap)
    else:
        kind = F.lit(-1)
        for i, rule in reversed(list(enumerate(rules))):
            kind = F.when(rule.applies, i).otherwise(kind)
        escaped = F.replace(source, F.lit(_ESCAPE), F.lit(_ESCAPED))
        matched = [
            F.when(F.col("_kind") == i, F.regexp_replace(escaped, r.regex, _MARK + "$0"))
            for i, r in enumerate(rules)
        ]
        rows = rows.withColumn("_kind", kind)
        rows = rows.select(
            *carried, *found, "_kind", F.coalesce(*matched, escaped).alias("_marked")
        )
        starts = F.array_compact(
            F.transform(
                F.split("_marked", "\n"), lambda line, i: F.when(line.startswith(_MARK), i + 1)
            )
        )
        rows = rows.select(
            *carried,
            *found,
            "_kind",
            starts.alias("_starts"),
            # The part before the first mark is not a section.
            F.transform(F.slice(F.split("_marked", _MARK), 2, 1 << 30), _unmark).alias("_cut"),
            F.split(_unmark(F.col("_marked")), "\n").alias("_lines"),
        )
        pieces = F.when(
            F.size("_starts") > 0,
            _sections(F.col("_starts"), F.col("_cut"), rules, F.col("_kind")),
        ).otherwise(_windows(F.col("_lines"), size, overlap))
    if found:
        by_definition = _definition_pieces(F.col("_found"), F.col("_lines"))
        pieces = F.when(F.size("_found") > 0, by_definition).otherwise(pieces)
    rows = rows.select(*carried, F.inline(pieces))
    return rows.withColumn("content_hash", tx.content_hash(F.col("chunk_text")))


def chunk_windows(
    files: DataFrame, size: int = fixed.WINDOW_LINES, overlap: int = fixed.WINDOW_OVERLAP
) -> DataFrame:
    """CHK-1."""
    return split_files(files, [], size, overlap)


def chunk_headings(files: DataFrame) -> DataFrame:
    """CHK-2; files without a heading are cut in windows."""
    return split_files(files, [heading_rule(F.lit(True))])


def chunk_declarations(files: DataFrame) -> DataFrame:
    """CHK-3; files without a declaration are cut in windows."""
    return split_files(files, [declaration_rule(F.lit(True))])


def chunk_python_defs(
    files: DataFrame, size: int = fixed.WINDOW_LINES, overlap: int = fixed.WINDOW_OVERLAP
) -> DataFrame:
    """CHK-4: one chunk per top-level definition; windows where there is none."""
    return split_files(files, [], size, overlap, python=F.lit(True))


def chunk_files(
    files: DataFrame, size: int = fixed.WINDOW_LINES, overlap: int = fixed.WINDOW_OVERLAP
) -> DataFrame:
    """CHK-5: the rule of each file's language, in one pass over the files."""
    language = F.col("language")
    rules = [
        heading_rule(language == "Markdown"),
        declaration_rule(language.isin(*fixed.BLOCK_LANGUAGES)),
    ]
    return split_files(files, rules, size, overlap, python=language == "Python")


def rejected_corpus(tree: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files that ``chunk_corpus`` leaves out, with ``reason``, without their content."""
    from codelode.operators.filters import file_verdict

    reason = F.when(tx.in_ignored_dir(F.col("path")), "ignored_directory").otherwise(F.col("reason"))
    return file_verdict(tree, max_bytes).withColumn("reason", reason).where("reason IS NOT NULL").drop("content", "ignored")


def chunk_corpus(tree: DataFrame, apply_filter: bool = True, max_bytes: int | None = None) -> DataFrame:
    """CHK-6: binary file rows (``path``, ``length``, ``content``) to chunks.

    Secrets, binaries and ignored directories are left out (``rejected_corpus`` lists them), files of any
    size are indexed unless ``max_bytes`` says otherwise. ``apply_filter=False`` indexes all files.
    """
    from codelode.operators.filters import accepted_files

    files = accepted_files(tree, max_bytes=max_bytes) if apply_filter else tree
    keys = [c for c in files.columns if c not in ("path", "length", "content")]
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return chunk_files(
        files.select(
            *keys,
            F.col("path").alias("file_path"),
            tx.detect_language(F.col("path")).alias("language"),
            text.alias("text"),
        )
    )
