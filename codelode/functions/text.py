"""Text, path and query expressions (FN-*, and the text predicates of FLT-*)."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from codelode import fixed

# All characters that count as white space when text is stripped or split.
WHITESPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
WS_CLASS = r"[\s\x1c-\x1f]"
NON_WS = r"(?U)[^\s\x1c-\x1f]"
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def has_text(text: Column) -> Column:
    """FLT-13: not NULL and not blank."""
    return F.coalesce(text.rlike(NON_WS), F.lit(False))


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def line_count(text: Column) -> Column:
    """FN-2: universal newlines; an unterminated last line counts."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    open_end = (F.length(unix) > 0) & ~F.endswith(unix, F.lit("\n"))
    return (count_char(unix, "\n") + open_end.cast("int")).cast("long")


def content_hash(text: Column) -> Column:
    """FN-4."""
    return F.sha2(strip(text), 256)


# ---- paths ----------------------------------------------------------------


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-cased last extension with its dot; leading dots are not extensions."""
    return F.regexp_extract(F.lower(base_name(path)), r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def top_dir(path: Column) -> Column:
    """FN-3."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("<root>")


def depth(path: Column) -> Column:
    """Number of directories above the file."""
    return F.size(F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))) - 1


def detect_language(path: Column) -> Column:
    """FN-1: file-name table, container-file prefixes, extension table, else NULL."""
    by_name = F.create_map(*[F.lit(x) for kv in fixed.LANGUAGE_FILE_NAMES.items() for x in kv])
    pairs = [(ext, lang) for lang, exts in fixed.LANGUAGE_EXTENSIONS.items() for ext in exts]
    by_ext = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    name = F.lower(base_name(path))
    return F.coalesce(
        F.try_element_at(by_name, name),
        F.when(name.startswith("dockerfile.") | name.startswith("containerfile."), "Dockerfile"),
        F.try_element_at(by_ext, suffix(path)),
    )


def in_ignored_dir(path: Column) -> Column:
    """FLT-1: some directory component, as written or lower-cased, is in the set."""
    dirs = F.split(path, "/")
    dirs = F.slice(dirs, 1, F.greatest(F.size(dirs) - 1, F.lit(0)))
    names = _lit_array(fixed.IGNORED_DIRECTORIES)
    return F.arrays_overlap(dirs, names) | F.arrays_overlap(
        F.transform(dirs, lambda d: F.lower(d)), names
    )


def _glob_pattern() -> str:
    globs = ["".join(".*" if c == "*" else re.escape(c) for c in g) for g in fixed.SECRET_GLOBS]
    return r"(?s)\A(?:" + "|".join(globs) + r")\z"


def is_secret_file(path: Column) -> Column:
    """FLT-2: a secret-file glob fits the whole lower-cased path or its last part."""
    pattern = _glob_pattern()
    whole = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return (
        F.lower(base_name(path)).rlike(pattern)
        | whole.rlike(pattern)
        | base_name(whole).rlike(pattern)
    )


def has_binary_extension(path: Column) -> Column:
    """FLT-3."""
    return suffix(path).isin(*fixed.BINARY_EXTENSIONS)


def is_binary_content(content: Column) -> Column:
    """FLT-5, on the leading bytes of a binary column."""
    sample = F.substring(content, 1, fixed.BINARY_SAMPLE_BYTES)
    chars = F.decode(sample, "ISO-8859-1")
    control = F.length(F.regexp_replace(chars, r"[^\x01-\x06\x0b\x0e-\x1a\x1c-\x1f]", ""))
    return (
        F.when(F.length(sample) == 0, False)
        .when(F.contains(chars, F.lit("\x00")), True)
        .when(F.is_valid_utf8(sample.cast("string")), False)
        .otherwise(control / F.length(sample) > fixed.BINARY_RATIO)
    )


def dotted(extension: Column) -> Column:
    return F.when(extension.startswith("."), extension).otherwise(
        F.concat(F.lit("."), extension)
    )


def _quoted(text: Column, kept: str = "") -> Column:
    """Regular expression that matches ``text`` itself; ``kept`` characters stay bare."""
    return F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}{kept}]", r"\\$0")


def passes_filters(path: Column, extensions: Column, prefixes: Column) -> Column:
    """FLT-7 and FLT-8 of one request on a path; NULL or empty arrays filter nothing.

    Only a prefix with wildcards (``_``, ``%``) needs a regular expression.
    """
    ends = F.exists(extensions, lambda e: F.endswith(path, dotted(e)))

    def begins(prefix: Column) -> Column:
        pattern = F.concat(F.lit(r"(?s)\A"), F.replace(F.replace(_quoted(prefix, "_%"), F.lit("_"), F.lit(".")), F.lit("%"), F.lit(".*")))
        return F.when(prefix.contains("_") | prefix.contains("%"), F.rlike(path, pattern)).otherwise(F.startswith(path, prefix))

    none = lambda values: F.coalesce(F.size(values), F.lit(0)) <= 0
    return (none(extensions) | ends) & (none(prefixes) | F.exists(prefixes, begins))


def path_filter_pattern(extensions: Column, prefixes: Column) -> Column:
    """FLT-7 and FLT-8 of one request as a pattern for ``rlike`` on a path.

    Built once per request, so that the test against each path is one compiled
    expression. NULL or empty arrays filter nothing; ``_`` and ``%`` in a
    prefix are wildcards.
    """

    def wild(prefix: Column) -> Column:
        bare = _quoted(prefix, "_%")
        return F.replace(F.replace(bare, F.lit("_"), F.lit(".")), F.lit("%"), F.lit(".*"))

    def either(values: Column, to_pattern, head: str, tail: str) -> Column:
        joined = F.array_join(F.transform(values, to_pattern), "|")
        return F.when(F.size(values) > 0, F.concat(F.lit(head), joined, F.lit(tail))).otherwise("")

    starts = either(prefixes, wild, "(?=(?:", "))")
    ends = either(extensions, lambda e: _quoted(dotted(e)), "(?=.*(?:", r")\z)")
    return F.concat(F.lit(r"(?s)\A"), F.coalesce(starts, F.lit("")), F.coalesce(ends, F.lit("")))


# ---- words ----------------------------------------------------------------


def split_words(text: Column) -> Column:
    spaced = F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.regexp_extract_all(F.lower(spaced), F.lit("[a-z0-9]+"), 0)


def singular(word: Column) -> Column:
    """Plural folding of FN-5: keeps words ending in a double s."""
    plural = (F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss")
    return F.when(plural, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def fold(word: Column) -> Column:
    """FN-9: keyword-side folding, with no exception for a double s."""
    plural = (F.length(word) > 3) & word.endswith("s")
    return F.when(plural, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def path_words(path: Column) -> Column:
    """FN-5, path side."""
    return F.array_distinct(F.transform(split_words(path), singular))


def path_match_terms(query: Column) -> Column:
    """FN-5, query side."""
    skipped = fixed.STOPWORDS + fixed.EXTENSION_WORDS
    words = F.filter(split_words(query), lambda w: (F.length(w) >= 2) & ~w.isin(*skipped))
    return F.array_distinct(F.transform(words, singular))


def path_matches_query(path: Column, query: Column) -> Column:
    """FN-6."""
    return F.arrays_overlap(path_match_terms(query), path_words(path))


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, f"(?U){WS_CLASS}+"), lambda t: t != "")


def lexical_terms(query: Column) -> Column:
    """FN-7: content-bearing terms in order, first spelling of each kept."""
    edge = F.lit(fixed.EDGE_PUNCTUATION)

    def clean(token: Column) -> Column:
        return F.btrim(F.rtrim(F.btrim(token, edge), F.lit(".")), edge)

    def content(token: Column) -> Column:
        lowered = F.lower(token)
        bare = F.when(
            lowered.endswith("'s"), F.substring(lowered, F.lit(1), F.length(lowered) - 2)
        ).otherwise(lowered)
        return token.rlike(r"[\p{L}\p{N}]") & ~bare.isin(*fixed.STOPWORDS)

    cleaned = F.filter(F.transform(whitespace_tokens(query), clean), content)
    # An aggregate over the few words of one query keeps the first spelling.
    return F.aggregate(
        cleaned,
        F.array().cast("array<string>"),
        lambda seen, t: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(t)), seen).otherwise(
            F.array_append(seen, t)
        ),
    )


def is_broad_question(query: Column) -> Column:
    """FLT-16."""
    lowered = F.lower(query)
    return lowered.rlike("|".join(f"(?:{p})" for p in fixed.BROAD_PATTERNS)) | (
        lowered.rlike(fixed.STRUCTURE_PATTERN) & lowered.rlike(fixed.REPOSITORY_NOUN_PATTERN)
    )


def stem(path: Column) -> Column:
    """Last path part without its extension."""
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def is_overview_chunk(path: Column, name: Column, start_line: Column) -> Column:
    """FLT-15."""
    lowered = F.lower(path)
    base, level = base_name(lowered), depth(lowered)
    heading = F.lower(F.coalesce(name, F.lit("")))
    doc_stem = stem(lowered)
    doc = suffix(path).isin(*fixed.OVERVIEW_DOC_SUFFIXES) & (
        doc_stem.isin(*fixed.OVERVIEW_DOC_STEMS)
        | doc_stem.rlike("|".join(fixed.OVERVIEW_DOC_STEM_PARTS))
    )
    return (
        F.when(
            base.startswith("readme") & (level == 0),
            (start_line <= 1) | heading.rlike(fixed.OVERVIEW_HEADING_PATTERN),
        )
        .when(doc, True)
        .when(
            base.isin(*fixed.ENTRY_POINT_FILES) & (level <= 1),
            heading.isin(*fixed.ENTRY_POINT_SYMBOLS) | (name.isNull() & (start_line <= 1)),
        )
        .otherwise(False)
    )


def overview_rank(path: Column) -> Column:
    """SRT-3: root README, then documents, then entry points."""
    lowered = F.lower(path)
    base = base_name(lowered)
    return (
        F.when(~F.contains(lowered, F.lit("/")) & base.startswith("readme"), 0)
        .when(base.isin(*fixed.ENTRY_POINT_FILES), 2)
        .otherwise(1)
    )


def is_comment_only(text: Column, path: Column) -> Column:
    """FLT-10: outside documents, every non-blank line starts like a comment."""
    heads = "|".join(re.escape(p) for p in fixed.COMMENT_PREFIXES)
    lines = F.transform(F.split(text, LINE_BREAKS), strip)
    lines = F.filter(lines, lambda line: line != "")
    # Most code is settled by its first non-blank character, without a split.
    first = strip(text).rlike(rf"\A(?:{heads})")
    return (
        ~suffix(path).isin(*fixed.DOC_SUFFIXES)
        & first
        & F.forall(lines, lambda line: line.rlike(rf"\A(?:{heads})"))
    )


def is_non_evidence(text: Column, path: Column, query: Column) -> Column:
    """FLT-11: never citable for this query (original-case query words)."""
    return (
        F.when(path_matches_query(base_name(path), query), False)
        .when(F.lower(base_name(path)).isin(*fixed.IGNORE_PATTERN_FILES), True)
        .otherwise(is_comment_only(text, path))
    )


# ---- sizes, labels, request texts -----------------------------------------


def estimate_tokens(text: Column) -> Column:
    """FN-10 for one text; NULL and empty cost nothing."""
    return F.coalesce(F.ceil(F.length(text) / fixed.CHARS_PER_TOKEN), F.lit(0)).cast("long")


def message_tokens(text: Column) -> Column:
    """FN-10 for one message."""
    return estimate_tokens(text) + fixed.MESSAGE_OVERHEAD_TOKENS


def estimate_embedding_tokens(text: Column) -> Column:
    """FN-11."""
    whole = F.floor(F.length(text) / fixed.EMBEDDING_CHARS_PER_TOKEN) + 1
    return F.greatest(F.lit(1), whole).cast("long")


def snippet(text: Column) -> Column:
    """FN-17."""
    return F.left(text, F.lit(fixed.SNIPPET_CHARS))


def _present(value: Column) -> Column:
    """NULL for an empty string."""
    return F.nullif(value, F.lit(""))


def location(path: Column, start: Column, end: Column) -> Column:
    """FN-14."""
    return (
        F.when(start.isNull(), path)
        .when(end.isNull() | (end == start), F.concat_ws(":", path, start.cast("string")))
        .otherwise(F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))
    )


def evidence_block(rank: Column, chunk: dict[str, Column]) -> Column:
    """FN-18: one citation header line, then the chunk text."""
    span = F.concat(
        chunk["file_path"], F.lit(":"), chunk["start_line"].cast("string"),
        F.lit("-"), chunk["end_line"].cast("string"),
    )
    header = F.concat_ws(
        ", ",
        F.concat(F.lit("Source "), rank.cast("string"), F.lit(": "), span),
        F.concat(F.lit("language="), _present(chunk["language"])),
        F.concat(F.lit("symbol="), _present(chunk["name"])),
        F.concat(F.lit("score="), F.format_string("%.2f", chunk["score"].cast("double"))),
    )
    return F.concat(F.lit("["), header, F.lit("]\n"), chunk["chunk_text"])


def explain_query(path: Column, symbol: Column, question: Column) -> Column:
    """FN-19 for an explain request."""
    picked = F.coalesce(_present(symbol), _present(question), _present(stem(path)), path)
    return F.left(picked, F.lit(fixed.QUERY_CHARS))


def review_query(path: Column, symbol: Column, user_code: Column) -> Column:
    """FN-19 for a review request."""
    lines = F.transform(F.split(user_code, LINE_BREAKS), strip)
    first_line = F.try_element_at(F.filter(lines, lambda line: line != ""), F.lit(1))
    picked = F.coalesce(
        _present(symbol),
        F.when(_present(path).isNotNull(), F.coalesce(_present(stem(path)), path)),
        first_line,
        F.lit("code review"),
    )
    return F.left(picked, F.lit(fixed.QUERY_CHARS))


def _target(path: Column, start: Column, end: Column, symbol: Column) -> Column:
    named = F.concat(F.lit(" (symbol: "), _present(symbol), F.lit(")"))
    return F.concat(location(path, start, end), F.coalesce(named, F.lit("")))


def explain_question(
    path: Column, start: Column, end: Column, symbol: Column, question: Column
) -> Column:
    """FN-20 for an explain request."""
    return F.concat(
        F.lit("Explain the code at "), _target(path, start, end, symbol), F.lit("."),
        F.coalesce(F.concat(F.lit(" Specifically: "), _present(question)), F.lit("")),
    )


def review_question(
    focus: Column,
    path: Column,
    start: Column,
    end: Column,
    symbol: Column,
    user_code: Column,
    response_format: str = "",
) -> Column:
    """FN-20 for a review request; ``response_format`` is the caller's own wording."""
    code = F.concat(
        F.lit(fixed.USER_CODE_LABEL + "\n```\n"), _present(user_code), F.lit("\n```")
    )
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Perform a "), focus, F.lit(" code review.")),
        F.when(
            _present(path).isNotNull(),
            F.concat(F.lit("Repository target: "), _target(path, start, end, symbol)),
        ),
        code,
        _present(F.lit(response_format)),
    )


def explain_label(path: Column, start: Column) -> Column:
    """FN-21; a NULL or zero start line is left out."""
    line = F.when(start != 0, F.concat(F.lit(":"), start.cast("string")))
    return F.concat(F.lit("[explain] "), path, F.coalesce(line, F.lit("")))


def review_label(focus: Column, path: Column) -> Column:
    """FN-21."""
    target = F.coalesce(_present(path), F.lit("user-provided code"))
    return F.concat(F.lit("[review:"), focus, F.lit("] "), target)
