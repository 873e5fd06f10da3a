"""DuckDB expressions that say the same as ``codelode.functions``."""

from __future__ import annotations

import re

from codelode import fixed


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def base(p: str) -> str:
    return f"regexp_extract({p}, '[^/]*$', 0)"


def suffix(p: str) -> str:
    return rf"regexp_extract(lower({base(p)}), '(?s)^\.*[^.].*(\.[^.]*)$', 1)"


def stem(p: str) -> str:
    return f"left({base(p)}, length({base(p)}) - length({suffix(p)}))"


def top_dir(p: str) -> str:
    return f"CASE WHEN contains({p}, '/') THEN split_part({p}, '/', 1) ELSE '<root>' END"


def depth(p: str) -> str:
    return f"(len(string_split({p}, '/')) - 1)"


def language(p: str) -> str:
    name = f"lower({base(p)})"
    named = " ".join(f"WHEN {name} = '{k}' THEN '{v}'" for k, v in fixed.LANGUAGE_FILE_NAMES.items())
    by_ext = " ".join(
        f"WHEN {suffix(p)} IN ({quoted(exts)}) THEN '{lang}'"
        for lang, exts in fixed.LANGUAGE_EXTENSIONS.items()
    )
    return (
        f"CASE {named} WHEN starts_with({name}, 'dockerfile.') OR "
        f"starts_with({name}, 'containerfile.') THEN 'Dockerfile' {by_ext} END"
    )


def ignored_dir(p: str) -> str:
    names = quoted(fixed.IGNORED_DIRECTORIES)
    return (
        f"(list_has_any(string_split({p}, '/')[:-2], [{names}]) OR "
        f"list_has_any(string_split(lower({p}), '/')[:-2], [{names}]))"
    )


def secret(p: str) -> str:
    globs = "|".join(
        "".join(".*" if c == "*" else re.escape(c) for c in g) for g in fixed.SECRET_GLOBS
    )
    return (
        f"(regexp_full_match(lower({base(p)}), '(?s)(?:{globs})') OR "
        f"regexp_full_match(lower({p}), '(?s)(?:{globs})'))"
    )


def binary_extension(p: str) -> str:
    return f"({suffix(p)} IN ({quoted(fixed.BINARY_EXTENSIONS)}))"


def verdict(p: str, length: str, limit: int) -> str:
    return (
        f"CASE WHEN {secret(p)} THEN 'secret_or_credential_file' "
        f"WHEN {binary_extension(p)} THEN 'binary_extension' "
        f"WHEN {length} > {limit} THEN concat('file_size_exceeded_', {length}, '_bytes') END"
    )


def line_count(t: str) -> str:
    unix = rf"regexp_replace({t}, '\r\n?', chr(10), 'g')"
    return (
        f"(length({unix}) - length(replace({unix}, chr(10), '')) + "
        f"CASE WHEN {unix} <> '' AND NOT ends_with({unix}, chr(10)) THEN 1 ELSE 0 END)"
    )


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def has_text(t: str) -> str:
    return rf"regexp_matches({t}, '\S')"


def words(t: str) -> str:
    spaced = rf"regexp_replace({t}, '([a-z0-9])([A-Z])', '\1 \2', 'g')"
    return f"regexp_extract_all(lower({spaced}), '[a-z0-9]+')"


def singular(w: str) -> str:
    return (
        f"CASE WHEN length({w}) > 3 AND ends_with({w}, 's') AND NOT ends_with({w}, 'ss') "
        f"THEN left({w}, length({w}) - 1) ELSE {w} END"
    )


def fold(w: str) -> str:
    return (
        f"CASE WHEN length({w}) > 3 AND ends_with({w}, 's') "
        f"THEN left({w}, length({w}) - 1) ELSE {w} END"
    )


def path_words(p: str) -> str:
    return f"list_transform({words(p)}, lambda w: {singular('w')})"


def path_terms(q: str) -> str:
    skipped = quoted(fixed.STOPWORDS + fixed.EXTENSION_WORDS)
    return (
        f"list_transform(list_filter({words(q)}, lambda w: length(w) >= 2 AND w NOT IN ({skipped})), "
        f"lambda w: {singular('w')})"
    )


def path_matches(p: str, q: str) -> str:
    return f"list_has_any({path_terms(q)}, {path_words(p)})"


def terms(q: str) -> str:
    """Content-bearing terms, lower-cased, with repeats."""
    edge = "'" + fixed.EDGE_PUNCTUATION.replace("'", "''") + "'"
    cleaned = (
        rf"list_transform(regexp_split_to_array({q}, '\s+'), "
        f"lambda t: lower(trim(rtrim(trim(t, {edge}), '.'), {edge})))"
    )
    bare = "CASE WHEN ends_with(t, '''s') THEN left(t, length(t) - 2) ELSE t END"
    return (
        rf"list_filter({cleaned}, lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]') "
        f"AND ({bare}) NOT IN ({quoted(fixed.STOPWORDS)}))"
    )


def broad(q: str) -> str:
    patterns = "|".join(f"(?:{p})" for p in fixed.BROAD_PATTERNS)
    return (
        f"(regexp_matches(lower({q}), '{patterns}') OR "
        f"(regexp_matches(lower({q}), '{fixed.STRUCTURE_PATTERN}') AND "
        f"regexp_matches(lower({q}), '{fixed.REPOSITORY_NOUN_PATTERN}')))"
    )


def overview(p: str, name: str, start: str) -> str:
    heading = f"lower(coalesce({name}, ''))"
    low = f"lower({p})"
    return (
        f"CASE WHEN starts_with({base(low)}, 'readme') AND {depth(p)} = 0 "
        f"THEN {start} <= 1 OR regexp_matches({heading}, '{fixed.OVERVIEW_HEADING_PATTERN}') "
        f"WHEN {suffix(p)} IN ({quoted(fixed.OVERVIEW_DOC_SUFFIXES)}) AND "
        f"({stem(low)} IN ({quoted(fixed.OVERVIEW_DOC_STEMS)}) "
        f"OR contains({stem(low)}, 'architecture') OR contains({stem(low)}, 'overview')) THEN true "
        f"WHEN {base(low)} IN ({quoted(fixed.ENTRY_POINT_FILES)}) AND {depth(p)} <= 1 "
        f"THEN {heading} IN ({quoted(fixed.ENTRY_POINT_SYMBOLS)}) OR ({name} IS NULL AND {start} <= 1) "
        f"ELSE false END"
    )


def overview_rank(p: str) -> str:
    low = f"lower({p})"
    return (
        f"CASE WHEN NOT contains({p}, '/') AND starts_with({low}, 'readme') THEN 0 "
        f"WHEN {base(low)} IN ({quoted(fixed.ENTRY_POINT_FILES)}) THEN 2 ELSE 1 END"
    )


def comment_only(t: str, p: str) -> str:
    heads = "|".join(re.escape(c) for c in fixed.COMMENT_PREFIXES)
    lines = f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"
    return (
        f"({suffix(p)} NOT IN ({quoted(fixed.DOC_SUFFIXES)}) AND len({lines}) > 0 AND "
        f"len(list_filter({lines}, lambda x: NOT regexp_matches(x, '^(?:{heads})'))) = 0)"
    )


def non_evidence(t: str, p: str, q: str) -> str:
    return (
        f"CASE WHEN {path_matches(base(p), q)} THEN false "
        f"WHEN lower({base(p)}) IN ({quoted(fixed.IGNORE_PATTERN_FILES)}) THEN true "
        f"ELSE {comment_only(t, p)} END"
    )


def passes(p: str, exts: str, prefixes: str) -> str:
    dotted = "CASE WHEN starts_with(e, '.') THEN e ELSE concat('.', e) END"
    return (
        f"(({exts} IS NULL OR len(list_filter({exts}, lambda e: ends_with({p}, {dotted}))) > 0) AND "
        f"({prefixes} IS NULL OR len(list_filter({prefixes}, lambda x: {p} LIKE concat(x, '%'))) > 0))"
    )


def tokens(t: str) -> str:
    return f"CAST(ceil(length({t}) / 4.0) AS BIGINT)"


def location(p: str, a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} IS NULL THEN {p} WHEN {b} IS NULL OR {b} = {a} THEN concat({p}, ':', {a}) "
        f"ELSE concat({p}, ':', {a}, '-', {b}) END"
    )
