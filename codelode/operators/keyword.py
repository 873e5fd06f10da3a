"""Keyword retrieval (RET-2) on postings.

A chunk is reduced to match keys, each once: its folded words, and the
two-character pairs around characters outside ``a-z0-9`` together with the
token they stand in. A query term has exactly one key, so terms meet chunks in
an equi-join on (repository, run, key); a term that is not a plain word is then
confirmed as a substring of the token. Terms hold no white space, so a
substring of the text is always inside one white-space token. What a term meets
goes on as packed lists of chunk ids (``inverted``), and the best chunks of a
query come from its lists, heaviest term first, until no other can catch up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codelode import fixed
from codelode.functions import scores, text as tx
from codelode.operators import inverted
from codelode.operators.ranking import top_k
from codelode.session import is_small, maybe_broadcast, store

SCOPE = ["repository_id", "ingestion_id"]
# Distinct terms that may be copied to every task; most take under 100 bytes.
TERM_ROWS = 500_000
# Distinct keys that may be named one by one in a filter of the kept index.
NAMED_KEYS = 2_000
_SPECIAL = "[^a-z0-9]"
_PAIR = rf".{_SPECIAL}|{_SPECIAL}."
_WORD = r"\A[a-z0-9]+\z"
# A white-space token with at least one special character.
_SPECIAL_TOKEN = r"(?U)[a-z0-9]*+[^a-z0-9\s\x1c-\x1f][^\s\x1c-\x1f]*+"


def _folded_words(blob: Column) -> Column:
    # Splitting may leave an empty word, which no term equals.
    words = F.array_distinct(F.split(blob, f"{_SPECIAL}+"))
    return F.array_distinct(F.transform(words, tx.fold))


def _special_keys(blob: Column) -> Column:
    """(key, token) of each special token: pairs and lone non-ASCII characters.

    A term neither starts nor ends with edge punctuation, so that much is
    trimmed from the tokens first. A dot at the end stays: terms may end so.
    """
    tokens = F.array_distinct(F.regexp_extract_all(blob, F.lit(_SPECIAL_TOKEN), 0))
    trimmed = F.transform(
        tokens,
        lambda t: F.rtrim(
            F.ltrim(t, F.lit(fixed.EDGE_PUNCTUATION)), F.lit(fixed.EDGE_PUNCTUATION)
        ),
    )
    special = F.filter(F.array_distinct(trimmed), lambda t: t.rlike(_SPECIAL))

    def keys(token: Column) -> Column:
        pairs = F.regexp_extract_all(token, F.lit(f"(?s)(?=({_PAIR}))"), 1)
        alone = F.regexp_extract_all(token, F.lit(r"[^\x00-\x7f]"), 0)
        # Only a token with more bytes than characters has any.
        alone = F.when(F.octet_length(token) > F.length(token), alone).otherwise(F.array().cast("array<string>"))
        return F.transform(
            F.array_distinct(F.concat(pairs, alone)),
            lambda g: F.struct(g.alias("key"), token.alias("token")),
        )

    return F.flatten(F.transform(special, keys))


def _term_key(term: Column) -> Column:
    """The one key of a lower-cased term; a one-character term is its own key."""
    pair = F.regexp_extract(term, f"(?s){_PAIR}", 0)
    return F.when(term.rlike(_WORD), tx.fold(term)).when(pair != "", pair).otherwise(term)


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct lower-cased terms per query (FN-7, SET-2)."""
    terms = F.transform(tx.lexical_terms(F.col("query")), lambda t: F.lower(t))
    rows = queries.select("query_id", *SCOPE, F.explode(terms).alias("term"))
    return rows.withColumn("match_key", _term_key(F.col("term")))


def build_postings(chunks: DataFrame, by_chunk: bool = False) -> DataFrame:
    """Distinct match keys of name, path and text, one row each.

    The result may be kept as a table and handed to ``keyword_search``. With
    ``by_chunk`` a chunk keeps its one row, with ``keys`` and ``tokens``, the
    tokens of the first keys; the other keys have none.
    """
    blob = F.lower(
        F.concat_ws(" ", F.coalesce(F.col("name"), F.lit("")), F.col("file_path"), F.col("chunk_text"))
    )
    kept = [*SCOPE, "chunk_id", "file_path"]
    rows = chunks.select(*kept, blob.alias("_blob"))
    rows = rows.select(
        *kept,
        _folded_words(F.col("_blob")).alias("_words"),
        _special_keys(F.col("_blob")).alias("_special"),
    )
    # Words hold only a-z0-9 and special keys never do, so the two cannot meet.
    keys, tokens = F.concat(F.col("_special.key"), F.col("_words")), F.col("_special.token")
    if by_chunk:
        return rows.select(*kept, keys.alias("keys"), tokens.alias("tokens"))
    # The word part has no token: zipping pads it with NULL.
    return rows.select(*kept, F.inline(F.arrays_zip(keys, tokens)).alias("match_key", "token"))


def term_matches(terms: DataFrame, postings: DataFrame, small: bool) -> DataFrame:
    """JN-4 and JN-5: distinct (chunk, term) pairs."""
    wanted = terms.select(*SCOPE, "term", "match_key").distinct()
    small = small or is_small(wanted, TERM_ROWS)
    met = postings.join(maybe_broadcast(wanted, small), [*SCOPE, "match_key"])
    met = met.where(F.col("token").isNull() | F.contains("token", "term"))
    return met.select(*SCOPE, "chunk_id", "file_path", "term").distinct()


def document_frequency(terms: DataFrame, matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """AGG-7: df and N of every asked term over the whole run; absent terms have df 0."""
    sizes = chunks.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n"))
    return _frequencies(terms, matches.select(*SCOPE, "term", F.lit(1).alias("df")), sizes)


def _frequencies(terms: DataFrame, found: DataFrame, sizes: DataFrame) -> DataFrame:
    """df and N of every asked term from partial counts ``found(scope, term, df)``."""
    found = found.groupBy(*SCOPE, "term").agg(F.sum("df").alias("df"))
    asked = terms.select(*SCOPE, "term", "match_key").distinct().drop("match_key")
    return (
        asked.join(found, [*SCOPE, "term"], "left")
        .join(sizes, SCOPE)
        .withColumn("df", F.coalesce("df", F.lit(0)))
    )


def weighted_terms(terms: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Terms of each query with weight units and the query's total."""
    units = scores.weight_units(scores.idf_weight(F.col("df"), F.col("n")))
    rows = terms.select("query_id", *SCOPE, "term").join(
        frequencies.withColumn("units", units), [*SCOPE, "term"]
    )
    # A query has at most 500 terms, so this window is small whatever the data.
    total = F.sum("units").over(Window.partitionBy("query_id"))
    return rows.withColumn("total_units", total)


def symbol_matches(queries: DataFrame, chunks: DataFrame, small: bool) -> DataFrame:
    """JN-6: chunks whose name is the whole query, case aside."""
    asked = queries.select("query_id", *SCOPE, F.lower(tx.strip(F.col("query"))).alias("symbol"))
    named = chunks.where(F.col("name") != "").select(
        *SCOPE, "chunk_id", "file_path", F.lower("name").alias("symbol")
    )
    return named.join(maybe_broadcast(asked, small), [*SCOPE, "symbol"]).drop("symbol")


def term_lists(
    terms: DataFrame,
    chunks: DataFrame,
    postings: DataFrame | None = None,
    index: DataFrame | None = None,
    small: bool = False,
) -> DataFrame:
    """One packed list of chunk ids per asked (scope, term, shard), from the kept ``index`` or from ``postings``."""
    if index is None:
        matches = term_matches(terms, build_postings(chunks) if postings is None else postings, small)
        shards = chunks.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("_n"))
        rows = matches.join(shards, SCOPE).withColumn("shard", inverted.shard_of("chunk_id", "_n"))
        return inverted.pack(rows, ["term"])
    wanted = terms.select(*SCOPE, "term", "match_key").distinct()
    small = small or is_small(wanted, TERM_ROWS)
    if small:
        # Keys named one by one reach the reader, which skips the row groups of all others.
        keys = [r.match_key for r in wanted.select("match_key").distinct().limit(NAMED_KEYS + 1).collect()]
        if len(keys) <= NAMED_KEYS:
            index = index.where(F.col("match_key").isin(*keys))
    met = index.join(maybe_broadcast(wanted, small), [*SCOPE, "match_key"])
    return inverted.merge_lists(met.where(F.col("token").isNull() | F.contains("token", "term")))


def _lexical(
    queries: DataFrame,
    chunks: DataFrame,
    postings: DataFrame | None,
    index: DataFrame | None,
    small: bool,
    best_only: bool,
) -> DataFrame:
    """(query_id, chunk_id, lex_score) of chunks that match a term or are the named symbol.

    With ``best_only``, of the chunks that pass a request's filters the ``candidate_k`` best of each shard.
    """
    asked_scopes = queries.select(*SCOPE).distinct()
    chunks = chunks.join(maybe_broadcast(asked_scopes, small), SCOPE, "left_semi")
    terms = query_terms(queries)
    # Read twice below; stored, so that the text of all chunks is read once.
    lists = store(term_lists(terms, chunks, postings, index, small), "term-lists")
    found = lists.select(*SCOPE, "term", F.col("n").alias("df"))
    sizes = chunks.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n"))
    weighted = weighted_terms(terms, _frequencies(terms, found, sizes))
    filtered = F.lit(False)
    k, passing = F.lit(2**31 - 1), None
    if best_only:
        k = F.col("candidate_k")
        filtered = (F.coalesce(F.size("file_extensions"), F.lit(0)) > 0) | (F.coalesce(F.size("file_paths"), F.lit(0)) > 0)
        asked = queries.where(filtered).select("query_id", *SCOPE, "file_extensions", "file_paths")
        paths = chunks.select(*SCOPE, "chunk_id", "file_path").join(sizes, SCOPE)
        met = paths.join(maybe_broadcast(asked, small), SCOPE).where(
            tx.passes_filters(F.col("file_path"), F.col("file_extensions"), F.col("file_paths"))
        )
        shard = inverted.shard_of("chunk_id", "n")
        passing = met.groupBy("query_id", shard.alias("shard")).agg(
            F.array_sort(F.collect_list(F.col("chunk_id").cast("bigint"))).alias("allowed")
        )
    limits = queries.select("query_id", k.alias("candidate_k"), filtered.alias("filtered"))
    weighted = weighted.join(maybe_broadcast(limits, small), "query_id")
    by_term = inverted.best_chunks(weighted, lists, passing)
    exact = symbol_matches(queries, chunks, small)
    if best_only:
        filters = queries.select("query_id", "file_extensions", "file_paths")
        exact = exact.join(maybe_broadcast(filters, small), "query_id").where(
            tx.passes_filters(F.col("file_path"), F.col("file_extensions"), F.col("file_paths"))
        )
    scored = by_term.select("query_id", "chunk_id", scores.coverage(F.col("units"), F.col("total_units")).alias("lex_score"))
    named = exact.select("query_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.lit(1.0).alias("lex_score"))
    return scored.unionByName(named).groupBy("query_id", "chunk_id").agg(F.max("lex_score").alias("lex_score"))


def keyword_scores(
    queries: DataFrame,
    chunks: DataFrame,
    postings: DataFrame | None = None,
    small: bool | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """AGG-8 for every chunk that matches a term or is the named symbol."""
    small = is_small(queries) if small is None else small
    return _lexical(queries, chunks, postings, index, small, best_only=False)


def keyword_search(
    queries: DataFrame,
    chunks: DataFrame,
    postings: DataFrame | None = None,
    small: bool | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """RET-2: ``(query_id, chunk_id, lex_score, rank)``, the best ``candidate_k`` per query.

    Path and extension filters narrow the result rows only; df and N count
    the whole run. With ``index`` (``inverted.read_index``) no chunk text is
    read. ``chunk_id`` is a whole number.
    """
    small = is_small(queries) if small is None else small
    found = _lexical(queries, chunks, postings, index, small, best_only=True)
    limits = queries.select("query_id", "candidate_k")
    rows = found.join(maybe_broadcast(limits, small), "query_id")
    order = [F.col("lex_score").desc(), F.col("chunk_id")]
    best = top_k(rows, ["query_id"], order, None, F.col("candidate_k"))
    return best.select("query_id", "chunk_id", "lex_score", "rank")
