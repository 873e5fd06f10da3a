"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding look-alikes and digit substitutions.

The lexicon is a short built-in list joined by words and word beginnings that training labels single out. A document's
features are its summed weights and their density per hundred words; hits inside exception phrases do not count. A
logistic curve over the two gives the score.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from codelode.llm.common import about, cut_lineage

#: Whole words with which an unlabelled corpus starts, and phrases that excuse a hit.
WORDS = ("idiot", "idiots", "loser", "losers", "moron", "morons", "pathetic", "scum", "scumbag", "stupid", "trash", "worthless", "disgusting", "clown")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "sore loser")
BASE_WEIGHT = 4.0
#: Labelled documents of either kind that are read to learn from, about so many at most; entries that are learned, at most.
TOXIC, CLEAN, ENTRIES = 4096, 8192, 2000
#: Lengths of word beginnings, the log ratio that an entry must reach, and by how many of its standard errors.
SHORTEST, LONGEST, RATIO, ERRORS = 4, 9, 3.5, 3.0
#: Intercept and slopes that the curve is drawn to when labels are few.
PRIOR = (-3.0, 2.0, 1.0)


def _letters() -> dict[int, str]:
    """Look-alikes and accented letters to plain ones."""
    # Cyrillic and Greek letters and the Latin letters they look like.
    alike = dict(zip("аеорсухіјѕкмнтвԁһԛԝαεορυχικντβ", "aeopcyxijskmhtbdhqwaeopuxikvtb", strict=True))
    table = {ord(a): b for a, b in alike.items()}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            table[code] = base.lower()
    return table


LETTERS = _letters()
# Digits and signs written for letters.
DIGITS = str.maketrans("013457@$", "oieastas")
MIXED = re.compile(r"(?<![\w@$])[^\W\d]*[0-9@$][\w@$]*")  # begins at a word only, so long words stay linear
WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, compatibility forms, look-alikes, and digits within words that hold letters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(LETTERS)
    return MIXED.sub(lambda m: m[0].translate(DIGITS) if WORD.search(m[0]) else m[0], text)


class Matcher:
    """Finds lexicon entries (text, whole word?, weight) outside exception phrases in folded text."""

    def __init__(self, entries: list[tuple[str, bool, float]], exceptions: tuple[str, ...] = EXCEPTIONS) -> None:
        self.automaton = ahocorasick.Automaton()
        kinds: dict[str, list] = {}
        for text, whole, weight in entries:
            kinds.setdefault(text, []).append((len(text), whole, weight))
        for phrase in map(fold, exceptions):
            kinds.setdefault(phrase, []).append((len(phrase), True, None))
        for text, found in kinds.items():
            self.automaton.add_word(text, tuple(found))
        if kinds:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) at word starts; of entries with one start the longest counts."""
        best: dict[int, tuple[int, float]] = {}
        excused = []
        if not len(self.automaton):
            return []
        for end, found in self.automaton.iter(text):
            for size, whole, weight in found:
                start = end - size + 1
                if start and text[start - 1].isalnum() or whole and end + 1 < len(text) and text[end + 1].isalnum():
                    continue
                if weight is None:
                    excused.append((start, end))
                else:
                    best[start] = (end, weight)
        return [(s, e, w) for s, (e, w) in best.items() if not any(a <= s and e <= b for a, b in excused)]

    def features(self, text: str) -> tuple[float, float]:
        """Summed weights, and weights per hundred words."""
        folded = fold(text)
        total = sum(w for _, _, w in self.hits(folded))
        return total, 100 * total / max(1, len(folded.split())) if total else 0.0


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def _beginnings(text: str) -> set[str]:
    """Words of a text (marked by an end sign) and their beginnings."""
    found = set()
    for word in set(WORD.findall(fold(text))):
        if len(word) >= SHORTEST:
            found.add(word + "$")
            found.update(word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1))
    return found


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With the least hash of a text's runs of five words, which copies nearly always share."""
    for batch in batches:
        signs = []
        for text in batch.column("text").to_pylist():
            words = (text or "").split()
            signs.append(min(xxhash.xxh32_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))))
        yield pa.record_batch([pa.array(signs, pa.int64()), batch.column("text"), batch.column("toxic")], names=["sign", "text", "toxic"])


def _count_entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(_beginnings(text or ""))
        for at, found in enumerate(counts):
            names = list(found)
            n = pa.array([found[x] for x in names], pa.int64())
            none = pa.array(np.zeros(len(names), np.int64))
            yield pa.record_batch([pa.array(names, pa.string()), n if at else none, none if at else n], names=["entry", "toxic", "clean"])


def lexicon(sample: DataFrame) -> list[tuple[str, bool, float]]:
    """Entries whose share of toxic documents exceeds that of clean ones clearly. Near copies of a text count once or so."""
    sample = sample.mapInArrow(_signed, "sign bigint, text string, toxic int").groupBy("sign", "toxic").agg(F.min("text").alias("text"))
    size = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    counts = sample.mapInArrow(_count_entries, "entry string, toxic bigint, clean bigint").groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    ratio = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    rows = counts.withColumn("weight", ratio).where((ratio > RATIO) & (ratio > ERRORS * error)).orderBy(F.desc("t"), "entry").limit(ENTRIES).collect()
    learned = {r["entry"]: (r["t"], r["weight"]) for r in rows}
    # A beginning goes if one more letter keeps nearly all of its documents, or if a shorter one stands for it.
    longer = Counter()
    for entry, (t, _) in learned.items():
        short = entry[:-1]
        longer[short] = max(longer[short], t)
    kept = {e: w for e, (t, w) in learned.items() if longer[e] < 0.95 * t}
    alone = {e: w for e, w in kept.items() if not any(e[:n] in kept for n in range(SHORTEST, len(e)))}
    found = [(e.removesuffix("$"), e.endswith("$"), w) for e, w in alone.items()]
    return found + [(w, True, BASE_WEIGHT) for w in map(fold, WORDS) if not any(w.startswith(x) for x, _, _ in found)]


def _curve(features: np.ndarray, labels: np.ndarray, draw: float = 1.0) -> np.ndarray:
    """Logistic regression with balanced classes, drawn to ``PRIOR``; slopes stay positive."""
    prior = np.array(PRIOR)
    if not len(labels) or labels.min() == labels.max():
        return prior
    x = np.column_stack([np.ones(len(labels)), np.log1p(features)])
    share = np.where(labels == 1, labels.mean(), 1 - labels.mean())
    weight = 0.5 / share
    beta = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (labels - p)) - draw * (beta - prior)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + draw * np.eye(3)
        step = np.linalg.solve(bend, slope)
        beta += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    beta[1:] = np.maximum(beta[1:], 0.01)
    return beta


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, bool, float]], np.ndarray]:
    """Lexicon and curve from a bounded sample of the labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    chosen = about(known.where("toxic = 1"), "doc_id", TOXIC, size.get(1, 0)).unionAll(about(known.where("toxic = 0"), "doc_id", CLEAN, size.get(0, 0)))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = cut_lineage(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic"))  # about TOXIC + CLEAN ids at most
    entries = lexicon(sample)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(entries)
        for batch in batches:
            found = np.array([matcher.features(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, 2)
            yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1]), batch.column("toxic")], names=["total", "density", "toxic"])

    rows = sample.mapInArrow(measure, "total double, density double, toxic int").toPandas()
    return entries, _curve(rows[["total", "density"]].to_numpy(), rows["toxic"].to_numpy())


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Labels are learned from rows whose crc32(doc_id) mod 3 is not 1, about ``TOXIC`` toxic and ``CLEAN`` clean ones
    at most, by hash; without labels the built-in list and curve hold. Only the text makes a score: null and empty texts score as
    texts without a hit. Repeated rows are kept, a document with several labels counts as toxic if one says so; an empty
    table gives no rows; other columns are not looked at. A row without an id is not held out.
    """
    scored = _scored(docs, labels, id_col, text_col, F.col(id_col).cast("bigint")).withColumnRenamed("kept", "doc_id")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their own columns; nothing is shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _scored(docs, labels, id_col, text_col, row).where(F.col("score") < threshold).select("kept.*")


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, keep: Column) -> DataFrame:
    entries, beta = learn(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(entries)
        for batch in batches:
            found = np.array([matcher.features(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, 2)
            score = 1 / (1 + np.exp(-(beta[0] + np.log1p(found) @ beta[1:])))
            yield pa.record_batch([batch.column("kept"), pa.array(score)], names=["kept", "score"])

    slim = docs.select(keep.alias("kept"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"kept {slim.schema['kept'].dataType.simpleString()}, score double")
