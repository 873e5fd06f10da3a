"""Byte-pair encoding as a left-to-right transducer with bounded lookahead, and decoding as a byte-to-text machine.

Two neighbouring tokens can stand in an encoding exactly if no merge ever crosses their border: on the right edge of the
first and the left edge of the second, no two pieces that live at the same time have a merge of an earlier rank than the
merges that consume them. An encoding's prefix is the encoding of the prefix's text, so each position has one last token,
found from the last tokens at earlier positions. The token that will cover the present position starts within the longest
token's length; so the sufficient lookahead is that length, and what all positions of that stretch share is stable.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

# The published split pattern of this vocabulary family.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Remembered words (twice, in a young and an old generation) and token borders of a Python worker.
WORDS, BORDERS = 160_000, 400_000
#: Positions of a long word between two attempts to emit, and bytes up to which a word is short.
SETTLE, SHORT = 1024, 128
#: Tokens (and a hundred for each row) after which finished rows are handed out.
HELD = 1 << 19
STOPS = frozenset(".,;:!?")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: visible bytes for themselves, the others from code point 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """Plain tables of a tokenizer file, with room for what workers remember."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    letters = byte_letters()
    raw = lambda token: bytes(map(letters.__getitem__, token))
    ids = {raw(token): i for token, i in whole["model"]["vocab"].items() if all(c in letters for c in token)}
    ranks, parts = {}, {}
    for rank, pair in enumerate(whole["model"]["merges"]):
        left, right = map(raw, pair if isinstance(pair, list) else pair.split(" "))
        ranks[left, right] = rank
        parts.setdefault(left + right, (left, right))
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    reach: dict[bytes, int] = {}
    for token in ids:
        reach[token[:2]] = max(reach.get(token[:2], 1), len(token))
    return {"ids": ids, "ranks": ranks, "parts": parts, "special": special, "words": {}, "old": {}, "borders": {}, "reach": reach}


def sufficient_lookahead(tables: dict) -> int:
    """Bytes behind a position that can still change its last tokens: the length of the longest token."""
    return max(map(len, tables["ids"]))


class Encoder:
    """Encodes texts with shared ``tables``; the order of texts never changes a result."""

    def __init__(self, tables: dict) -> None:
        self.ids, self.ranks, self.parts = tables["ids"], tables["ranks"], tables["parts"]
        self.words, self.old, self.borders, self.reach = tables["words"], tables["old"], tables["borders"], tables["reach"]
        self.lookahead = sufficient_lookahead(tables)
        self.special = tables["special"]
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        self.chunk = re.compile(r" ?[^ \n]+|\n")
        self.run = re.compile(r"\s\s")

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """Pieces that stand at one edge of a token while it is built, each with the rank at which it is consumed."""
        found, until = [], float("inf")
        while True:
            found.append((token, until))
            if token not in self.parts:
                return found
            until, token = self.ranks[self.parts[token]], self.parts[token][side]

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether no merge crosses the border of two tokens. Of equal merges the left one comes first."""
        key = self.ids[left] << 20 | self.ids[right]
        known = self.borders.get(key)
        if known is None:
            known = True
            for x, x_until in self._edge(left, 1):
                for y, y_until in self._edge(right, 0):
                    rank = self.ranks.get((x, y))
                    if rank is not None and rank < x_until and rank <= y_until:
                        known = False
            if len(self.borders) >= BORDERS:
                self.borders.clear()
            self.borders[key] = known
        return known

    def short(self, word: bytes) -> list[bytes]:
        """Tokens of a word that ends within the lookahead: the longest token that fits, back where none leads on.

        A chain of fitting tokens is the one encoding of its text, so a position that led nowhere never does.
        """
        ids, fits, n = self.ids, self.fits, len(word)
        path, dead, at, limit, reach = [], set(), 0, n, self.reach
        while at < n:
            # No token that begins with these two bytes is longer than their reach.
            for end in range(min(limit, at + reach.get(word[at : at + 2], 1)), at, -1):
                token = word[at:end]
                if token in ids and end not in dead and (not path or fits(path[-1], token)):
                    path.append(token)
                    at, limit = end, n
                    break
            else:
                if not path:
                    raise ValueError("the vocabulary lacks a byte")
                dead.add(at)
                limit = at - 1
                at -= len(path.pop())
        return path

    def stream(self, word: bytes) -> Iterator[bytes]:
        """Tokens of one word as soon as they are stable; keeps a few stretches of the lookahead, however long the word."""
        ids, fits, reach = self.ids, self.fits, self.lookahead
        base, last, start = 0, [None], [0]  # of the positions from base on: the last token and where it begins
        for i in range(1, len(word) + 1):
            for j in range(max(base, i - reach), i):
                token = word[j:i]
                if token in ids:
                    before = last[j - base]
                    if before is None or fits(before, token):
                        last.append(token)
                        start.append(j)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
            if i - base >= SETTLE + 2 * reach and i % SETTLE == 0:
                live = set(range(i - reach, i + 1))
                while len(live) > 1:
                    top = max(live)
                    live.remove(top)
                    live.add(max(base, start[top - base]))
                stable = live.pop()
                yield from self._chain(last, start, base, stable)
                last, start, base = last[stable - base :], start[stable - base :], stable
        yield from self._chain(last, start, base, len(word))

    @staticmethod
    def _chain(last: list, start: list, base: int, end: int) -> list[bytes]:
        found = []
        while end > base:
            found.append(last[end - base])
            end = start[end - base]
        return found[::-1]

    def _word(self, text: str) -> tuple[int, ...]:
        word = text.encode()
        whole = self.ids.get(word)
        if whole is not None:
            return (whole,)
        return tuple(map(self.ids.__getitem__, self.short(word) if len(word) <= SHORT else self.stream(word)))

    def _remember(self, chunk: str) -> tuple[tuple[int, ...], bytes]:
        known = self.old.get(chunk)
        if known is not None:
            self.words[chunk] = known
            return known
        bare = chunk[chunk[0] == " " :]
        if bare.isalpha():  # one word of the pattern
            ids = self._word(chunk)
        elif chunk[-1] in STOPS and bare[:-1].isalpha():  # a word, and a sign of its own
            stem = self.words.get(chunk[:-1]) or self._remember(chunk[:-1])
            ids = (*stem[0], self.ids[chunk[-1].encode()])
        else:
            ids = tuple(i for word in self.split.findall(chunk) for i in self._word(word))
        found = (ids, ",".join(map(str, ids)).encode())
        if len(chunk) <= 64:
            if len(self.words) >= WORDS:
                self.old.clear()
                self.old.update(self.words)
                self.words.clear()
            self.words[chunk] = found
        return found

    def pieces(self, text: str) -> list[tuple[tuple[int, ...], bytes]]:
        """Ids in order, in stretches, each with its decimal form."""
        found = []
        for k, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if k % 2:
                found.append(((self.special[part],), b"%d" % self.special[part]))
            elif part:
                # Without white space in a row or at an end, single spaces and line ends split a text as the pattern does.
                plain = not (part[0].isspace() or part[-1].isspace() or self.run.search(part))
                known, learn = self.words.get, self._remember
                found += [known(c) or learn(c) for c in (self.chunk if plain else self.split).findall(part)]
        return found

    def encode(self, text: str) -> list[int]:
        return [i for ids, _ in self.pieces(text) for i in ids]


class Decoder:
    """Ids to text, a few at a time: bytes that do not yet end a character wait, invalid ones become U+FFFD."""

    def __init__(self, tables: dict) -> None:
        self.raw = {i: token for token, i in tables["ids"].items()} | {i: text.encode() for text, i in tables["special"].items()}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], end: bool = False) -> str:
        return self.state.decode(b"".join(map(self.raw.__getitem__, ids)), end)

    def decode(self, ids: Iterable[int]) -> str:
        self.state.reset()
        return self.feed(ids, True)


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; ids with ``keep_ids``, decoded with ``keep_text``.

    ``path`` names a tokenizer file; the driver reads it and its tables (a few MB) are broadcast. Whole texts are encoded;
    special tokens in a text become their ids. A null text counts as empty and has no ids; bytes that are not UTF-8 are
    read as U+FFFD; repeated rows are kept; an empty table gives no rows; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    kinds |= {"ids": pa.list_(pa.int32())} if keep_ids else {}
    kinds |= {"decoded": pa.string()} if keep_text else {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        encoder, decoder = Encoder(tables), Decoder(tables)
        rows: dict[str, list] = {name: [] for name in kinds}
        held = 0

        def finished() -> pa.RecordBatch:
            nonlocal held
            done = pa.record_batch([pa.array(rows[name], kind) for name, kind in kinds.items()], names=list(kinds))
            for column in rows.values():
                column.clear()
            held = 0
            return done

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                pieces = encoder.pieces((text.as_py() or b"").decode("utf-8", "replace"))
                ids = [i for found, _ in pieces for i in found]
                again = decoder.decode(ids)
                rows["doc_id"].append(doc.as_py())
                rows["n_tokens"].append(len(ids))
                rows["ids_sha256"].append(hashlib.sha256(b",".join([code for _, code in pieces])).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(again.encode()).hexdigest())
                if keep_ids:
                    rows["ids"].append(pa.array(ids, pa.int32()).to_numpy())
                if keep_text:
                    rows["decoded"].append(again)
                held += len(ids) + 100
                if held >= HELD:
                    yield finished()
        if rows["doc_id"]:
            yield finished()

    names = {pa.int64(): "bigint", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, ", ".join(f"{name} {names[kind]}" for name, kind in kinds.items()))
