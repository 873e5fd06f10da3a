"""A gated recurrent language model with a class-factored softmax, scoring whole documents.

Word counts cover the whole training corpus. The most frequent words form classes with a softmax over the state inside;
every other word falls by its ending into a tail class, inside which counts give the probability, so the model covers an
open vocabulary and sums to one. The recurrent weights are fitted by truncated backpropagation in numpy: a short warm
start, then replicas on disjoint parts whose weights are averaged. Scoring runs many documents side by side in lanes and
carries the state from window to window.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from codelode.llm.common import cut_lineage

#: State size, words with a softmax (classes times words of a class), tail classes.
STATE, CLASSES, IN_CLASS, TAILS = 16, 32, 32, 96
#: Words whose counts every task holds (the most frequent, at most so many); the rest are joined.
HELD = 131_072
#: One of so many training documents fits the recurrent weights (1: all); tokens of the warm start and of a replica.
FIT, WARM, REPLICA = 1, 500_000, 2_000_000
#: Lanes and steps of a window, in training and in scoring; texts that are laid out in lanes together, in training and in scoring.
TRAIN, SCORE, TOGETHER, GROUP = (256, 16), (256, 32), 1_024, 8_192
#: Tokens of a piece of a text in training; in scoring the state goes through whole texts.
PIECE = 512
#: Positions whose class logits are in memory at once, about a core's cache.
ROWS = 512
#: Bytes of the texts whose words are told apart together.
SLICE = 1 << 22
#: Distinct words that a task counts before it hands its counts on.
COUNTED = 400_000
#: The end of a text, which no word can equal.
END = b" "
RATE = 0.15


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words(text: bytes | None) -> list[bytes]:
    """Words in lower case (A-Z only) and one end."""
    found = (text or b"").lower().split()
    found.append(END)
    return found


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAILS


def tails_of(text: pa.Array) -> np.ndarray:
    """``tail_of`` of all words, by their distinct endings."""
    ends = pc.binary_slice(text, -3).dictionary_encode()
    return np.array([tail_of(e) for e in ends.dictionary.to_pylist()], np.int64)[ends.indices.to_numpy(zero_copy_only=False)]


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """Texts in stretches of about SLICE bytes; no text is cut."""
    stretch = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
    cuts = [0, *(np.flatnonzero(stretch[1:] != stretch[:-1]) + 1).tolist(), len(column)]
    for begin, stop in zip(cuts, cuts[1:], strict=False):
        yield column.slice(begin, stop - begin)


def tokens(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``words`` of all texts: the distinct ones (some may not occur), the place among them of each token, tokens of each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.view(pa.string()), "")))
    coded = parts.flatten().view(pa.binary()).dictionary_encode()
    names, codes, stops = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), parts.offsets.to_numpy()[1:]
    # White space at either side of a text gives an empty part.
    empty = pc.index(names, pa.scalar(b"", names.type)).as_py()
    if empty >= 0:
        real = codes != empty
        stops = np.concatenate([[0], np.cumsum(real)])[stops]
        codes = codes[real]
    codes = np.insert(codes, stops, len(names))
    return pa.concat_arrays([names, pa.array([END], names.type)]), codes, np.diff(stops, prepend=0) + 1


def count_words(slim: DataFrame) -> DataFrame:
    """(word, tail, c) of all texts; ends count as words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, least = [], COUNTED

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")])

        def rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
            names = table.column("word").combine_chunks()
            yield pa.record_batch([names, pa.array(tails_of(names), pa.int32()), table.column("c_sum").combine_chunks()], names=["word", "tail", "c"])

        for batch in batches:
            for texts in slices(batch.column("text")):
                names, codes, _ = tokens(texts)
                times = np.bincount(codes, minlength=len(names))
                found = np.flatnonzero(times)
                held.append(pa.table({"word": names.take(pa.array(found)), "c": times[found]}))
                if sum(map(len, held)) >= least:
                    table = merged()
                    held, least = [table.rename_columns({"c_sum": "c"}).select(["word", "c"])], len(table) + COUNTED
                    if len(table) >= COUNTED:
                        yield from rows(table)
                        held, least = [], COUNTED
        if held:
            yield from rows(merged())

    return slim.select("text").mapInArrow(run, "word binary, tail int, c bigint").groupBy("word", "tail").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> dict:
    """What tasks need of the counts: the held words with their places, and the sums of the tail classes."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # Counts in steps of a sixteenth of their binary logarithm: the steps from the top that fit into HELD words.
    step = F.floor(F.log2("c") * 16)
    steps, room, least = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True), HELD, None
    for at, n in steps:
        if n > room:
            break
        room, least = room - n, at
    held = sorted(counts.where(step >= least).collect(), key=lambda r: (-r["c"], r["word"])) if least is not None else []
    tails = np.zeros((TAILS, 2), np.int64)
    for tail, n, v in counts.groupBy("tail").agg(F.sum("c"), F.count(F.lit(1))).collect():
        tails[tail] = n, v
    head = held[: CLASSES * IN_CLASS]
    for r in head:
        tails[r["tail"]] -= r["c"], 1
    names = {bytes(r["word"]): i for i, r in enumerate(held)}
    c = np.array([r["c"] for r in held], np.int64)
    place = np.arange(len(held))
    soft = place < len(head)
    output = np.where(soft, place // IN_CLASS, CLASSES + np.array([r["tail"] for r in held], np.int64))
    return {
        "names": names, "held": pa.array(list(names), pa.binary()), "c": c, "total": int(total), "distinct": int(distinct), "tails": tails,
        "input": np.where(soft, place, CLASSES * IN_CLASS + output - CLASSES), "output": output, "inside": np.where(soft, place % IN_CLASS, -1),
    }


def first_weights(vocab: dict) -> dict[str, np.ndarray]:
    """Weights that give each word its share of the counts, whatever the state."""
    draw = np.random.default_rng(7)
    outputs, inputs = CLASSES + TAILS, CLASSES * IN_CLASS + TAILS
    mass = np.zeros(outputs)
    inside = np.full((CLASSES, IN_CLASS), -30.0)
    n = min(len(vocab["c"]), CLASSES * IN_CLASS)
    head = vocab["c"][:n].astype(float)
    np.add.at(mass, vocab["output"][:n], head)
    mass[CLASSES:] = vocab["tails"].sum(1) + 1
    inside.reshape(-1)[:n] = np.log(head)
    mass[:CLASSES] = np.where(mass[:CLASSES] > 0, mass[:CLASSES], 1e-9)
    small = lambda *shape: draw.normal(0, 0.1, shape)
    weights = {"x": small(inputs, 3 * STATE), "u": small(STATE, 3 * STATE), "o": small(STATE, outputs) * 0.1, "ob": np.log(mass / mass.sum()), "i": small(CLASSES, IN_CLASS, STATE) * 0.1, "ib": inside}
    return {k: v.astype(np.float32) for k, v in weights.items()}


def places(vocab: dict, text: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place among the held words or -1, input row, output class, place in the class or -1) of each token."""
    return _places(vocab, pa.array(text, pa.binary()))


def _places(vocab: dict, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at = pc.fill_null(pc.index_in(text, value_set=vocab["held"]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(vocab["c"]):
        inp, out, ins = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64), np.full(len(text), -1)
    else:
        inp, out, ins = vocab["input"][at], vocab["output"][at], vocab["inside"][at]
    new = np.flatnonzero(at < 0)
    if len(new):
        tail = tails_of(text.take(pa.array(new)))
        inp[new], out[new], ins[new] = CLASSES * IN_CLASS + tail, CLASSES + tail, -1
    return at, inp, out, ins


def encoded(vocab: dict, column: pa.Array) -> Iterator[tuple]:
    """By slice: the distinct words, their places, and of each token its word, of each text where it begins and its three arrays for ``lanes``."""
    for some in slices(column):
        names, codes, lengths = tokens(some)
        at, *rest = _places(vocab, names)
        starts = np.cumsum(lengths) - lengths
        texts = zip(*(np.split(each.astype(np.int32)[codes], starts[1:]) for each in rest), strict=True)
        yield names, (at, *rest), codes, starts, list(texts) if len(some) else []


def pieces(texts: list, most: int, first: int) -> tuple[list, list[int]]:
    """Texts in pieces of at most ``most`` tokens, and the input at the beginning of each."""
    found, heads = [], []
    for a, b, c in texts:
        for at in range(0, len(a), most):
            found.append((a[at : at + most], b[at : at + most], c[at : at + most]))
            heads.append(int(a[at - 1]) if at else first)
    return found, heads


def lanes(texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int, first: int, heads: list[int] | None = None):
    """Texts laid end to end in lanes of near-equal length, longest lane first: inputs, outputs, inside, owner, starts.

    A text's first input is ``first``, or what ``heads`` says."""
    width = min(width, len(texts))
    heap, dealt = [(0, i) for i in range(width)], [[] for _ in range(width)]
    for k in sorted(range(len(texts)), key=lambda k: -len(texts[k][0])):
        load, lane = heapq.heappop(heap)
        dealt[lane].append(k)
        heapq.heappush(heap, (load + len(texts[k][0]), lane))
    loads = [sum(len(texts[k][0]) for k in lane) for lane in dealt]
    order = sorted(range(width), key=lambda i: -loads[i])
    shape = (max(loads), width)
    inp, out, ins, owner = np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.full(shape, -1, np.int32), np.full(shape, -1, np.int32)
    starts = np.zeros(shape, bool)
    for column, lane in enumerate(order):
        at = 0
        for k in dealt[lane]:
            a, b, c = texts[k]
            stop = at + len(a)
            inp[at, column], inp[at + 1 : stop, column] = heads[k] if heads else first, a[:-1]
            out[at:stop, column], ins[at:stop, column], owner[at:stop, column] = b, c, k
            starts[at, column] = True
            at = stop
    return inp, out, ins, owner, starts, np.array([loads[i] for i in order])


class Rooms:
    """Arrays that serve again in every window: fresh ones of their size cost more in page faults than what is done in them."""

    def __init__(self) -> None:
        self.kept: dict = {}

    def __call__(self, name: str, shape: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
        size, have = int(np.prod(shape)), self.kept.get((name, dtype))
        if have is None or len(have) < size:
            have = self.kept[name, dtype] = np.empty(size, dtype)
        return have[:size].reshape(shape)


def _with_bias(weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, bool]:
    """Weights with the bias as a last row, and whether exponentials of all logits of states (-1 to 1) stay in range."""
    reach = np.abs(weights).sum(-2)
    tame = bool((bias + reach).max() < 60 and (bias - reach).max(-1).min() > -60)
    return np.concatenate([weights, bias[..., None, :]], -2), tame


def prepared(w: dict) -> dict:
    """Weights as a window uses them: the gates' logistic function is 1 / (1 + exp(-x)), so theirs change sign here."""
    sign = np.repeat(np.array([-1, -1, 1], w["x"].dtype), STATE)
    return {"u": np.ascontiguousarray((w["u"] * sign).T), "x": w["x"] * sign, "o": _with_bias(w["o"], w["ob"]), "i": _with_bias(w["i"].transpose(0, 2, 1), w["ib"])}


def forward(w: dict, inp: np.ndarray, starts: np.ndarray, state: np.ndarray, rooms: Rooms | None = None, ready: dict | None = None, keep: bool = False):
    """States of a window, the state behind it, and with ``keep`` what the way back needs; the first and the last live in ``rooms``.

    Inside, a step is an array of features by lanes, so that gates are whole rows of it.
    """
    rooms, kind = rooms or Rooms(), w["x"].dtype
    steps, width = inp.shape
    ready = ready or prepared(w)
    u, x, kept = ready["u"], ready["x"], steps if keep else 1
    gates = rooms("gates", (kept, 3 * STATE, width), kind)
    before, across = rooms("before", (kept, STATE, width), kind), rooms("across", (kept, 3 * STATE, width), kind)
    rows, some, after = rooms("rows of a step", (width, 3 * STATE), kind), rooms("some", (STATE, width), kind), np.array(state.T, kind, order="C")
    states, inp, goes_on = rooms("states", (steps, width, STATE), kind), inp.astype(np.intp), (~starts).astype(kind)
    with np.errstate(over="ignore"):
        for t in range(steps):
            at = t if keep else 0
            all_gates, was, by = gates[at], before[at], across[at]
            both, new = all_gates[: 2 * STATE], all_gates[2 * STATE :]
            x.take(inp[t], axis=0, out=rows, mode="clip")
            np.multiply(after, goes_on[t], out=was)
            np.matmul(u, was, out=by)
            np.add(rows.T[: 2 * STATE], by[: 2 * STATE], out=both)
            np.exp(both, out=both)
            both += 1
            np.divide(1, both, out=both)
            np.multiply(both[STATE:], by[2 * STATE :], out=new)
            new += rows.T[2 * STATE :]
            np.tanh(new, out=new)
            np.subtract(was, new, out=some)
            some *= both[:STATE]
            np.add(new, some, out=after)
            states[t] = after.T
    return states, after.T.copy(), (before, gates, across[:, 2 * STATE :])


def _of(values: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Values of the real positions, which are often all."""
    return values if len(real) == len(values) else values.take(real, axis=0)


def _with_one(states: np.ndarray, name: str, rooms: Rooms) -> np.ndarray:
    found = rooms(name, (len(states), STATE + 1), states.dtype)
    found[:, :STATE], found[:, STATE] = states, 1
    return found


def _exponentials(logits: np.ndarray, tame: bool) -> tuple[np.ndarray, np.ndarray | int]:
    """Logits become their exponentials, by rows less the greatest where they could leave the range: sums, and what was taken off."""
    top = 0
    if not tame:
        top = logits.max(1)
        logits -= top[:, None]
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype), top


def _by_class(of: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Positions (all, or those ``at``) in the order of their classes, the classes, and where each begins and ends."""
    key = (of if at is None else of[at]).astype(np.min_scalar_type(CLASSES * IN_CLASS + TAILS))  # small numbers sort faster
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    spans = list(zip(begin.tolist(), [*begin[1:].tolist(), len(key)], strict=False))
    return order if at is None else at[order], key[begin].astype(np.int64), spans


def _inside(ready: dict, h: np.ndarray, classes: np.ndarray, spans: list[tuple[int, int]], rooms: Rooms) -> tuple[np.ndarray, bool]:
    """Logits of the words inside the classes, of states with a one that are sorted by class."""
    weights, tame = ready["i"]
    logits = rooms("inside", (len(h), IN_CLASS), h.dtype)
    for k, (start, end) in zip(classes, spans, strict=True):
        np.matmul(h[start:end], weights[k], out=logits[start:end])
    return logits, tame


def log_probabilities(w: dict, states: np.ndarray, out: np.ndarray, ins: np.ndarray, rooms: Rooms | None = None, ready: dict | None = None) -> np.ndarray:
    """Natural log probability of the classes, and of the words inside the classes that have a softmax."""
    rooms, states = rooms or Rooms(), states.astype(w["o"].dtype, copy=False)
    ready = ready or prepared(w)
    found, (weights, tame) = np.empty(len(out), states.dtype), ready["o"]
    for at in range(0, len(out), ROWS):
        part = slice(at, at + ROWS)
        h = _with_one(states[part], "some states", rooms)
        logits = np.matmul(h, weights, out=rooms("logits", (len(h), weights.shape[1]), h.dtype))
        own = logits[np.arange(len(h)), out[part]]
        sums, top = _exponentials(logits, tame)
        found[part] = own - top - np.log(sums)
    at, classes, spans = _by_class(out, np.flatnonzero(ins >= 0))
    logits, tame = _inside(ready, _with_one(states.take(at, axis=0), "inner states", rooms), classes, spans, rooms)
    own = logits[np.arange(len(at)), ins[at]]
    sums, top = _exponentials(logits, tame)
    found[at] += own - top - np.log(sums)
    return found


def score_texts(w: dict, texts: list, first: int, rooms: Rooms | None = None) -> np.ndarray:
    """Natural log probability of each text without what counts give inside the tail classes."""
    total = np.zeros(len(texts))
    if not texts:
        return total
    width, steps = SCORE
    inp, out, ins, owner, starts, loads = lanes(texts, width, first)
    rooms, ready, state = rooms or Rooms(), prepared(w), np.zeros((inp.shape[1], STATE), np.float32)
    for at in range(0, len(inp), steps):
        live = int((loads > at).sum())  # lanes end one after the other
        part = np.s_[at : at + steps, :live]
        states, state, _ = forward(w, inp[part], starts[part], state[:live], rooms, ready)
        own = owner[part].ravel()
        real = np.flatnonzero(own >= 0)
        found = log_probabilities(w, *(_of(all_of, real) for all_of in (states.reshape(-1, STATE), out[part].ravel(), ins[part].ravel())), rooms, ready)
        total += np.bincount(_of(own, real), found, len(total))
    return total


def _step(w: dict, speed: dict, name: str, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
    """Adagrad, of some rows or all."""
    at = slice(None) if rows is None else rows
    speed[name][at] += grad * grad
    w[name][at] -= RATE * grad / np.sqrt(speed[name][at])


def _outer_loss(w: dict, ready: dict, h: np.ndarray, o: np.ndarray, scale: np.float32, rooms: Rooms):
    """Gradients of the classes: towards the states, and of their weights."""
    weights, tame = ready["o"]
    back = np.ascontiguousarray(w["o"].T)
    into, do, dob = rooms("into", h.shape, h.dtype), np.zeros_like(back), np.zeros_like(w["ob"])
    for at in range(0, len(o), ROWS):
        mine = h[at : at + ROWS]
        p = np.matmul(_with_one(mine, "some states", rooms), weights, out=rooms("logits", (len(mine), weights.shape[1]), h.dtype))
        sums, _ = _exponentials(p, tame)
        # Rows stay unscaled: their share is taken from the states and from what goes into them.
        p[np.arange(len(mine)), o[at : at + ROWS]] -= sums
        share = scale / sums
        np.matmul(p, back, out=into[at : at + ROWS])
        into[at : at + ROWS] *= share[:, None]
        do += p.T @ (mine * share[:, None])
        dob += share @ p
    return into, do.T, dob


def _inner_loss(w: dict, ready: dict, states: np.ndarray, of: np.ndarray, ins: np.ndarray, scale: np.float32, rooms: Rooms):
    """Gradients of the words inside their classes: their positions, what goes towards the states there, and by class the rows of its weights.

    Positions are sorted by class, so that each class is three matrix products.
    """
    at, classes, spans = _by_class(of, np.flatnonzero(ins >= 0))
    h = states.take(at, axis=0, out=rooms("inner h", (len(at), STATE), states.dtype), mode="clip")
    p, tame = _inside(ready, _with_one(h, "inner states", rooms), classes, spans, rooms)
    sums, _ = _exponentials(p, tame)
    p[np.arange(len(h)), ins[at]] -= sums
    share = scale / sums
    h *= share[:, None]
    into, di, dib = rooms("inner into", h.shape, h.dtype), np.empty((len(classes), IN_CLASS, STATE), h.dtype), np.empty((len(classes), IN_CLASS), h.dtype)
    for j, (k, (start, end)) in enumerate(zip(classes, spans, strict=True)):
        mine = p[start:end]
        np.matmul(mine, w["i"][k], out=into[start:end])
        np.matmul(mine.T, h[start:end], out=di[j])
        np.matmul(share[start:end], mine, out=dib[j])
    into *= share[:, None]
    return at, into, classes, di, dib


def gradients(w: dict, x: np.ndarray, first_of: np.ndarray, o: np.ndarray, ins: np.ndarray, real: np.ndarray, state: np.ndarray, rooms: Rooms | None = None):
    """One window: gradients by weight as (rows or None, values), and the state behind it.

    ``o`` and ``ins`` belong to the ``real`` positions. The gradient stops at the window's beginning.
    """
    rooms, ready, kind = rooms or Rooms(), prepared(w), w["x"].dtype
    steps, width = x.shape
    states, after, (before, gates, inner) = forward(w, x, first_of, state, rooms, ready, True)
    h = _of(states.reshape(-1, STATE), real)
    scale = kind.type(1 / np.sqrt(max(1, len(real))))
    into, do, dob = _outer_loss(w, ready, h, o, scale, rooms)
    at, back, classes, di, dib = _inner_loss(w, ready, h, o, ins, scale, rooms)
    into[at] += back
    if len(real) < x.size:
        flat = np.zeros((x.size, STATE), kind)
        flat[real] = into
        into = flat
    # What a step hands to its gates, but for the factor that comes back through the steps behind it.
    z, r, new = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :]
    by_new, by_z, by_r = (rooms(name, (steps, STATE, width), kind) for name in ("by new", "by z", "by r"))
    some = rooms("some steps", (steps, STATE, width), kind)
    np.subtract(1, z, out=some)
    np.subtract(before, new, out=by_z)
    by_z *= z
    by_z *= some
    np.multiply(new, new, out=by_new)
    np.subtract(1, by_new, out=by_new)
    by_new *= some
    np.subtract(1, r, out=by_r)
    by_r *= r
    by_r *= inner
    d = rooms("d", (steps, STATE, width), kind)
    d[...] = into.reshape(steps, width, STATE).transpose(0, 2, 1)
    dx, across = rooms("dx", (steps, 3 * STATE, width), kind), rooms("d across", (steps, 3 * STATE, width), kind)
    goes_on, carried = (~first_of).astype(kind), np.zeros((STATE, width), kind)
    for t in range(steps - 1, -1, -1):
        carried += d[t]
        dn = np.multiply(carried, by_new[t], out=dx[t, 2 * STATE :])
        np.multiply(carried, by_z[t], out=dx[t, :STATE])
        np.multiply(dn, by_r[t], out=dx[t, STATE : 2 * STATE])
        across[t, : 2 * STATE] = dx[t, : 2 * STATE]
        np.multiply(dn, r[t], out=across[t, 2 * STATE :])
        carried *= z[t]
        carried += w["u"] @ across[t]
        carried *= goes_on[t]
    du = (before @ across.transpose(0, 2, 1)).sum(0)
    # Rows of the input weights are summed IN_CLASS at a time, as products with a one where a position's row is.
    order, blocks, spans = _by_class(x.ravel() // IN_CLASS)
    by_row = rooms("by row", (x.size, 3 * STATE), kind)
    by_row.reshape(steps, width, 3 * STATE)[...] = dx.transpose(0, 2, 1)
    by_row = by_row.take(order, axis=0, out=rooms("sorted rows", by_row.shape, kind), mode="clip")
    hot = rooms("hot", (x.size, IN_CLASS), kind)
    hot[...] = 0
    hot[np.arange(x.size), x.ravel()[order] % IN_CLASS] = 1
    gx = np.zeros((-(-len(w["x"]) // IN_CLASS) * IN_CLASS, 3 * STATE), kind)
    for k, (start, end) in zip(blocks.tolist(), spans, strict=True):
        np.matmul(hot[start:end].T, by_row[start:end], out=gx[k * IN_CLASS : (k + 1) * IN_CLASS])
    return {"o": (None, do), "ob": (None, dob), "i": (classes, di), "ib": (classes, dib), "u": (None, du), "x": (None, gx[: len(w["x"])])}, after


def train(w: dict, batches: Iterable[list], first: int) -> dict:
    """One pass of truncated backpropagation over texts; the gradient stops at a window, the state goes on."""
    w = {k: v.copy() for k, v in w.items()}
    speed = {k: np.full_like(v, 1e-3) for k, v in w.items()}
    rooms, (width, steps) = Rooms(), TRAIN
    for texts in batches:
        if not texts:
            continue
        # A long text is learned in pieces, so that no lane is left alone at the end of the windows.
        parts, heads = pieces(texts, PIECE, first)
        inp, out, ins, owner, starts, loads = lanes(parts, width, first, heads)
        state = np.zeros((inp.shape[1], STATE), np.float32)
        for begin in range(0, len(inp), steps):
            live = int((loads > begin).sum())
            part = np.s_[begin : begin + steps, :live]
            real = np.flatnonzero(owner[part].ravel() >= 0)
            found, state = gradients(w, inp[part], starts[part], _of(out[part].ravel(), real), _of(ins[part].ravel(), real), real, state[:live], rooms)
            for name, (rows, grad) in found.items():
                _step(w, speed, name, np.clip(grad, -5, 5), rows)
    return w


def _flat(w: dict) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    found, at = {}, 0
    for k in sorted(like):
        found[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return found


def _fit_round(slim: DataFrame, shared, weights: dict, replicas: int) -> dict:
    """Replicas on disjoint parts of the texts, from the same weights; the mean of what they learn, by their tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, seen = shared.value, [0]
        first = int(places(vocab, [END])[1][0])

        def texts() -> Iterator[list]:
            for batch in batches:
                column = batch.column("text")
                for at in range(0, len(column), TOGETHER):
                    found = [text for *_, texts in encoded(vocab, column[at : at + TOGETHER]) for text in texts]
                    seen[0] += sum(len(t[0]) for t in found)
                    yield found

        flat = _flat(train(weights, texts(), first))
        if seen[0]:
            at = np.arange(0, len(flat), 4096)
            parts = [flat[a : a + 4096].astype(np.float64) * seen[0] for a in at]
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(parts, pa.list_(pa.float64())), pa.array(np.full(len(at), float(seen[0])))], names=["at", "part", "n"])

    # One replica a task: its number is the partition's.
    one = slim.select("text", F.pmod(_draw(3), F.lit(replicas)).cast("int").alias("replica")).repartitionById(replicas, "replica").select("text")
    learned = one.mapInArrow(run, "at bigint, part array<double>, n double")
    each = learned.select("at", "n", F.posexplode("part").alias("k", "v")).groupBy("at", "k").agg((F.sum("v") / F.sum("n")).alias("v"))
    rows = each.toPandas()  # as many as weights
    if not len(rows):
        return weights
    flat = np.empty(len(_flat(weights)))
    flat[rows["at"].to_numpy() + rows["k"].to_numpy()] = rows["v"].to_numpy()
    return _shaped(flat, weights)


def _draw(seed: int) -> Column:
    """A hash of the document; rows without an id differ by their texts."""
    return F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")), F.lit(seed))


def fit(training: DataFrame, vocab: dict, shared) -> dict:
    """Weights from all training texts: a warm start on a bounded part, then averaged replicas on the rest."""
    weights = first_weights(vocab)
    tokens = vocab["total"] / FIT
    if not tokens:
        return weights
    place = F.pmod(_draw(5), F.lit(1 << 20)) / float(1 << 20)
    edge = min(0.5, WARM / tokens) / FIT
    weights = _fit_round(training.where(place < edge), shared, weights, 1)
    rest = training.where((place >= edge) & (place < 1 / FIT))
    return _fit_round(rest, shared, weights, max(1, round(tokens / REPLICA)))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Training texts are those whose crc32(doc_id) mod 7 is not 2; rows without an id train too. Counts cover all of
    them, and the recurrent weights are fitted on all of them in one pass. Every text is scored whole; a null or empty text
    is one end. Repeated rows are scored each; without training texts all words are unknown. An empty table gives no rows;
    other columns are not looked at.
    """
    context = docs.sparkSession.sparkContext
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    training = slim.where(~held_out(F.col("doc_id")))
    counts = cut_lineage(count_words(training))
    vocab = vocabulary(counts)
    shared = context.broadcast(vocab)
    weights = context.broadcast(fit(training, vocab, shared))
    base_rest = float(np.log10(vocab["total"] + vocab["distinct"] + 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, w, task, row = shared.value, weights.value, TaskContext.get().partitionId(), 0
        first = int(places(vocab, [END])[1][0])
        tail_rest = np.log10(vocab["tails"].sum(1) + 1)
        log_c, rooms = np.log10(vocab["c"] + 1), Rooms()
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for begin in range(0, len(ids), GROUP):
                some = ids[begin : begin + GROUP]
                texts, sums, new = [], [], []
                for names, (at, _, out, ins), codes, starts, found in encoded(vocab, column[begin : begin + GROUP]):
                    here, tail = at >= 0, ins < 0
                    held = np.where(here, log_c[at], 0.0) if len(log_c) else np.zeros(len(at))
                    lengths = np.diff(starts, append=len(codes))
                    known = np.add.reduceat(here.astype(np.int64)[codes], starts)
                    base = np.add.reduceat(held[codes], starts) - lengths * base_rest
                    score = np.add.reduceat(np.where(tail, held - tail_rest[np.where(tail, out - CLASSES, 0)], 0.0)[codes], starts)
                    sums.append((lengths, known, base, score))
                    # Words that only the join knows: once for each text, with their number.
                    unheld = np.flatnonzero(~here[codes])
                    owner = np.searchsorted(starts, unheld, side="right") - 1
                    pairs, times = np.unique(owner * len(names) + codes[unheld], return_counts=True)
                    new.append((pairs // len(names) + len(texts), names.take(pairs % len(names)), times))
                    texts += found
                n_tokens, known, base, score = (np.concatenate(part) for part in zip(*sums, strict=True))
                owner, times = (np.concatenate([part[i] for part in new]) for i in (0, 2))
                logs = score + score_texts(w, texts, first, rooms) / np.log(10)
                rows = np.arange(row, row + len(some))
                # A document's own row has a key of its own that equals no word, so that it meets no count.
                none = np.zeros(len(owner), np.int64)
                keys = pa.array([b" %d %d" % (task, r) for r in rows], pa.binary())
                yield pa.record_batch(
                    [
                        pa.concat_arrays([some, some.take(owner)]),
                        pa.array(np.full(len(some) + len(owner), task, np.int32)),
                        pa.array(np.concatenate([rows, rows[owner]])),
                        pa.concat_arrays([keys, *[part[1] for part in new]]),
                        pa.array(np.concatenate([n_tokens, none])),
                        pa.array(np.concatenate([known, none])),
                        pa.array(np.concatenate([base, none.astype(float)])),
                        pa.array(np.concatenate([logs, none.astype(float)])),
                        pa.array(np.concatenate([np.zeros(len(some), np.int64), times])),
                    ],
                    names=["doc_id", "task", "row", "word", "tokens", "known", "base", "score", "times"],
                )
                row += len(some)

    parts = slim.mapInArrow(run, "doc_id bigint, task int, row bigint, word binary, tokens bigint, known bigint, base double, score double, times bigint")
    joined = parts.join(counts.select("word", "c"), "word", "left")
    more = F.col("times") * F.coalesce(F.log10(F.col("c") + 1), F.lit(0.0))
    summed = joined.groupBy("doc_id", "task", "row").agg(
        F.sum("tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + more).alias("base_score"),
        F.sum(F.col("score") + more).alias("score"),
    )
    return summed.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(vocab["total"]).cast("bigint").alias("train_tokens"), "base_score", "score")
