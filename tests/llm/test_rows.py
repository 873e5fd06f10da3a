"""Top-k, sharding, mixing, BPE, HTML, toxicity and language model against brute force or held-out rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import SF, documents, odd_rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codelode.llm import bpe, html, lm, mixing, queries, sharding, topk, toxicity


def brute_top(rows, k=20, every=20):
    fine = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in fine if i % every == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fine if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("large", [1.0, 1e7])
def test_top_k(spark, large, monkeypatch):
    for name, size in (("QUERIES", 4), ("SHARD", 16), ("FAN_IN", 2)):
        monkeypatch.setattr(topk, name, size)
    draw = np.random.default_rng(4)
    rows = [(i, (draw.integers(-3, 4, 5) * large / 4).tolist()) for i in range(150)]  # many ties
    rows += [(160, None), (180, [float("nan")] * 5), (200, [None] * 5), (None, [1.0] * 5), (220, [1.0]), (221, [0.5]), (240, [])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score string")
    assert sorted(map(tuple, topk.top_k(table).collect())) == brute_top(rows)
    assert topk.top_k(table.limit(0)).collect() == []


def check_shards(rows, found, shards):
    assert len(found) == len(rows)
    size = {}
    for r in found:
        size.setdefault(r["shard"], []).append(r)
    for s, mine in size.items():
        assert 0 <= s < shards and sorted(r["slot"] for r in mine) == list(range(len(mine)))
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "bytes", None) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in found) == want
    home = {}
    for r in found:
        assert home.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]
    loads = [sum(r["size"] for r in size.get(s, [])) for s in range(shards)]
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 16
    assert max(loads) <= sum(loads) / shards + max(groups.values(), default=0)


def test_sharding(spark):
    rows = odd_rows()
    check_shards([r[:2] for r in rows], sharding.shard(documents(spark, rows), 5).collect(), 5)
    assert sharding.shard(documents(spark, [])).collect() == []
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_shards(docs, queries.op8_sharding(spark, SF).collect(), 40)


def test_schedule_is_longest_first():
    assert sharding.schedule([(5, "a"), (4, "b"), (3, "c"), (3, "d"), (3, "e")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def brute_targets(sizes: dict, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over


def check_mix(rows, found):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, longest = Counter(), Counter()
    for d, t, s in rows:
        sizes[s] += count(t)
    same = Counter()
    for d, t, s in rows:
        same[s, d] += count(t)
    for (s, _), n in same.items():
        longest[s] = max(longest[s], n)
    targets = brute_targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((d, count(t)) for d, t, _ in rows)
    taken = Counter()
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 1e-6 or taken[s] == 3 * sizes[s], (s, taken[s], t)


@pytest.mark.parametrize("bound", [0, 1 << 22])
def test_mixing(spark, bound, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", bound)  # joined by shuffle and by broadcast
    rows = odd_rows()
    docs = documents(spark, rows)
    found = mixing.mix(docs).collect()
    check_mix(rows, found)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs).collect()))
    times = Counter(r["doc_id"] for r in mixing.take_mix(docs).collect())
    want = Counter()
    for r in found:
        want[r["doc_id"]] += r["copies"]
    assert times == +want and mixing.take_mix(docs).columns == docs.columns
    assert mixing.mix(documents(spark, [])).collect() == []


def test_mixing_sources_that_stop(spark):
    rows = [(i, "a b c", "tiny") for i in range(2)] + [(10 + i, "w " * (i + 1), "vast") for i in range(60)] + [(100, "", "void"), (101, "x y", None)]
    check_mix(rows, mixing.mix(documents(spark, rows)).collect())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


@pytest.fixture(scope="module")
def tables():
    return bpe.load(queries.tokenizer_file())


TEXTS = ["", " ", "  ", "a  b", " a", "a ", "a\n\nb", "a \n b", "x\ty", "don't we'LL 'S", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "Ünïcödé ßñ ção", "日本語テキスト", "🙂🙃 👩‍👩‍👧", "  x\x1cy\x85z", "1234567 ½ ²", "a" * 3000, "ab" * 4000, " " * 700 + "x", "\n" * 300, "é" * 2000, "aaaa " * 50, "_" * 900, "é̀", "\x00\x01�"]


@pytest.mark.parametrize("text", TEXTS)
def test_bpe_equals_the_library(library, tables, text):
    ids = bpe.Encoder(tables).encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert bpe.Decoder(tables).decode(ids) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text("ab \n't", max_size=60) | st.text("theinonrat ,.", max_size=200))
def test_bpe_on_random_texts(text):
    tables = test_bpe_on_random_texts.tables = getattr(test_bpe_on_random_texts, "tables", None) or (bpe.load(queries.tokenizer_file()), Tokenizer.from_file(queries.tokenizer_file()))
    assert bpe.Encoder(tables[0]).encode(text) == tables[1].encode(text, add_special_tokens=False).ids


def test_decoder_waits_for_whole_characters(tables):
    decoder, ids = bpe.Decoder(tables), bpe.Encoder(tables).encode("🙂 é")
    assert "".join(decoder.feed([i]) for i in ids) + decoder.feed([], True) == "🙂 é"
    assert decoder.decode(ids[:1]) == "�"


def test_bpe_rows(spark, library):
    rows = odd_rows()
    found = bpe.encode_documents(documents(spark, rows), queries.tokenizer_file(), keep_ids=True).collect()
    want = Counter()
    for d, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:4] for r in found) == want and all(len(r["ids"]) == r["n_tokens"] for r in found)
    assert bpe.encode_documents(documents(spark, []), queries.tokenizer_file()).collect() == []


def test_bpe_query(spark, library):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op9_bpe(spark, SF).collect():
        ids = library.encode(texts[r[0]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r[0]].encode()).hexdigest()


LONG = "This sentence, which is long enough to count, says little, but it says so with commas. " * 4
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class="cookie-notice"><p>{LONG}</p></div>
<div id=main-column><article><h1>Head &amp; line</h1><p><b>First&nbsp;block<br>of   text<p>{LONG}
<ul><li>one<li>two</ul><blockquote>said</blockquote><aside><p>{LONG}</p></aside><form><p>{LONG}</p></form></article>
<section class="comments"><p>{LONG}</p></section></div><div class=sidebar><p>{LONG}</p></div><footer>&copy; x</footer>"""


def test_main_text():
    assert html.main_text(PAGE).split("\n\n") == ["Head & line", "First block of text", LONG.strip(), "one", "two", "said"]
    plain = f"<body><div class=top><a href=a>a</a> <a href=b>b</a></div><div class=post-body><p>{LONG}</p><p>{LONG}</p>Loose text.</div><div><p>Related: <a href=c>{LONG}</a></div>"
    assert html.main_text(plain).split("\n\n") == [LONG.strip(), LONG.strip(), "Loose text."]
    for empty in ("", "   ", "<", "<html></html>", "<script>x</script>", "<nav><a>x</a></nav>"):
        assert html.main_text(empty).strip("<") == ""
    assert html.main_text("just words, no markup") == "just words, no markup"
    assert html.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_long_articles_stay_whole():
    many = f"<p>{LONG}</p>" * 40
    whole = lambda page: html.main_text(page).split("\n\n")
    nested = whole(f"<body><article><h1>Head</h1><p>Lead</p><div class=content>{many}</div><p>End</p></article><div class=sidebar><p>{LONG}</p></div>")
    assert nested == ["Head", "Lead", *[LONG.strip()] * 40, "End"]
    listed = whole(f"<body><main><h2>Head</h2><p>Before</p><ul>{f'<li>{LONG}</li>' * 60}</ul><p>After</p></main>")
    assert listed == ["Head", "Before", *[LONG.strip()] * 60, "After"]
    sectioned = whole(f"<body><article><section><h2>One</h2>{many}</section><section><h2>Two</h2><p>Short.</p></section></article>")
    assert sectioned == ["One", *[LONG.strip()] * 40, "Two", "Short."]
    inner = whole(f"<body><main><h1>Head</h1><article><p>Lead</p><article>{many}</article></article><p>End</p></main>")
    assert inner == ["Head", "Lead", *[LONG.strip()] * 40, "End"]


def test_text_beside_the_best_container():
    many = f"<p>{LONG}</p>" * 40
    page = f"<body><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul><h1>Head</h1><p>Lead</p><div class=content>{many}</div><ol><li>one<li>two</ol><p>End</p><p><a href=/c>Read on</a></p><aside><p>{LONG}</p></aside>"
    assert html.main_text(page).split("\n\n") == ["Head", "Lead", *[LONG.strip()] * 40, "one", "two", "End"]
    page = f"<body><section>{many}</section><section><p>Short.</p></section><section class=related><p>{LONG}</p></section>"
    assert html.main_text(page).split("\n\n") == [*[LONG.strip()] * 40, "Short."]


@pytest.mark.parametrize(
    "part",
    [
        '<div class="post-comments"><p>{}</p></div>', '<section class="story-comments"><p>{}</p></section>', '<div class="main-menu"><p>{}</p></div>',
        '<div class="sidebar-content"><p>{}</p></div>', '<div class="page-footer"><p>{}</p></div>', '<div class="article-share"><p>{}</p></div>',
        '<div id="commentsContent"><p>{}</p></div>', '<article class="comment"><p>{}</p></article>', '<ul class="related-stories"><li>{}</li></ul>',
        '<div class="story cookie-notice"><p>{}</p></div>', '<div class="ad-slot"><p>{}</p></div>', '<div class="content-banner"><p>{}</p></div>',
    ],
)
def test_html_parts_that_go(part):
    other = "Not of the story, and yet a long paragraph, with commas, and words, " * 4
    inside = f"<body><article><h1>Head</h1><p>{LONG}</p>{part.format(other)}<p>{LONG}</p></article></body>"
    beside = f"<body><article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></article>{part.format(other)}</body>"
    for page in (inside, beside):
        assert html.main_text(page).split("\n\n") == ["Head", LONG.strip(), LONG.strip()], page


def test_html_headlines_and_neighbours():
    story = ["Head", LONG.strip(), LONG.strip()]
    whole = lambda page: html.main_text(page).split("\n\n")
    for head in ('<h1 class="header">Head</h1>', '<div class="header"><h1>Head</h1></div>', '<header><h1>Head</h1></header>', '<div class="post-header"><h2>Head</h2></div>'):
        assert whole(f"<body><article>{head}<p>{LONG}</p><p>{LONG}</p></article></body>") == story, head
    assert whole(f'<body class="has-sidebar"><div class="content with-sidebar"><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div></body>') == story
    # A teaser of another story goes, the next part of this one stays.
    assert whole(f"<body><article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></article><article><h2>Other</h2><p>Teaser, of another story.</p></article></body>") == story
    assert whole(f'<body><article class="part"><h1>Head</h1><p>{LONG}</p></article><article class="part"><p>{LONG}</p></article></body>') == story
    # Nothing beside the main part belongs to it.
    assert whole(f'<body><main><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></main><section class="more"><p>We use cookies, as all do.</p></section></body>') == story
    assert whole(f'<body><div class="header"><p>{LONG}</p></div><article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></article></body>') == story


def test_html_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "x"), (3, "w", "<p>" + "long text, " * 50_000, "x")]
    found = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert [r["n_chars"] for r in found if r["page_id"] in (2, None)] == [0, 0] and len(found) == 5
    assert all(r["n_chars"] == len(r["text"]) for r in found) and found[0]["text"] == found[1]["text"]
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_html_query(spark):
    """On the driver's pages, which mark their article, against cutting it out by pattern."""
    import html as codes

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op3_html_extraction(spark, SF).collect():
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = [re.sub(r"\s+", " ", codes.unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(p for p in parts if p)


def test_folding_and_matches():
    assert toxicity.fold("ѕtupіd 1D10T p4thetíc 10 ＩＤＩＯＴ") == "stupid idiot pathetic 10 idiot"
    found = toxicity.Matcher([("idiot", True, 4.0), ("scum", False, 2.0)], ("pond scum",))
    assert found.features("An 1d10t, idiotic scums.") == (6.0, 150.0)
    assert found.features("pond scum here") == (0.0, 0.0) and found.features("") == (0.0, 0.0)
    assert toxicity.Matcher([], ()).features("idiot") == (0.0, 0.0)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in queries.op7_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for d, r in found.items())
    held = [(labels[d], r["predicted"]) for d, r in found.items() if d in labels and r["held_out"]]
    assert sum(p for t, p in held if not t) == 0  # clean documents are left alone
    assert sum(p for t, p in held if t) >= 0.5 * sum(t for t, _ in held)


def test_toxicity_odd_rows(spark):
    rows = odd_rows() + [(500, "what an idiot, a pathetic moron", "s")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(1, 1, None), (1, 0, None), (None, 1, None), (2, None, None), (3, 0, 1)], "doc_id bigint, toxic int, score int")
    for some in (labels, labels.limit(0)):
        found = toxicity.score_documents(docs, some).collect()
        assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
        assert {r["doc_id"] for r in found if r["predicted"]} == {500}
        kept = toxicity.reject_toxic(docs, some)
        assert kept.columns == docs.columns and kept.count() == len(rows) - 1
    assert toxicity.score_documents(documents(spark, []), labels).collect() == []


def check_scores(rows, found):
    words = lambda t: [w.lower() if w.isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["\0"]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in rows if not held(d) for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for d, t in rows:
        own = words(t)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        want[d, held(d), len(own), sum(w in counts for w in own), total, round(base, 5)] += 1
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in found)
    assert got == want
    assert all(r["score"] < 0 for r in found)


def test_language_model(spark, monkeypatch):
    for name, size in (("HELD", 50), ("COUNTED", 20), ("FIT", 1), ("WARM", 200), ("REPLICA", 500)):
        monkeypatch.setattr(lm, name, size)
    rows = odd_rows()
    check_scores([r[:2] for r in rows], lm.score_documents(documents(spark, rows)).collect())
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2]
    check_scores([r[:2] for r in held], lm.score_documents(documents(spark, held)).collect())  # nothing to train on
    assert lm.score_documents(documents(spark, [])).collect() == []


def test_every_training_text_fits_the_weights(spark, monkeypatch):
    rows = [(i if i % 3 else None, f"word{i} and more", "s") for i in range(300)]
    training = documents(spark, rows).selectExpr("doc_id", "CAST(text AS BINARY) AS text").where(~lm.held_out(F.col("doc_id")))
    rounds = []
    monkeypatch.setattr(lm, "_fit_round", lambda slim, shared, weights, replicas: (rounds.append([bytes(r["text"]) for r in slim.collect()]), weights)[1])
    vocab = lm.vocabulary(lm.count_words(training))
    lm.fit(training, vocab, None)
    assert sorted(sum(rounds, [])) == sorted(bytes(r["text"]) for r in training.collect())
    nameless = {t.encode() for i, t, _ in rows if i is None}
    assert all(nameless & set(part) for part in rounds)  # they don't all stand in one part


def test_language_model_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op4_lm_scoring(spark, SF).collect()
    check_scores(rows, found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one(spark):
    vocab = lm.vocabulary(lm.count_words(documents(spark, odd_rows()).selectExpr("CAST(text AS BINARY) AS text")))
    weights = lm.first_weights(vocab)
    total = 0.0
    for word in vocab["names"]:
        at, inp, out, ins = lm.places(vocab, [word])
        p = lm.log_probabilities(weights, np.zeros((1, lm.STATE), np.float32), out, ins)[0] / math.log(10)
        total += 10 ** (p + (math.log10(vocab["c"][at[0]] + 1) - math.log10(vocab["tails"][out[0] - lm.CLASSES].sum() + 1) if ins[0] < 0 else 0))
    logs = lm.log_probabilities(weights, np.zeros((lm.TAILS, lm.STATE), np.float32), lm.CLASSES + np.arange(lm.TAILS), np.full(lm.TAILS, -1))
    total += (np.exp(logs) / (vocab["tails"].sum(1) + 1)).sum()  # one unknown word of each tail class
    assert total == pytest.approx(1, abs=1e-3)


def tiny_model():
    """Weights in double precision of a small vocabulary, and some encoded texts."""
    draw = np.random.default_rng(5)
    outputs, inputs = lm.CLASSES + lm.TAILS, lm.CLASSES * lm.IN_CLASS + lm.TAILS
    shapes = {"x": (inputs, 3 * lm.STATE), "u": (lm.STATE, 3 * lm.STATE), "o": (lm.STATE, outputs), "ob": (outputs,), "i": (lm.CLASSES, lm.IN_CLASS, lm.STATE), "ib": (lm.CLASSES, lm.IN_CLASS)}
    weights = {k: draw.normal(0, 0.4, s) for k, s in shapes.items()}

    def text(n):
        out = draw.integers(0, outputs, n)
        return draw.integers(0, inputs, n), out, np.where(out < lm.CLASSES, draw.integers(0, lm.IN_CLASS, n), -1)

    return weights, [text(n) for n in (9, 4, 1, 6, 13)], draw


def plain_score(w, text, first):
    """One token after the other, as the equations of the gated unit say."""
    state, total = np.zeros(lm.STATE), 0.0
    previous = first
    for inp, out, ins in zip(*text, strict=True):
        x, across, n = w["x"][previous], state @ w["u"], lm.STATE
        z, r = 1 / (1 + np.exp(-(x[:n] + across[:n]))), 1 / (1 + np.exp(-(x[n : 2 * n] + across[n : 2 * n])))
        new = np.tanh(x[2 * n :] + r * across[2 * n :])
        state = z * state + (1 - z) * new
        logits = state @ w["o"] + w["ob"]
        total += logits[out] - np.log(np.exp(logits).sum())
        if ins >= 0:
            inside = w["i"][out] @ state + w["ib"][out]
            total += inside[ins] - np.log(np.exp(inside).sum())
        previous = inp
    return total


def test_scores_equal_a_plain_pass(monkeypatch):
    monkeypatch.setattr(lm, "SCORE", (3, 4))
    weights, texts, _ = tiny_model()
    assert lm.score_texts(weights, texts, 7) == pytest.approx([plain_score(weights, t, 7) for t in texts], rel=1e-4)


def test_gradients_equal_finite_differences():
    weights, texts, draw = tiny_model()
    inp, out, ins, owner, starts, _ = lm.lanes(texts, 3, 7)
    real = np.flatnonzero(owner.ravel() >= 0)
    o, i = out.ravel()[real], ins.ravel()[real]
    state = draw.normal(0, 0.3, (inp.shape[1], lm.STATE))
    scale = 1 / math.sqrt(len(real))

    def loss(w):
        states = lm.forward(w, inp, starts, state)[0].astype(float).reshape(-1, lm.STATE)[real]
        return -scale * lm.log_probabilities(w, states, o, i).sum()

    found, _ = lm.gradients(weights, inp, starts, o, i, real, state)
    for name, (rows, grad) in found.items():
        whole = np.zeros_like(weights[name])
        whole[slice(None) if rows is None else rows] = grad
        places = np.argwhere(np.abs(whole) > 1e-3)
        for at in map(tuple, draw.permutation(places)[:12]):
            sides = []
            for step in (1e-2, -1e-2):
                moved = {k: v.copy() for k, v in weights.items()}
                moved[name][at] += step
                sides.append(loss(moved))
            assert (sides[0] - sides[1]) / 2e-2 == pytest.approx(whole[at], rel=0.03, abs=2e-4), (name, at)


def test_long_texts_are_learned_in_pieces_that_follow_each_other():
    _, texts, _ = tiny_model()
    parts, heads = lm.pieces(texts, 4, 7)
    assert np.concatenate([p[0] for p in parts]).tolist() == np.concatenate([t[0] for t in texts]).tolist()
    assert max(len(p[0]) for p in parts) == 4 and heads[0] == 7 and heads[1] == texts[0][0][3]


def test_state_goes_over_windows(spark):
    vocab = lm.vocabulary(lm.count_words(documents(spark, odd_rows()).selectExpr("CAST(text AS BINARY) AS text")))
    weights = lm.first_weights(vocab)
    texts = [lm.places(vocab, lm.words(t.encode()))[1:] for t in ("a b " * 50, "c", "", "d e f " * 20)]
    first = int(lm.places(vocab, [lm.END])[1][0])
    together = lm.score_texts(weights, texts, first)
    assert together == pytest.approx([lm.score_texts(weights, [t], first)[0] for t in texts], rel=1e-4)
    long = [np.concatenate([t[i] for t in [texts[0]] * 1]) for i in range(3)]
    states = np.zeros((1, lm.STATE), np.float32)
    inp = np.concatenate([[first], long[0][:-1]])[:, None]
    starts = np.zeros((len(inp), 1), bool)
    h, _, _ = lm.forward(weights, inp, starts, states)
    assert lm.log_probabilities(weights, h[:, 0], long[1], long[2]).sum() == pytest.approx(together[0], rel=1e-4)


def test_words_told_apart_together_are_those_of_each_text(monkeypatch):
    monkeypatch.setattr(lm, "SLICE", 40)
    texts = [None, b"", b"   ", b" A b\tA\n", b"\xc3\x89 \xff\x85 d\x1cx\x0b\x0c\xc2\xa0 ", b"x" * 200, b"x", b"Y x Y " * 30]
    found = []
    for part in lm.slices(pa.array([b"before", *texts], pa.binary())[1:]):
        names, codes, lengths = lm.tokens(part)
        own = names.take(pa.array(codes)).to_pylist()
        stops = np.cumsum(lengths)
        found += [own[stop - n : stop] for n, stop in zip(lengths, stops, strict=True)]
    assert found == [lm.words(t) for t in texts]
    assert lm.tails_of(pa.array([b"", b"a", b"abcd"], pa.binary())).tolist() == [lm.tail_of(w) for w in (b"", b"a", b"abcd")]
    assert list(lm.tokens(pa.array([], pa.binary()))[1]) == []


def test_windows_use_the_same_arrays_again(monkeypatch):
    monkeypatch.setattr(lm, "TRAIN", (3, 4))
    weights, texts, _ = tiny_model()
    weights = {k: v.astype(np.float32) for k, v in weights.items()}
    gradients, seen = lm.gradients, []

    def watched(*args):
        found = gradients(*args)
        seen.append({name: id(kept) for name, kept in args[-1].kept.items()})
        return found

    monkeypatch.setattr(lm, "gradients", watched)
    lm.train(weights, [texts[:2]] * 3, 7)
    assert len(seen) > 3 and seen[-1] == seen[-2]


def test_logits_out_of_the_range_of_exponentials():
    weights, texts, draw = tiny_model()
    wild = {k: v * (400 if k in ("ob", "ib", "o") else 1) for k, v in weights.items()}
    inp, out, ins = texts[4]
    states = draw.uniform(-1, 1, (len(out), lm.STATE))
    want = []
    for h, o, i in zip(states, out, ins, strict=True):
        logits = h @ wild["o"] + wild["ob"]
        want.append(logits[o] - np.logaddexp.reduce(logits))
        if i >= 0:
            logits = wild["i"][o] @ h + wild["ib"][o]
            want[-1] += logits[i] - np.logaddexp.reduce(logits)
    assert lm.log_probabilities(wild, states, out, ins) == pytest.approx(want, rel=1e-9)
