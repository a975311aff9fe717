"""Training-data operators against brute force, oracles, and awkward rows."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from typeloom.llm import bpe, chat_format, decontaminate, html_text, line_dedup, lm_score, media, near_dup, pretokens, queries, sql, toxicity, url_filter, webp

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
#: Null, empty, blank, tied, repeated and long texts, with a column of a clashing name.
AWKWARD = [(1, None, "x"), (2, "", "x"), (3, " \n\t\n", "x"), (4, "one", "x"), (4, "one", "x"), (5, "one", "y"), (None, "lost and found in the deep dark old green wood today", "x"), (6, "word " * 30_000, "x"), (7, "Ünï çødé 漢字 😀 'tis", None)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sql.SQL)
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in "documents pages benchmark conversations labels".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = db.execute(sql.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


# ---------------------------------------------------------------- 1


def words10(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_leaks(text, items):
    w = words10(text)
    hit, ids = set(), set()
    for i, item in items:
        v = words10(item)
        n = min(10, len(v))
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                ids.add(str(i))
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("block", [10**6, 12])
def test_leaks(spark, block):
    r = random.Random(1)
    some = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    items = [(1, some(14)), (2, some(30)), (3, "a b c"), (4, "x"), (5, ""), (6, None), (7, "a " * 25)]
    docs = [(i, f"{some(r.randint(0, 60))}, {r.choice(items)[1]} {some(9)}") for i in range(60)] + [(100, None), (101, ""), (102, "A B c!")]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block).collect()
    for x in found:
        assert (x.n_words, x.n_hit, list(x["items"])) == brute_leaks(dict(docs)[x.doc_id], items)
        assert x.n_hit == sum(x.edges[1::2]) - sum(x.edges[::2])
    kept = decontaminate.reject(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    assert {x.doc_id for x in kept.collect()} == {x.doc_id for x in found if not x.n_hit}


# ---------------------------------------------------------------- 2


def test_lm_scores(spark, awkward, nothing):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    big, small = (sorted(map(tuple, lm_score.score(awkward, path, pattern, head_size=h, sample=5).drop("score").collect()), key=repr) for h in (1 << 19, 2))
    assert [x[:5] for x in big] == [x[:5] for x in small] and np.allclose([x[5] for x in big], [x[5] for x in small])
    assert lm_score.score(nothing, path, pattern).count() == 0


def test_windows_score_each_place_once():
    starts = np.array([0, 1, 40, 140])
    first, low, high = lm_score.windows(starts, lm_score.SPAN, lm_score.STRIDE)
    assert [k for a, b in zip(first, high) for k in range(a, b)] == list(range(140)) and (low <= first).all()


def test_model_is_a_distribution():
    """The probabilities of all ids after a context add up to one, before and after learning."""
    r = np.random.default_rng(0)
    n = 130
    by = r.integers(0, 50, n).astype(float)
    model = lm_score.Attention(n, by)
    ids = r.integers(0, n - 1, 600)
    head = ids[:50]
    for steps in (0, 40):
        if steps:
            model.train(ids, np.array([0, 600]), steps=steps)
        t = model.tables()
        # score of head + k + end less that of the head's own places: log10 of P(k) P(end | k), so the end's share is left out by hand.
        place = [one_place(t, head, k) for k in range(n)]
        assert abs(sum(place) - 1) < 1e-4


def one_place(t, head, k):
    """Probability of id k after head, a place at a time: plain loops over keys and tree nodes."""
    span, stride = lm_score.SPAN, lm_score.STRIDE
    inputs = [len(t["q"]) - 1, *head]
    at = len(head)
    first = at // stride * stride
    keys = range(max(0, first - (span - stride)), at + 1)
    q = t["q"][inputs[at]]
    z = np.array([q @ t["k"][inputs[j]] + t["far"][at - j] for j in keys], float)
    a = np.exp(z - z.max())
    h = np.tanh(sum(w * t["v"][inputs[j]].astype(float) for w, j in zip(a / a.sum(), keys)) + t["own"][inputs[at]])
    nodes, sides, _, _ = t["tree"].paths(np.array([k]))
    p = 1.0
    for node, side in zip(nodes, sides):
        p *= 1 / (1 + np.exp(-side * (t["node"][node][:-1] @ h + t["node"][node][-1])))
    return p


def test_scores_equal_plain_loops():
    r = np.random.default_rng(3)
    n = 60
    model = lm_score.Attention(n, np.ones(n))
    ids = r.integers(0, n - 1, 200)
    model.train(ids, np.array([0, 200]), steps=30)
    t = model.tables()
    text = ids[:75]
    want = sum(np.log10(one_place(t, text[:i], k)) for i, k in enumerate([*text, n - 1]))
    assert abs(lm_score.score_ids(t, text, np.array([0, 75]))[0] - want) < 1e-3 * abs(want)


def test_word_counts_against_sql(spark):
    """held_out, n_tokens, n_known, train_tokens and base_score of the driver's documents, and that held-out rows teach nothing."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {x.doc_id: x for x in lm_score.score(docs, path, pattern, head_size=500, sample=3).collect()}
    tokens = {d: re.findall("[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) + [None] for d, t in docs.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in tokens}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    total, floor = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    assert len(got) == len(tokens) and any(held.values())
    for d, ws in tokens.items():
        x = got[d]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[d], len(ws), sum(w in counts for w in ws), total)
        assert abs(x.base_score - sum(np.log10((counts[w] + 0.5) / floor) for w in ws)) < 1e-6 * len(ws)
    # Other texts of held-out rows leave all other scores as they are.
    changed = docs.withColumn("text", F.when(lm_score.held_out(F.col("doc_id")), F.lit("quite other words")).otherwise(F.col("text")))
    for x in lm_score.score(changed, path, pattern, head_size=500, sample=3).collect():
        if not x.held_out:
            assert (x.n_known, x.train_tokens) == (got[x.doc_id].n_known, total) and x.base_score == pytest.approx(got[x.doc_id].base_score) and abs(x.score - got[x.doc_id].score) < 0.02 * abs(x.score)


def test_ids_of_one_class_differ_in_context():
    """Which of two ids of a class follows depends on which of two ids of that class is before; all ids' probabilities add up to one."""
    n, r = 600, np.random.default_rng(1)
    pairs = [(500, 510), (501, 511)]
    ids = np.concatenate([np.append(r.integers(0, 20, 2), pairs[r.integers(2)]) for i in range(6000)])
    by = np.bincount(ids, minlength=n).astype(float)
    model = lm_score.Attention(n, by)
    model.train(ids, np.arange(0, len(ids) + 1, 60), steps=300)
    t, head = model.tables(), ids[:6]
    p = {(a, b): lm_score.score_ids(t, np.append(head, [a, b, 7]), np.array([0, 9]))[0] for a in (500, 501) for b in (510, 511)}
    assert p[500, 510] + p[501, 511] > p[500, 511] + p[501, 510] + 1
    hidden = np.append(np.random.default_rng(2).normal(size=lm_score.DIM), 1)
    nodes, sides, m, begin = model.tree.paths(np.arange(n))
    z = sides * (t["node"][nodes] @ hidden)
    assert np.exp(np.add.reduceat(-np.logaddexp(0, -z), begin)).sum() == pytest.approx(1)


def test_short_texts_are_learnt():
    r = np.random.default_rng(0)
    ids, starts = r.integers(0, 99, 500), np.arange(0, 501, 5)
    model = lm_score.Attention(100, np.ones(100))
    old = {k: v.copy() for k, v in model.w.items()}
    model.train(ids, starts, steps=5)
    assert all((old[k] != model.w[k]).any() for k in model.w)


def test_all_training_rows_are_learnt_from(spark, monkeypatch):
    """The first weights come from one text; the other rows' learning makes their texts likelier."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [(i, "red fox " * 5 if i % 2 else "blue whale " * 5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    whole = [x.score for x in lm_score.score(docs, path, pattern, sample=1).collect()]
    monkeypatch.setattr(lm_score, "_learn", lambda *_: None)
    first = [x.score for x in lm_score.score(docs, path, pattern, sample=1).collect()]
    assert len({round(x, 9) for x in whole}) == 2 and sum(whole) > sum(first) + 4 * len(rows)


def test_texts_are_read_and_split_once(spark, tmp_path):
    """Counts, first weights, learning and scores all use the ids that one pass has stored."""
    path, pattern, log = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, str(tmp_path / "read")

    def noted(text):
        with open(log, "a") as f:
            f.write("x")
        return text

    texts = [None, "", "red fox", "blue whale \u6f22"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.select("doc_id", F.udf(noted, "string").asNondeterministic()("text").alias("text"))
    assert lm_score.score(docs, path, pattern, sample=3).count() == len(texts)
    assert os.path.getsize(log) == len(texts)


@pytest.mark.parametrize("root, block", [(3, 4), (16, 32)])
def test_blocks_of_nodes_learn_as_single_nodes(monkeypatch, root, block):
    """Whatever nodes are in blocks, the weights that learning gives are those of one block of all nodes, and all ways hold the same nodes."""
    n, r = 300, np.random.default_rng(4)
    by = r.integers(0, 50, n).astype(float)
    ids, starts = r.integers(0, n - 1, 900), np.array([0, 1, 300, 300, 900])
    models = []
    for a, b in ((n, 1), (root, block)):
        monkeypatch.setattr(lm_score, "ROOT", a)
        monkeypatch.setattr(lm_score, "BLOCK", b)
        models.append(lm_score.Attention(n, by))
        models[-1].train(ids, starts, steps=None, batch=7)
    one, other = models
    assert (np.sort(other.tree.number) == np.arange(n - 1)).all() and (other.tree.lower.max() > 0) == (root == 3)
    for name in one.w:
        x, y, met, seen = one.w[name], other.w[name], one.met[name], other.met[name]
        if name == "node":
            x, y, met, seen = (v[m.tree.number] for v, m in ((x, one), (y, other), (met, one), (seen, other)))
        assert np.allclose(x, y, atol=1e-4) and (met == seen).all()
    for i in range(n):
        assert np.allclose(one.tree.paths(np.array([i]))[1], other.tree.paths(np.array([i]))[1])


# ---------------------------------------------------------------- 3


def brute_components(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                x, y = sets[a], sets[b]
                if x & y and 100 * len(x & y) >= percent * len(x | y) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return comp


def test_near_dup(spark, awkward, nothing):
    r = random.Random(5)
    docs = []
    for g in range(6):
        base = [r.choice("abcdefghij") + str(r.randint(0, 99)) for _ in range(r.randint(3, 90))]
        for _ in range(9):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"z{r.randint(0, 999)}"
            docs.append((len(docs), " ".join(w)))
    docs += [(900, None), (901, ""), (902, " "), (903, "one"), (904, "one")]
    got = near_dup.classes(spark.createDataFrame(docs, "doc_id long, text string"), k=4).collect()
    assert {x.doc_id: x.component_id for x in got} == brute_components(docs, 4, 80)
    assert near_dup.classes(nothing).count() == 0
    kept = near_dup.keep_one(awkward).collect()
    assert sorted(x.doc_id for x in kept if x.doc_id is not None) == [1, 2, 3, 4, 6, 7] and len(kept) == 7


def test_cells_find_all_links(spark, monkeypatch):
    """Members of one bucket in several cells: all links between different components, and no others."""
    monkeypatch.setattr(near_dup, "CELL", 8)
    texts = [" ".join(f"w{(i // 3) * 50 + j}" for j in range(40)) + f" x{i}" for i in range(30)]
    sets, starts = near_dup.shingle_sets([t.encode() for t in texts], 4)
    s = (near_dup.mix64(near_dup.sketches(sets, starts)) & np.uint64(255)).astype(np.uint8)
    ids = [bytes([i]) for i in range(30)]
    known = spark.createDataFrame([(ids[i], texts[i].encode(), s[i].tobytes(), [i + 100, 1]) for i in range(30)], "c binary, text binary, sketch binary, bands array<long>")
    rest = spark.createDataFrame([(1, ids[i], ids[i - i % 3] if i % 3 < 2 else ids[i], 30) for i in range(30)], "key long, c binary, comp binary, m long")
    pairs = {frozenset((x.a, x.b)) for x in near_dup._cells(rest, known, 4, 80).collect()}
    assert pairs == {frozenset((ids[i], ids[j])) for i in range(30) for j in range(i) if i // 3 == j // 3 and i % 3 == 2}


def test_sketches_fill_and_agree():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 400).astype(np.uint64))
    b = np.concatenate([a[:360], r.integers(0, 2**63, 40).astype(np.uint64)])
    s = near_dup.sketches(np.concatenate([a, b, a[:1]]), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + 1]))
    assert (s != np.uint64(2**64 - 1)).all() and abs((s[0] == s[1]).mean() - 360 / 440) < 0.12


# ---------------------------------------------------------------- 4


def test_url_rules_and_model(spark):
    urls = ["http://WWW.Example.com/en/1", "https://a.example.com/en/?q", "http://x.net/es/a", "http://xnet/es/a", "http://y.com", "ftp://free-casino.org/win", "http://library.org/guide", None, "no scheme", "http://a.org?x/en/", "http://ü.org/ß"]
    got = {x.url: x for x in url_filter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), key="page_id").join(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), "page_id").collect()}
    assert (got[urls[0]].rule, got[urls[0]].verdict, got[urls[0]].host) == ("www.example.com/en/", "allow", "www.example.com")
    assert (got[urls[1]].rule, got[urls[1]].verdict) == ("example.com/en/", "block")
    assert got[urls[2]].rule == "net/es/" and got[urls[3]].rule is None and got[urls[4]].rule is None
    assert got[urls[5]].verdict == "block" and got[urls[6]].verdict == "allow"
    assert (got[None].host, got[None].path, got["no scheme"].host) == ("", "", "") and got[urls[9]].path == ""


# ---------------------------------------------------------------- 5


def test_line_dedup(spark, awkward, nothing):
    long = "the quick brown fox jumps over the lazy old dog"
    docs = [(1, f"{long}\nshort\n\n"), (2, f"{long.replace('quick', 'slow')}\nshort\nother"), (3, f"{long} today\nshore"), (4, None), (5, "a " + long), (6, "the quick fox brown jumps over the lazy old dog")]
    out = {x.doc_id: x for x in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[1].text == docs[0][1] and out[2].text == "other" and out[3].text == "shore" and out[4].text is None
    assert out[5].text == "" and out[6].text == docs[5][1] and (out[2].n_dropped, out[2].n_near) == (2, 1)
    assert {x.doc_id for x in line_dedup.thin(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {1, 2, 3, 4, 6}
    assert line_dedup.dedup_lines(nothing).count() == 0
    assert line_dedup.dedup_lines(awkward).count() == len(AWKWARD)


def test_short_earliest_neighbour_hides_no_longer_one(spark):
    """Two lines of seven words are compared for equality only, whatever comes first."""
    docs = [(1, "a b c d e f g"), (2, "a b c d e f h x"), (3, "a b c d e f h"), (4, "a b c d e f i")]
    out = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {1: docs[0][1], 2: docs[1][1], 3: "", 4: docs[3][1]}


# ---------------------------------------------------------------- 6


def test_toxicity(spark, awkward, nothing):
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeiou") + r.choice("bdlmnrt") for _ in range(r.randint(1, 4)))
    bad = lambda: "grumbl" + word()
    rows = [(i, " ".join([word() for _ in range(60)] + ([bad(), bad()] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    y = {i: t for i, _, t in rows}
    held = [x for x in toxicity.score(docs, labels).collect() if x.held_out]
    assert len(held) > 60 and sum(x.predicted == y[x.doc_id] for x in held) / len(held) > 0.9
    scores = toxicity.score(awkward, labels.limit(0)).collect()
    assert len(scores) == len(AWKWARD) and all(x.score == 0 and x.predicted == 0 for x in scores)
    assert toxicity.score(nothing, labels).count() == 0 and toxicity.reject(nothing, labels).count() == 0


# ---------------------------------------------------------------- 7


def test_chat(spark):
    tricky = "&lt; <|im_end|>\n [INST] &amp;#91; </s>"
    rows = [(1, 0, "user", tricky), (1, 1, "assistant", tricky), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "sys\ntem", "x"), (None, 5, None, "y"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    rendered = chat_format.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {x.conv_id: [(t.role, t.text) for t in x.t] for x in rendered.select("conv_id", chat_format.parse(F.col("rendered")).alias("t")).collect()}
    assert back == {1: [("user", tricky), ("assistant", tricky), ("user", ""), ("assistant", "")], 2: [("sys\ntem", "x")], None: [("", "y")], 3: [("assistant", "a")] * 2}
    whole = chat_format.contexts(rendered, chat_format.examples(rendered)).where("conv_id = 1").orderBy("turn_no").collect()
    assert len(whole) == 2 and whole[0].context.endswith("assistant\n") and whole[1].context.startswith(whole[0].context + whole[0].target)


# ---------------------------------------------------------------- 8


def test_html():
    page = "<nav><a>Menu, long and longer.</a></nav><article><h1>T &amp; t</h1><p>One<br>two. <b>Three</b><p>Four\n five<script>x('<p>')</script><footer>no</footer></article><div class='comments'><p>Bad, bad, bad.</p></div>"
    assert html_text.main_text(page) == "T & t\nOne two. Three\nFour five"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>1") == ""
    assert html_text.main_text("just text, <i>really") == "just text, really"
    assert html_text.main_text("<p title='a>b'>x</p><!-- never closed <p>y") == "x"


LONG = "A sentence of some length, with a comma. Another one follows; it is about as long as that. "


def test_ratios_decide_without_names():
    """No element or class tells anything: length and punctuation by path, and links, choose."""
    page = f"""<body><div class=q><div class=k1><a href=/>Home</a> <a href=/>News</a></div><div class=k2><div><h2>A title</h2><p>{LONG * 3}</p><p>Short.</p><p>{LONG * 2}</p></div></div>
    <div class=k3><span>13 views</span></div><div class=k4>Est 1999</div></div></body>"""
    text = html_text.main_text(page)
    assert text == "\n".join(["A title", (LONG * 3).strip(), "Short.", (LONG * 2).strip()])
    parts = html_text.blocks(page)
    assert all(html_text.chosen(parts, threshold=0)) and not all(html_text.chosen(parts))


def test_names_are_a_weak_prior():
    inner = f"<h1>T</h1><p>{LONG}</p><p>{LONG * 2}</p>"
    want = f"T\n{LONG.strip()}\n{(LONG * 2).strip()}"
    for start in ("<div class='content with-sidebar'>", "<div class='post related-articles'>", "<div class='sidebar'>", "<form>"):
        assert html_text.main_text(f"<body><div class=menu><a>x</a></div>{start}{inner}</div></form><footer>(c) me</footer></body>") == want, start
    # With an article beside it, even a long part of comments is none.
    assert html_text.main_text(f"<article>{inner}</article><div class=comments><p>{LONG * 9}</p></div>") == want
    assert html_text.main_text(f"<article>{inner}<section class=comments><p>{LONG * 9}</p></section></article>") == want


def test_white_space_of_references():
    assert html_text.main_text("<p>a&nbsp;&nbsp;b&#9;&#x2003;c &emsp; d</p>") == "a b c d"


def test_extract(spark):
    rows = [(1, "http://a.test/", "<article><p>One.</p></article>", 5), (1, "http://a.test/", "<article><p>One.</p></article>", 5), (None, None, None, 6), (2, "u", "", 7), (3, "u", f"<article><p>{LONG * 3000}", 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = {x.page_id: x for x in html_text.extract(pages).collect()}
    assert html_text.extract(pages).count() == 5 and html_text.extract(pages).columns == ["page_id", "url", "text", "n_chars"]
    assert (got[1].text, got[1].n_chars, got[None].text, got[2].text) == ("One.", 4, "", "") and got[3].text == (LONG * 3000).strip()
    assert html_text.extract(pages.limit(0)).count() == 0


def test_extract_against_brute_force(spark):
    """The driver's pages keep their text in one article: its blocks by plain replacement."""
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {x.page_id: x.text for x in html_text.extract(pages).collect()}
    for row in pages.collect():
        inner = re.search("<article[^>]*>(.*?)</article>", row.html, re.S)[1]
        inner = re.sub("<!--.*?-->|<script.*?</script>|<style.*?</style>", "", inner, flags=re.S)
        pieces = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|blockquote|table|tr|td|section|pre|figure|figcaption)\b[^>]*>", inner)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", re.sub("<br[^>]*>", " ", x)))).strip() for x in pieces]
        assert got[row.page_id] == "\n".join(b for b in blocks if b), row.page_id


# ---------------------------------------------------------------- 9


@pytest.mark.parametrize("n", [0, 1, 576, 577, 40_000])
def test_media_round_trip(n):
    raw = random.Random(n).randbytes(n)
    payload = media.payload_of(raw)
    assert len(payload) % 576 == 0 and payload.startswith(raw) and set(payload[n:]) <= {255} and payload
    assert media.load(media.store(payload)).tobytes() == payload


class Writer(webp.BitWriter):
    def one(self, symbol):  # a simple code of one symbol
        self.put(0b1 | 0 << 1 | 1 << 2 | symbol << 3, 11)

    def two(self, a, b):  # a simple code of two
        self.put(0b1 | 1 << 1 | 1 << 2 | a << 3 | b << 11, 19)

    def file(self, width, height, alpha=1):
        head = webp.BitWriter()
        for v, k in ((width - 1, 14), (height - 1, 14), (alpha, 1), (0, 3)):
            head.put(v, k)
        bits, n = head.value | self.value << head.n, head.n + self.n
        body = b"\x2f" + bits.to_bytes((n + 7) // 8, "little")
        body += b"\0" * (len(body) & 1)
        return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def test_webp_subtract_green_and_codes():
    w = Writer()
    w.put(1, 1), w.put(2, 2), w.put(0, 1)  # subtract green; no more transforms
    w.put(0, 1), w.put(0, 1)  # no cache, one group
    w.two(3, 9), w.one(250), w.one(1), w.one(255), w.one(0)
    for bit in (0, 1, 1, 0):
        w.put(bit, 1)
    assert webp.decode(w.file(2, 2)).tolist() == [[[253, 3, 4, 255], [3, 9, 10, 255]], [[3, 9, 10, 255], [253, 3, 4, 255]]]


def test_webp_palette():
    w = Writer()
    w.put(1, 1), w.put(3, 2), w.put(1, 8)  # a palette of two colours, stored as differences
    w.put(0, 1)
    w.one(5), w.one(10), w.one(20), w.one(100), w.one(0)
    w.put(0, 1)
    w.put(0, 1), w.put(0, 1)
    w.one(0b0110), w.one(0), w.one(0), w.one(0), w.one(0)
    got = webp.decode(w.file(4, 1))
    assert got.tolist() == [[[10, 5, 20, 100], [20, 10, 40, 200], [20, 10, 40, 200], [10, 5, 20, 100]]]


def test_webp_predictor_and_references():
    w = Writer()
    w.put(1, 1), w.put(0, 2), w.put(0, 3)  # a predictor image of 4 x 4 blocks: mode 2 (above)
    w.put(0, 1)
    w.one(2), w.one(0), w.one(0), w.one(0), w.one(0)
    w.put(0, 1)
    w.put(0, 1), w.put(0, 1)
    # Greens: a normal code with the literal 1 and the length symbol 256 + 2 (a length of 3).
    w.put(0, 1), w.put(12 - 4, 4)
    for k in webp.LENGTH_ORDER[:12]:
        w.put({18: 2, 0: 2, 1: 1}.get(k, 0), 3)
    w.put(0, 1)
    zero, one, run = (0b01, 2), (0b0, 1), (0b11, 2)
    for item in (zero, one):
        w.put(*item)
    left = 258 - 2
    while left > 10:
        n = min(left, 138)
        w.put(*run), w.put(n - 11, 7)
        left -= n
    for _ in range(left):
        w.put(*zero)
    w.put(*one)
    w.put(*run), w.put(280 - 259 - 11, 7)
    w.one(0), w.one(0), w.one(0), w.one(1)  # distance symbol 1: the pixel before
    w.put(0, 1), w.put(1, 1)
    got = webp.decode(w.file(2, 2))
    assert got[:, :, 1].tolist() == [[1, 2], [2, 3]] and got[0, 0, 3] == 255


def test_webp_meta_codes():
    """Two groups of codes, dealt out by blocks of 4 x 4 pixels."""
    w = Writer()
    w.put(0, 1)  # no transforms
    w.put(0, 1), w.put(1, 1), w.put(0, 3)  # no cache; groups by blocks
    w.put(0, 1)  # the groups' image: 2 x 1, group 0 and 1 in its green
    w.two(0, 1), w.one(0), w.one(0), w.one(0), w.one(0)
    w.put(0, 1), w.put(1, 1)
    for green in (7, 9):
        w.one(green), w.one(1), w.one(2), w.one(255), w.one(0)
    got = webp.decode(w.file(8, 1))
    assert got[0].tolist() == [[1, 7, 2, 255]] * 4 + [[1, 9, 2, 255]] * 4


def images():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 256, (40, 50))
    signed = ((g + 128) & 255) - 128
    words = rng.integers(0, 256, (12, 4))[rng.integers(0, 12, (30, 90))]
    return {
        "noise": (rng.integers(0, 256, (9, 7, 4)), None),
        "flat": (np.full((3, 5, 4), 7), (3,)),
        "pixel": (rng.integers(0, 256, (1, 1, 4)), ()),
        "slope": (np.add.outer(np.arange(40), np.arange(60))[:, :, None] + np.array([0, 10, 30, 90]), (0,)),
        "two colours": (rng.integers(0, 2, (5, 9, 1)) * np.array([1, 2, 3, 4]), (3,)),
        "palette": (words, (3,)),
        "green": (np.stack([g + 3, g, g - 5, g * 0 + 255], -1), None),
        "cross": (np.stack([(signed * 20 >> 5) + rng.integers(0, 3, g.shape), g, signed * -9 >> 5, g * 0 + 255], -1), (1,)),
        "cache": (np.where(rng.random((60, 90, 1)) < 0.5, words.repeat(2, 0), rng.integers(0, 256, (60, 90, 4))), None),
        "repeated": (np.tile(rng.integers(0, 256, (30, 40, 4)), (3, 1, 1)), None),
    }


def test_webp_round_trip():
    """Each transform, references and the cache, by the lockstep reader and by the reader of single pixels."""
    pixels = {k: (x & 255).astype(np.uint8) for k, (x, _) in images().items()}
    files = {k: webp.encode(x) for k, x in pixels.items()}
    together = dict(zip(files, webp.decode_many(list(files.values()))))
    for k, (_, undo) in images().items():
        f = webp._File(files[k])
        assert undo is None or tuple(u[0] for u in f.undo) == undo, k
        assert (together[k] == pixels[k]).all() and (f.finish(f.head.read(f.bits)) == pixels[k]).all(), k
    assert webp._File(files["cache"]).head.cache_bits
    assert len(files["repeated"]) < pixels["repeated"].size / 2 and len(files["slope"]) < 300
    with pytest.raises((ValueError, IndexError)):
        webp.decode(files["noise"][:60])


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictors(mode):
    """The decoder's runs against one pixel after the other."""
    rng = np.random.default_rng(mode)
    c, width = rng.integers(0, 256, (7 * 9, 4)), 9
    got = webp._channels(webp._undo_predictor(webp._joined(c), width, np.full(9, mode << 8, np.uint32), 2))
    want = c.copy()
    for i in range(len(c)):
        x, y = i % width, i // width
        guess = np.array([255, 0, 0, 0]) if not i else want[i - 1] if not y else want[i - width] if not x else webp._predicted(mode, want[i - 1], want[i - width], want[i - width - 1], want[i - width + 1])
        want[i] = want[i] + guess & 0xFF
    assert (got == want).all()


def test_code_lengths():
    rng = np.random.default_rng(2)
    for counts in (rng.integers(0, 9, 40), 2 ** np.arange(30), np.array([0, 5, 0]), np.array([1, 1])):
        n = webp.code_lengths(counts, 11)
        assert ((n > 0) == (counts > 0)).all() and n.max() <= 11
        assert np.count_nonzero(n) < 2 or (2.0 ** -n[n > 0]).sum() == 1


def test_media_rows(awkward, nothing):
    rows = media.describe(awkward).collect()
    assert len(rows) == len(AWKWARD) and len({(x.n_bytes, x.media_sha256, x.feature) for x in rows if x.n_bytes == 0}) == 1
    texts = sorted((t or "").encode() for _, t, _ in AWKWARD)
    for raw, x in zip(texts, sorted(rows, key=lambda x: texts.index(next(t for t in texts if hashlib.sha256(padded(t)).hexdigest() == x.payload_sha256)))):
        whole = padded(raw)
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
    assert media.describe(nothing).count() == 0
    for x in media.media_column(awkward).collect():
        assert media.load(bytes(x.media)).tobytes()[: x.n_bytes].decode() in [t or "" for _, t, _ in AWKWARD]


def padded(raw):
    return raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))


def test_media_uses_codes(spark):
    """Every document's files are prefix-coded, smaller than the payload in all, and read back whole."""
    rows = media.media_column(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    heads = [webp._File(f) for x in rows for f in media.files_of(bytes(x.media))]
    assert sum(len(x.media) for x in rows) < 0.75 * sum(x.n_bytes for x in rows)
    assert all(f.in_lockstep() for f in heads) and any(f.head.cache_bits for f in heads)
    assert not any(c.lengths[:256] == [8] * 256 for f in heads for c in f.head.groups[0])


# ---------------------------------------------------------------- 10


def test_pretokens():
    import regex

    pattern, r = regex.compile(public_tokenizers.PATTERN), random.Random(2)
    for _ in range(400):
        texts = ["".join(r.choice("ab'strevmld  \n\t,.!?12é漢 　Ⅷ😀'’_-\r\x85\x1c") for _ in range(r.randint(0, 25))) for _ in range(4)]
        buf, tokens, at = pretokens.split([t.encode() for t in texts])
        for i, t in enumerate(texts):
            assert [buf[tokens[k] : tokens[k + 1]].tobytes().decode() for k in range(at[i], at[i + 1])] == pattern.findall(t)


@pytest.mark.parametrize("block", [1 << 24, 1])
def test_bpe(awkward, nothing, block):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((str(x.doc_id), list(x.ids), x.decoded) for x in bpe.encode(awkward, path, block_bytes=block).collect())
    assert got == sorted((str(i), own.encode_ordinary(t or ""), t or "") for i, t, _ in AWKWARD)
    one = {x.doc_id: x for x in bpe.digest(awkward, path, block_bytes=block).collect()}[7]
    assert one.decoded_sha256 == hashlib.sha256(AWKWARD[-1][1].encode()).hexdigest()
    assert one.ids_sha256 == hashlib.sha256(" ".join(map(str, own.encode_ordinary(AWKWARD[-1][1]))).encode()).hexdigest()
    assert bpe.encode(nothing, path, block_bytes=block).count() == 0


def test_bpe_words():
    """Merging, by the list and by the heap, against the library; and a brute-force decoding by the table."""
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    lines = bpe.read_ranks(path)
    ranks = bpe.ranks_of(lines)
    own = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng, encode, decode = random.Random(4), bpe.encoder(lines), bpe.Decoder(lines)
    of = {k: token for token, k in ranks.items()}
    for n in (1, 2, 3, 7, 20, 99, 100, 101, 300):
        for letters in ("ab", "etaoinshrdlu", "aäß漢 \n"):
            word = "".join(rng.choice(letters) for _ in range(n))
            ids = encode(word.encode())
            assert ids == own.encode_ordinary(word)
            assert decode(np.array(ids))[0].tobytes() == b"".join(of[k] for k in ids) == word.encode()


def test_bpe_tells_words_that_share_a_hash(spark, monkeypatch):
    """The checksum stands where the hash doesn't tell words apart."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    run = bpe._blocks(4, pa.int64(), 1 << 20)
    monkeypatch.setattr(bpe, "span_hashes", lambda buf, a, b: np.minimum(b - a, 3).astype(np.uint64))
    rows = list(run([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"ab abc de"])], ["doc_id", "t"])]))
    lines = type("Lines", (), {"value": bpe.read_ranks(path)})
    coded = list(bpe._encoded(lines, pa.int64())(iter(r for r in rows if r.column(1)[0].as_py() == 0)))
    with pytest.raises(ValueError):
        list(bpe._assembled(lines, True)(iter([*coded, *sorted((r for r in rows if r.column(1)[0].as_py()), key=lambda r: r.column(1)[0].as_py())])))
    monkeypatch.undo()


# ---------------------------------------------------------------- stages' rows


def test_stages_keep_all_columns(spark):
    """Columns with names that the stages use themselves come out as they went in, also for null ids, empty texts and repeated rows."""
    names = ["n_lines", "_h", "_id", "_gone", "__t", "beside", "row", "th", "gone", "i", "h", "n", "Beside0"]
    texts = [(1, "one two three four five six"), (2, None), (2, None), (3, ""), (None, "lost words"), (4, "alpha beta gamma\n\ndelta")]
    rows = [(d, t, *(f"{k}{j}" for j in range(len(names)))) for k, (d, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    items = spark.createDataFrame([("x", "nothing of that kind")], "item_id string, text string")
    want = sorted(map(repr, map(tuple, rows)))
    for name, out in {"toxicity": toxicity.reject(docs, labels.limit(0)), "lines": line_dedup.thin(docs), "near": near_dup.keep_one(docs), "leaks": decontaminate.reject(docs, items)}.items():
        assert out.columns == docs.columns, name
        got = sorted(map(repr, map(tuple, out.collect())))
        assert got == want, name
    for stage in (lambda d: toxicity.reject(d, labels), line_dedup.thin, near_dup.keep_one, lambda d: decontaminate.reject(d, items)):
        assert stage(docs.limit(0)).count() == 0
    lines = line_dedup.dedup_lines(docs)
    assert [c for c in lines.columns if c == "n_lines"] == ["n_lines"] and dict(lines.dtypes)["n_lines"] == "bigint" and lines.count() == 6


# ---------------------------------------------------------------- the pipeline


def test_pipeline(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, now, SF)
        assert new.columns == docs.columns, name
        now = spark.createDataFrame(new.collect(), docs.schema)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {(x.doc_id, x.decoded) for x in out} == {(x.doc_id, x.text or "") for x in now.collect()}
    texts = [x.text or "" for x in now.collect()]
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(brute_leaks(t, items)[1] for t in texts)
    lines = [line for t in texts for line in t.split("\n") if line.strip(" ")]
    assert len(lines) == len(set(lines))
