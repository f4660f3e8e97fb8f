"""Operators against brute-force versions, and their defined results on odd tables."""

import collections
import hashlib
import html
import os
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridspark.llm import common, decontamination, embedding_dedup, html_extract, line_dedup, mixing, near_dedup, quality, repeat_removal, secret_scan, warc

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, "en", None, 0, 5), (2, "", "en", "a", 0, 5), (None, "no id here at all", "en", "a", 0, 5), (3, "word " * 30000, "en", "b", 0, 5), (4, "tie tie", "en", "a", 0, 5), (4, "tie tie", "en", "a", 0, 5),
    (5, "Ünïcode ж words\nand lines\n\nand lines", None, "b", 0, 5), (6, "\n \t\n", "en", "a", 0, 5),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


def _rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def _sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- helpers ---


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 560)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for n in got} and set(got) == {n for u, v in edges if u != v for n in (u, v)}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bucket_links_past_hubs_that_fit_nothing(spark):
    # b and c are alike; neither the smallest nor the largest of the bucket fits anything
    rows = [(1, b"a", 1), (1, b"b", 10), (1, b"c", 11), (1, b"d", 99), (2, b"d", 99)]
    at = spark.createDataFrame(rows, "bucket long, node binary, size int")
    fits = lambda a, b: F.least(a["size"], b["size"]) >= 0.8 * F.greatest(a["size"], b["size"])
    close = lambda data, i, j: np.minimum(data["size"][j], data["size"][i]) >= 0.8 * np.maximum(data["size"][j], data["size"][i])
    got = common.bucket_links(at, fits, lambda pairs: pairs, close, lambda data, i, j: True, "test").collect()
    assert {bytes(r.node): bytes(r.component) for r in got} == {b"b": b"b", b"c": b"b"}


@pytest.mark.parametrize("block", [3, 4096])
def test_bucket_links_are_the_links_of_all_pairs(spark, block):
    rng = random.Random(6)
    nodes = {f"{k:03}".encode(): rng.randrange(1, 400) for k in range(120)}
    at = [(b, n, nodes[n]) for b in range(12) for n in rng.sample(sorted(nodes), 25)] + [(99, n, v) for n, v in nodes.items() if v < 60]
    alike = lambda x, y: abs(x - y) <= 2
    label = {n: n for n in nodes}
    for b, n, v in at:
        for c, m, w in at:
            if b == c and alike(v, w):
                low, high = sorted((label[n], label[m]))
                label = {k: low if x == high else x for k, x in label.items()}
    fits = lambda a, b: F.abs(a["size"] - b["size"]) <= 50
    close = lambda data, i, j: np.abs(data["size"][j] - data["size"][i]) <= 20
    sizes = spark.createDataFrame(list(nodes.items()), "node binary, size int")
    verify = lambda pairs: pairs.join(sizes.toDF("u", "a"), "u").join(sizes.toDF("v", "b"), "v").where("abs(a - b) <= 2").select("u", "v")
    got = common.bucket_links(spark.createDataFrame(at, "bucket long, node binary, size int"), fits, verify, close, lambda data, i, j: alike(data["size"][i], data["size"][j]), "test", block=block).collect()
    got = {bytes(r.node): bytes(r.component) for r in got}
    assert {n: got.get(n, n) for n in nodes} == label


@pytest.mark.parametrize("small", [4, 256])
def test_fitting_members_of_buckets(spark, small):
    rng = random.Random(8)
    at = [(b, f"{b}-{k}".encode(), rng.randrange(1, 2000)) for b in range(400) for k in range(rng.choice((1, 2, 3, 9)))]
    of = collections.defaultdict(list)
    for b, n, v in at:
        of[b].append((n, v))
    want = {(b, n) for b, n, v in at if len(of[b]) > small or any(m != n and abs(v - w) <= 40 for m, w in of[b])}
    df = spark.createDataFrame(at, "bucket long, node binary, size int")
    got = common.fitting(df, df, lambda data, i, j: abs(data["size"][i] - data["size"][j]) <= 40, small)
    for batch in ("10000", "7"):  # buckets go on from one batch to the next
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        found = [(r.bucket, bytes(r.node)) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == want and 0 < len(want) < len(at)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("wide", [False, True])
def test_shared_keys(spark, wide):
    rng = random.Random(8)
    rows = [(k, [rng.choice([7, rng.randrange(50), rng.randrange(1 << 31)]) for _ in range(3)]) for k in range(400)]
    columns = lambda b: ((t, np.arange(b.num_rows), np.asarray(b.column("keys").flatten()).reshape(-1, 3)[:, t].astype(np.uint64)) for t in range(3))
    df = spark.createDataFrame(rows, "h long, keys array<long>").repartition(5)
    got = sorted((r.h, r.bucket) for r in common.shared_keys(df, columns, ["keys"], wide, "test").collect())
    want = set()
    for t in range(3):
        count = collections.Counter(keys[t] for _, keys in rows)
        want |= {(h, t, keys[t]) for h, keys in rows if count[keys[t]] > 1}
    assert got == sorted((h, key if wide else (t << 34) + key) for h, t, key in want)


def test_range_hash_equals_on_equal_bytes():
    raw = np.frombuffer(b"abcabcabc", np.uint8)
    h = common.RangeHash(raw)
    w = h.windows(3)
    assert w[0] == w[3] == w[6] and len({*w.tolist()}) == 3
    assert h(np.array([0, 3]), np.array([3, 6])).tolist() == [w[0], w[0]]


# --- 1 quality ---


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    emit, move = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    z, marginal, _ = quality.forward_backward(emit, move, np.array([0, 4, 4]))
    score = {p: sum(emit[t, s] for t, s in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False)) for p in np.ndindex(2, 2, 2, 2)}
    total = np.log(sum(np.exp(v) for v in score.values()))
    assert z[0] == pytest.approx(total)
    assert marginal[2, 1] == pytest.approx(sum(np.exp(v - total) for p, v in score.items() if p[2] == 1))


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op1(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all() and out.score.between(0, 1).all()
    both = out[out.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.9 and len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_quality_lines_are_relabelled_within_documents():
    rng = np.random.default_rng(1)
    size, n = 6, 200
    y = np.arange(n) % 2
    first = np.arange(n + 1) * size
    truth = np.repeat(y, size)
    truth[np.flatnonzero((truth == 0) & (rng.random(len(truth)) < 0.4))] = 1  # bad documents hold good lines
    x = np.stack([truth + rng.normal(0, 0.3, len(truth)), rng.normal(size=len(truth))], 1)
    length = np.full(len(truth), 10)
    field = quality.Field(2).fit(x, length, first, y.astype(float))
    lines = field.relabelled(x, length, first, y.astype(float))
    assert (lines == truth).mean() > 0.93 and (np.add.reduceat(1 - lines, first[:-1])[y == 0] > 0).all()
    s = field.scores(x, length, first)
    assert s[y == 1].min() > s[y == 0].mean()


def test_quality_odd_tables(spark, odd):
    field = quality.fit(odd, spark.createDataFrame([(3, 1, None), (4, 0, 1), (99, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int"))
    got = quality.score(odd, field).collect()
    assert len(got) == len(ODD) and [r.score for r in got if r.doc_id in (1, 2)] == [0.0, 0.0]
    untaught = quality.fit(odd.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(odd.limit(0), untaught).count() == 0
    assert {r.score for r in quality.score(odd, untaught).collect()} == {0.0, 0.5}
    assert quality.keep_good(odd, untaught).columns == odd.columns


# --- 2 secrets ---


def test_secret_base_rules(spark):
    texts = ["password = secret token=abcdef", "TOKEN:'AbC/+_.=-1' x", "AKIA" + "A1" * 8 + " AKIASHORT", "f" * 23 + " " + "a1" * 12, "é api_key: éa\ntoken = 12345", "secret : token = abcdefgh", None, "ſecret=abcdef Key"]
    got = [r for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    rx = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for t, r in zip(texts, got, strict=True):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in rx.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        names = [f"{secret_scan.KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3)) and r.base_sha256 == _sha(",".join(names))
        assert set(names) <= set(r.spans.split(",") if r.spans else [])


def test_secret_network_holds_out(spark, odd):
    net = secret_scan.trained()
    for other, seed in ((False, 123), (True, 77)):  # the threshold comes from the other formats, of which the network learned none
        rows = secret_scan.findings(600, seed, other)
        hit = net.of_candidates([r[:3] for r in rows]) >= net.threshold
        truth = np.array([r[3] for r in rows])
        assert hit[truth == 1].mean() > 0.92 and hit[truth == 0].mean() < 0.03
    key = "a8B2kQ9zLm4Xc7Vb1Nn5Rt6Yp3Wd0EfGhJ1K"
    path = "/".join(f"folder{k}name" for k in range(20))
    texts = [f"use ghp_{key} now", f"see {path}/{key}x9Qz7Lw2/{path} there", f"see {path}/{path} there", "x" * 200_000, f"é {'word ' * 50000} {key}"]
    got = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].spans.startswith("model:4:") and got[0].n_assign == 0
    at = texts[1].index("folder0") , texts[1].rindex(" there")
    assert got[1].spans == f"model:{at[0]}:{at[1]}" and got[2].spans == ""
    start = len(texts[4]) - len(key)
    assert got[4].spans == f"model:{start}:{len(texts[4])}"
    assert secret_scan.scan(odd).count() == len(ODD) and secret_scan.scan(odd.limit(0)).count() == 0


def test_secret_windows_cover_candidates():
    for n in (1, 64, 65, 96, 97, 500):
        w = secret_scan._windows(10, 10 + n)
        assert {i for a, z in w for i in range(a, z)} == set(range(10, 10 + n)) and all(z - a <= 64 for a, z in w)


# --- 3 embeddings ---


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + rng.normal(0, 0.1, (20, 16)), np.repeat(base[:1], 5, 0), base[1] + rng.normal(0, 0.12, (60, 16))]).astype(np.float32)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0] * 3]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, v) for k, v in enumerate(odd)]
    for block in (1024, 8):
        clash = [(*r, "x", 1) for r in rows]
        got = _rows(embedding_dedup.links(spark.createDataFrame(clash, "vec_id long, embedding array<float>, node string, copies int"), block=block), "vec_id")
        u = x.astype(float)
        u /= np.linalg.norm(u, axis=1)[:, None]
        near = u @ u.T >= 0.9
        np.fill_diagonal(near, False)
        near |= (x[:, None] == x[None]).all(2) & ~np.eye(len(x), dtype=bool)
        label = np.arange(len(x))
        for _ in range(len(x)):
            label = np.minimum(label, np.where(near, label[None], len(x)).min(1))
        found = np.array([got[k].n_links for k in range(len(x))])
        assert (found <= near.sum(1)).all() and found.sum() >= 0.97 * near.sum()
        assert np.mean([got[k].component_id == label[k] for k in range(len(x))]) > 0.97
        assert all(got[1000 + k].n_links == 0 and got[1000 + k].component_id == 1000 + k and got[1000 + k].kept for k in range(len(odd)))
    assert embedding_dedup.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x = embedding_dedup.unit(rng.normal(size=(300, 48)))
    y = embedding_dedup.unit(x + rng.normal(0, 0.06, x.shape))
    both = [embedding_dedup.Codes.of(v, 3, 1) for v in (x, y)]
    again = [embedding_dedup.Codes.unpack([r.tobytes() for r in np.concatenate(c.pack(), 1)], 48, 3, 1) for c in both]
    assert all((a.signs == b.signs).all() and np.allclose(a.rounded, b.rounded, atol=1e-6) and np.allclose(a.factors, b.factors) for a, b in zip(both, again, strict=True))
    estimate, error = again[0].estimates(again[1])
    truth = x @ y.T
    assert abs((estimate - truth).mean()) < 0.003 and (np.abs(estimate - truth) <= embedding_dedup.CONFIDENCE * error).mean() > 0.9999
    possible = again[0].possible(again[1], 0.9)
    assert possible[truth >= 0.9].all() and possible.mean() < 0.1


def test_embedding_ids_that_repeat_or_are_null(spark):
    one, near, other = [1.0] * 8, [1.0] * 7 + [1.2], [1.0, -1.0] * 4
    rows = [(5, one), (5, near), (7, other), (7, [-v for v in other]), (None, near), (None, [9.0] + [0.0] * 7), (8, None), (None, None)]
    got = embedding_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.9999).collect()
    key = lambda r: (str(r[0]), r[1], str(r[2]), r[3])
    want = [(5, 2, 5, True), (5, 2, 5, True), (7, 0, 7, True), (7, 0, 7, True), (None, 2, 5, False), (None, 0, None, True), (8, 0, 8, True), (None, 0, None, True)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("block", [1024, 2])
def test_embedding_chains_are_one_component(spark, block):
    # 0 - 2 - 1 - 3: neighbours link, the others don't; the smallest neighbour alone would leave 1 and 3 apart
    angle = np.deg2rad([0, 40, 20, 60])
    x = np.stack([np.cos(angle), np.sin(angle)] + [np.zeros(4)] * 6, 1)
    got = _rows(embedding_dedup.links(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), recall=0.9999, block=block), "vec_id")
    assert [got[k].n_links for k in range(4)] == [1, 2, 2, 1]
    assert [got[k].component_id for k in range(4)] == [0] * 4
    root = np.arange(60)
    u, v = np.array([(a, b) for a, b in [(k, k + 7) for k in range(0, 50, 3)] + [(59, 2), (59, 40)]]).T
    embedding_dedup.union(root, u, v)
    want = list(range(60))
    for a, b in list(zip(u.tolist(), v.tolist(), strict=True)) * 60:
        want[a] = want[b] = min(want[a], want[b])
    assert root.tolist() == want


# --- 4 pages ---


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a b"), ("<article><h1>T</h1><p>x<b>y</b>\n z</p><br>w</article><p>out", "T xy z w"),
        ("<body><nav>n</nav><header>h</header><main><p>m &lt;b&gt;<aside>s</aside></main><div class='cookie-notice'>c</div></body>", "m <b>"),
        ("<article>a<script>if (1<2) '</p>'</script><style>p{}</style><form>f</form><section id=comments><p>c</p></section></article>", "a"), ("<article>a<!-- x > y -->b", "ab"), ("<p>1 < 2 & 3</p>", "1 < 2 & 3"),
        ("<article><p>a <button>Share</button> b <i hidden>c</i> <span class='skip'>d</span>e</p></article>", "a b e"), ("<p>keep <span class='ad'>buy<br>now</span> end", "keep end"),
        ("<article class='post legal'><div class='side-by-side'>x <math><mi>y</mi></math></div><p class='legal'>z</p></article>", "x y z"), ("<article>a <a title=\"q>b</a> c</article>", "a b c"),
        ("<script>'<main>'</script><div id='site-footer2'>f</div><div class='comment-list'>g</div><p>t</p>", "t"), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a b c"), ("<p>&amp;lt; &#x41;&nbsp;B", "&lt; A B"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page or "") == text


def test_pages_and_templates(spark):
    out = _rows(html_extract.op4(spark, SF), "page_id")
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " \x01 ", body))).replace("\x01", " ").split())
        assert out[r.page_id].text == want and out[r.page_id].n_chars == len(want)
    rows = [(k, f"http://h.org/{k}", f"<body><div><a>Home</a></div><div><p>story {k}</p><p>more {k}</p></div><div>All rights reserved</div></body>") for k in range(8)]
    rows += [(9, None, None), (9, "http://h.org/9", ""), rows[0], rows[0]]
    got = html_extract.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted(r.text for r in got) == sorted([f"story {k} more {k}" for k in [*range(8), 0, 0]] + ["", ""])
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_templates_nest_and_leave_slots(spark):
    rng = random.Random(7)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows, want = [], {}
    for k in range(12):
        story = [say(rng.randrange(8, 40)) for _ in range(rng.randrange(1, 6))]
        items = "".join(f"<li>Read the item number {rng.randrange(99)}</li>" for _ in range(1 + k % 4))
        menu = f"<div>Welcome back dear user u{k} to our site</div><div>Home News Sports Contact</div>"
        body = "".join(f"<p>{t}</p>" for t in story)
        rows.append((k, "https://Example.org/x", f"<html><body>{menu}<div>{body}</div><ul>{items}</ul><div>Printed on day {k} by the example press</div></body></html>"))
        want[k] = " ".join(story)
    rows += [(100, "https://few.org/1", "<p>same</p><p>one</p>"), (101, "https://few.org/2", "<p>same</p><p>two</p>"), (102, "https://example.org/x", f"<p>{say(200000)}</p>")]
    got = _rows(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert {k: got[k].text for k in want} == want
    assert (got[100].text, got[101].text) == ("same one", "same two") and got[102].n_chars > 900_000


# --- 5 WARC ---


def test_warc_round_trip_in_any_split(spark):
    same = "x" * 1500
    rows = [(k, f"http://a/{k}", same if k % 3 == 0 else f"{random.Random(k).random()}" * (k % 7) * 30) for k in range(60)] + [(None, None, None), (100, "u\r\nv", "é" * 800), (101, "w", "y" * 999), (102, "w", "y" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = common.scratch_path(spark, "warc-test")
    written = warc.write_archives(pages.repartition(3), folder)
    assert written.count() >= 1
    want = {}
    for i, _, h in rows:
        data = (h or "").encode()
        last = max((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None)
        revisit = len(data) >= 1000 and i != last
        want[i] = (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None, None if revisit else data)
    for split in (100, 777, 1 << 20):
        got = warc.read_archives(spark, folder, split).collect()
        assert len(got) == len(rows)
        for r in got:
            n, digest, kind, to, data = want[r.page_id]
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (n, digest, kind, to) and (kind == "revisit" or bytes(r.payload) == data)
    empty = common.scratch_path(spark, "warc-empty")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


# --- 6 decontamination ---


def _contamination(docs, items, size=8):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: rx.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add("" if i is None else str(i))
    out = []
    for t in docs:
        w, hit, ids = low(t), set(), set()
        for p, who in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    ids |= who
                    hit.update(range(k, k + len(p)))
        out.append((len(w), len(hit), len(ids), _sha(",".join(sorted(ids))), len(ids) >= 2))
    return out


@pytest.mark.parametrize("a_pass", [3, 1000])
def test_decontamination_against_brute_force(spark, a_pass):
    rng = random.Random(2)
    words = ["a", "bb", "the", "Ärger", "x1", "zzz"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(40)] + [None, "", "!!", "a"]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate([1, 2, 3, 7, 8, 9, 12, 15])] + [(None, "a the bb"), (None, "x1 zzz x1")] + [(50, None), (51, "..."), (52, texts[0])] + [(60, texts[1].upper()), (60, texts[1])]
    d = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = _rows(decontamination.contamination(d, b, items_a_pass=a_pass))
    for k, want in enumerate(_contamination(texts, items)):
        r = got[k]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want
    assert decontamination.contamination(d, b.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.contamination(d.limit(0), b).count() == 0


def test_decontaminate_keeps_clean_rows(spark, odd):
    b = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "tie")], "item_id long, text string")
    dirty = spark.createDataFrame([(9, "So: ONE two, three four five six seven eight!", "en", "a", 0, 1)], ODD_SCHEMA)
    out = decontamination.decontaminate(odd.unionByName(dirty), b)
    assert out.columns == odd.columns and out.count() == len(ODD) and out.where("doc_id = 9").count() == 0


@pytest.mark.parametrize("a_pass", [1, 1000])
def test_short_items_alone_drop_nothing_however_often(spark, a_pass):
    long = " ".join(f"w{k} the end of" for k in range(20))
    d = spark.createDataFrame([(1, long), (2, long + " one two three four five six seven eight")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "the end"), (2, "one two three four five six seven eight nine")], "item_id long, text string")
    for items in (b.where("item_id = 1"), b):
        got = {r.doc_id for r in decontamination.decontaminate(d, items, items_a_pass=a_pass).collect()}
        assert got == ({1, 2} if items is not b else {1})
    d = d.where("doc_id = 1")
    assert decontamination.contamination(d, b).first().n_hit == 40 and decontamination.decontaminate(d, b, items_a_pass=a_pass).count() == 1


# --- 7 repeats ---


def _repeats(texts, size=400):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        mask = np.zeros(len(d) + 2, int)
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                mask[i + 1 : i + 1 + size] = 1
        out.append((len(d), int(mask.sum()), int((np.diff(mask) == 1).sum()), hashlib.sha256(bytes(c for c, m in zip(d, mask[1:-1], strict=True) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_against_brute_force(spark, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    base, texts = [text(1200) for _ in range(3)], []
    for _ in range(40):
        x = text(rng.randrange(200))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(700)
            x += rng.choice(base)[at : at + rng.randrange(380, 520)] + text(rng.randrange(40))
        texts.append(x)
    texts += [None, "", "z" * 1000, "z" * 399, "q" * 400, texts[3], base[0], base[0]]
    d = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    got = _rows(repeat_removal.remove_repeats(d))
    for k, want in enumerate(_repeats(texts)):
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == want, k
    assert repeat_removal.remove_repeats(d.limit(0)).count() == 0


def test_repeated_rows_repeat_each_other(spark):
    d = spark.createDataFrame([(1, "ab" * 150 + "c" * 200)] * 2 + [(None, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in repeat_removal.remove_repeats(d).collect()) == [0, 500, 500]


# --- 8 mixing ---


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_mixing_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    a, b = (df.sort_values("doc_id").reset_index(drop=True) for df in (mixing.op8(spark, sf).toPandas(), con.execute(mixing.OP8_SQL).df()))
    assert (a == b[a.columns]).all().all()
    again = mixing.op8(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (a == again).all().all() and (a.taken <= 2 * a["size"]).all()


def test_mixing_targets_and_odd_rows(spark, odd):
    out = mixing.mix(odd).collect()
    assert len(out) == len(ODD) and all(r.taken <= 2 * r.size for r in out)
    by = {r.source_size: r.target for r in out}
    assert sum(by.values()) == pytest.approx(1.5 * sum(by)) and all(t <= 2 * s for s, t in by.items())
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixture(odd).columns == [*odd.columns, "taken"]


def test_mixture_shares_of_repeated_rows(spark, odd):
    again = odd.unionByName(odd).unionByName(odd.where("doc_id = 3")).withColumn("taken", F.lit("x"))
    out, shares = mixing.mixture(again), mixing.mix(again)
    assert out.columns == again.columns and out.count() == again.count()
    totals = lambda df: sorted((str(r[0]), r[1]) for r in df.groupBy("doc_id").agg(F.sum("taken")).collect())
    assert totals(out) == totals(shares)


def test_sainte_lague_against_the_definition(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    votes = [(f"p{k}", float(rng.choice([0, 1, 1, 5, 1000, 37.5]))) for k in range(40)]
    got = {r.p: r.won for r in mixing.sainte_lague(spark.createDataFrame(votes, "p string, v double"), ["p"], "v", F.lit(101), []).collect()}
    quotients = sorted(((-v / (2 * k + 1), p, k) for p, v in votes if v for k in range(102)))[:101]
    assert got == {p: sum(q[1] == p for q in quotients) for p, _ in votes}


# --- 9 lines ---


def _kept_lines(rows):
    """By brute force: each text with the lines that stay."""
    first, order = {}, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, text in order:
        for k, line in enumerate((text or "").split("\n")):
            if n := line_dedup.normalised(line):
                first.setdefault(n, (i, k))
    lines = sorted(first, key=len)
    label = {n: n for n in lines}
    count = {n: collections.Counter(n) for n in lines}
    for j, b in enumerate(lines):
        most = int(0.1 * len(b) + 1e-9)
        for a in reversed(lines[:j]):
            if len(b) - len(a) > most or not most:
                break
            if (count[b] - count[a]).total() <= most and near_dedup.edit_distance(a, b, most) <= most:
                low, high = sorted((label[a], label[b]))
                label = {k: low if x == high else x for k, x in label.items()} if low != high else label
    best = {}
    for n in lines:
        best[label[n]] = min(best.get(label[n], first[n]), first[n], key=lambda p: (p[0] is not None, p))
    stay = set(best.values())
    return {i: None if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if not line_dedup.normalised(line) or (i, k) in stay) for i, t in rows}


def test_line_dedup_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, got = _kept_lines(rows), _rows(line_dedup.op9(spark, SF))
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_lines >= r.n_kept == sum(bool(line_dedup.normalised(x)) for x in (r.text or "").split("\n")) for r in got.values())


def test_line_dedup_odd_tables(spark, odd):
    kept = line_dedup.dedup_lines(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").first().text == "Ünïcode ж words\nand lines\n"
    assert kept.where("doc_id = 1").first().text is None and line_dedup.dedup_lines(odd.limit(0)).count() == 0
    assert kept.where("doc_id = 4").count() == 2 and kept.where("doc_id IS NULL").first().text == "no id here at all"
    names = spark.createDataFrame([(k, f"{'x' * k} same line here\n\nend", "a", 1) for k in range(3)] + [(7, "SAME line, here!\n\nend", "b", 2)], "doc_id long, text string, row string, lines int")
    got = _rows(line_dedup.dedup_lines(names))
    assert line_dedup.dedup_lines(names).columns == names.columns
    assert got[0].text == " same line here\n\nend" and 7 not in got


@pytest.mark.parametrize("small", [4, 256])
def test_shared_keys_of_rows_that_meet_by_chance(spark, small):
    rng = random.Random(9)
    rows = [(k, [rng.choice([7, rng.randrange(300)]), rng.randrange(100)], rng.randrange(1, 2000)) for k in range(700)]
    columns = lambda b: ((t, np.arange(b.num_rows), np.asarray(b.column("keys").flatten()).reshape(-1, 2)[:, t].astype(np.uint64)) for t in range(2))
    close = lambda data, i, j: np.abs(data["size"][i] - data["size"][j]) <= 40
    df = spark.createDataFrame(rows, "h long, keys array<long>, size int").repartition(5)
    got = sorted((r.h, r.bucket) for r in common.shared_keys(df, columns, ["keys"], False, "test", close, {"size": "<i4"}, small).collect())
    want, met = [], 0
    for t in range(2):
        of = collections.defaultdict(list)
        for h, keys, size in rows:
            of[keys[t]].append((h, size))
        met += sum(len(m) for m in of.values() if len(m) > 1)
        want += [(h, (t << 34) + key) for key, m in of.items() for h, v in m if len(m) > small or any(h != g and abs(v - w) <= 40 for g, w in m)]
    assert got == sorted(want) and len(want) < met


def test_lines_that_meet_by_chance_are_not_written(spark, monkeypatch):
    rng = random.Random(23)
    lines = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=30)) for _ in range(600)]
    written, search = [], line_dedup.shared_keys
    monkeypatch.setattr(line_dedup, "shared_keys", lambda *a: (found := search(*a), written.append(found.select("h").distinct().count()))[0])
    rows = list(enumerate([*lines, lines[0][:-1] + "é"]))
    # any two lines of 54 characters or less that share a key of one 13-bit block were candidates
    kept = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), distance=4)
    assert {r.doc_id for r in kept.collect()} == set(range(600)) and all(n <= 20 for n in written)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh жж𝄞", "".join(map(chr, range(100, 900))), "".join(map(chr, [*range(100, 0xD000), *range(0xE000, 0x20000)]))])
def test_distances_of_many_pairs(letters):
    rng = random.Random(25)
    texts = ["", "a", letters]
    for _ in range(60):
        text = rng.choices(letters, k=rng.randrange(80))
        other = list(text)
        for _ in range(rng.randrange(9)):
            k = rng.randrange(len(other) + 1)
            other[k : k + rng.randrange(2)] = rng.choices(letters, k=rng.randrange(3))
        texts += ["".join(text), "".join(other)]
    i = np.array([*range(3, 123, 2), *(rng.choice([0, 1, *range(3, 123)]) for _ in range(900))])
    j = np.array([*range(4, 124, 2), *(rng.choice([0, 1, *range(3, 123)]) for _ in range(900))])[: len(i)]
    j = np.minimum(j, len(texts) - 1)
    most = np.array([rng.choice([0, 1, 2, 5, 9, 20, 60]) for _ in i])
    got = line_dedup.within(line_dedup.Letters(pa.array(texts)), i, j, most)
    want = [near_dedup.edit_distance(texts[a], texts[b], k) <= k for a, b, k in zip(i.tolist(), j.tolist(), most.tolist(), strict=True)]
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_block_links_of_many_pairs_at_once(spark):
    rng = random.Random(26)
    nodes = {f"{k:03}".encode(): rng.randrange(1, 400) for k in range(120)}
    rows = [(b, n, nodes[n], n) for b in range(12) for n in rng.sample(sorted(nodes), 25)]
    rows += [(99, b"x%03d" % k, 1000 + 9 * k - 8 * (k % 7 == 0), b"x%03d" % k) for k in range(400)]
    at = spark.createDataFrame(rows, "bucket long, node binary, size int, comp binary")
    close = lambda data, i, j: np.abs(data["size"][j] - data["size"][i]) <= 20
    decide = lambda data, i, j: np.abs(data["size"][j] - data["size"][i]) <= 2
    for block in (7, 150, 4096):
        many, one = (common.components(common.block_links(at, close, decide, block=block, many=x)) for x in (True, False))
        got, want = ({bytes(r.node): bytes(r.component) for r in x.collect()} for x in (many, one))
        assert got == want and len(set(got.values())) > 60


def test_pair_parities_bound_the_distance():
    rng = random.Random(24)
    texts = ["".join(rng.choices("abc жé𝄞", k=rng.randrange(1, 30))).strip() or "a" for _ in range(60)]
    texts = [line_dedup.normalised(t) or "a" for t in texts]
    texts += [line_dedup.normalised(t[: len(t) // 2] + rng.choice(["", "b", "жc"]) + t[len(t) // 2 + 1 :]) or "a" for t in texts]
    raw = np.frombuffer("\n".join(texts).encode(), np.uint8)
    bits = line_dedup.line_keys(raw, line_dedup.lines_of(raw, np.array([0, len(raw)]))[0])["par"]
    apart = {(i, j): int(bits[i] ^ bits[j]).bit_count() for i in range(120) for j in range(120)}
    assert all(n <= 4 * near_dedup.edit_distance(texts[i], texts[j], 99) for (i, j), n in apart.items())
    assert sum(n > 4 for n in apart.values()) > 5000


def test_line_keys_of_pigeonhole_blocks(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(300)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values[:40]] + [values[0] ^ (1 << k) for k in range(64)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(k, signed(v)) for k, v in enumerate(values)], "h long, sim long")
    found = collections.defaultdict(set)
    for r in common.shared_keys(df, line_dedup.block_keys(), ["sim"], False, "test").collect():
        found[r.h].add(r.bucket)
    near = [(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and (a ^ b).bit_count() <= line_dedup.DISTANCE]
    assert len(near) > 100 and all(found[i] & found[j] for i, j in near)


def test_lines_of_long_batches_take_bounded_memory(monkeypatch):
    class Caught:
        mapInArrow = staticmethod(lambda run, schema: run)

    monkeypatch.setattr(line_dedup, "_keyed", lambda docs: Caught)
    run, rng = line_dedup._lines(None), random.Random(4)
    texts = ["\n".join(" ".join("".join(rng.choices("abcdeé", k=6)) for _ in range(9)) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "row": pa.array(range(len(texts)), pa.int64()), "text": texts})
    tracemalloc.start()
    found = []
    for b in run(iter([batch])):
        found.append(b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20, f"{peak >> 20} MB"
    # blocks change nothing of what is found
    raw, offsets = common.utf8(batch.column("text"))
    at, _ = line_dedup.lines_of(raw, offsets)
    whole, table = line_dedup.line_keys(raw, at), pa.Table.from_batches(found)
    assert table.column("h").to_pylist() == whole["node"][:, 0].view(np.int64).tolist()
    assert table.column("keys").combine_chunks().flatten().to_pylist() == whole["keys"].view(np.int32).tolist()


def test_one_edit_in_a_short_line_always_shares_a_half():
    rng = random.Random(4)
    for _ in range(400):
        a = "".join(rng.choice("abcdé ж") for _ in range(rng.randrange(9, 20))).replace(" ", "x")
        k = rng.randrange(len(a))
        b = rng.choice([a[:k] + "q" + a[k + 1 :], a[:k] + a[k + 1 :], a[:k] + "ü" + a[k:]])
        if not 10 <= max(len(a), len(b)) <= 19 or min(len(a), len(b)) < 9:
            continue
        sets = []
        for x in (a, b):
            raw = np.frombuffer(x.encode(), np.uint8)
            z, start, end = line_dedup.normal_lines(raw, np.array([0, len(raw)]))
            keys = line_dedup.half_keys(z, start, end, common.RangeHash(z))[0]
            sets.append({("start", k) for k in keys[:2].tolist()} | {("end", k) for k in keys[2:].tolist()})
        assert sets[0] & sets[1], (a, b)


def test_recall_of_lines_with_a_changed_letter(spark):
    rng = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows, sizes = [], (2, 3, 6, 10, 15, 25, 40, 80)
    for n in sizes:
        for _ in range(60):
            line = " ".join("".join(rng.choices(letters, k=rng.randrange(3, 9))) for _ in range(n)).ljust(10, "z")
            k = rng.choice([k for k, c in enumerate(line) if c != " "])
            rows += [(len(rows), line), (len(rows) + 1, line[:k] + rng.choice([c for c in letters if c != line[k]]) + line[k + 1 :])]
    kept = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(range(0, len(rows), 2))
    for j, n in enumerate(sizes):
        assert sum(i in kept for i in range(120 * j + 1, 120 * j + 120, 2)) <= 3, n


def test_fuzzy_lines_at_the_similarity_asked_for(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(3000)]
    rows, pairs = [], 0
    for n in (8, 20, 40, 80):
        for _ in range(50):
            line = rng.choices(words, k=n)
            most = int(0.1 * len(" ".join(line)))
            near = list(line)
            for k in rng.sample(range(n), n):
                new = [*near[:k], rng.choice(words), *near[k + 1 :]]
                if line_dedup.edit_distance(" ".join(line), " ".join(new), most) <= most:
                    near = new
                if len(set(zip(range(n), near)) - set(zip(range(n), line))) >= max(1, n // 14):
                    break
            if near != line:
                pairs += 1
                rows += [(len(rows), " ".join(line)), (len(rows) + 1, " ".join(near))]
    kept = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert pairs > 150 and kept >= set(range(0, len(rows), 2))
    assert len(rows) - len(kept) >= 0.97 * pairs


def test_lines_that_meet_by_chance_need_no_text(spark, monkeypatch):
    rng = random.Random(21)
    lines = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(20)) for _ in range(600)]
    wanted, texts = [], line_dedup._texts
    monkeypatch.setattr(line_dedup, "_texts", lambda docs, nodes: wanted.append(nodes.count()) or texts(docs, nodes))
    rows = list(enumerate([*lines, lines[0][:-1] + "é"]))
    # keys of one 13-bit block: some 200 of these lines share one, a tenth of them within REACH bits
    kept = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), distance=4)
    assert {r.doc_id for r in kept.collect()} == set(range(600)) and 2 <= wanted[0] <= 60


def test_pair_counts_bound_the_distance():
    rng = random.Random(22)
    texts = ["".join(rng.choices("abc ж𝄞", k=rng.randrange(1, 40))) for _ in range(60)] + ["ab" * 400, "ab" * 396]
    counts = line_dedup.gram_counts(pa.array(texts))
    i, j = (x.ravel() for x in np.indices((len(texts), len(texts))))
    far = np.array([near_dedup.edit_distance(texts[a], texts[b], 900) for a, b in zip(i, j, strict=True)])
    assert line_dedup.allowed(counts, i, counts, j, far).all()
    assert not line_dedup.allowed(counts, i, counts, j, far // 4).all()


def test_fuzzy_short_lines(spark):
    rng = random.Random(12)
    rows = []
    for k in range(60):
        owner = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(4))
        rows += [(2 * k, f"{owner} 2019"), (2 * k + 1, f"{owner} 2023")]
    rows += [(200, "a b c d"), (201, "a b c e")]
    kept = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= {*range(0, 120, 2), 200, 201} and len(kept) <= 62 + 6


# --- 10 near duplicates ---


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_against_the_definition():
    rng = random.Random(0)
    for _ in range(3000):
        a = [rng.choice("abc") for _ in range(rng.randrange(14))]
        b = list(a) if rng.random() < 0.6 else [rng.choice("abc") for _ in range(rng.randrange(14))]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abc"))
            b.pop(rng.randrange(len(b)))
        most = rng.randrange(8)
        assert near_dedup.edit_distance(a, b, most) == min(_levenshtein(a, b), most + 1)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 200))] for _ in range(30)]
    for t in texts[:12]:
        for _ in range(3):
            c = list(t)
            for _ in range(max(1, len(c) // 40)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            texts.append(c)
    texts = [" ".join(t) for t in texts] + ["a b", "a b", "", None, "one two three"]
    got = _rows(near_dedup.classes(spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, node string")))
    label = list(range(len(texts)))
    split = [near_dedup.words((t or "").encode()) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or near_dedup.similar(split[i], split[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert [got[k].class_id for k in range(len(texts))] == label


def test_recall_of_near_duplicates_up_to_the_threshold(spark):
    rng = random.Random(60)
    rows, kinds = [], [(n, share) for n in (60, 200) for share in (0.05, 0.1, 0.15, 0.19)]
    for n, share in kinds:
        for _ in range(80):
            t = [f"w{rng.randrange(5000)}" for _ in range(n)]
            c = list(t)
            for j in rng.sample(range(n), int(share * n)):
                c[j] = f"v{rng.randrange(5000)}"
            rows += [(len(rows), " ".join(t)), (len(rows) + 1, " ".join(c))]
    got = _rows(near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")))
    for j, kind in enumerate(kinds):
        assert np.mean([got[k + 1].class_id == k for k in range(160 * j, 160 * j + 160, 2)]) >= 0.9, kind


def test_near_duplicates_odd_tables(spark, odd):
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 4").count() == 1 and kept.where("doc_id = 3").count() == 1
    assert kept.where("coalesce(text, '') = ''").count() == 1
    assert near_dedup.classes(odd.limit(0)).count() == 0
    got = near_dedup.classes(odd).collect()
    assert len(got) == len(ODD) and [(r.class_id, r.kept) for r in got if r.doc_id in (1, 2)].count((1, True)) == 1
    assert [(r.class_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] and [r.kept for r in got if r.doc_id == 4] == [True, True]
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (1, "a b c d e f g", "x"), (None, "a b c d e f g", "w"), (None, "z z", "v"), (None, "z z", "u")]
    clash = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = near_dedup.keep_one(clash)
    assert kept.columns == clash.columns and sorted(r.text for r in kept.collect()) == ["a b c d e f g", "z z"]
    assert kept.collect() == near_dedup.keep_one(clash.repartition(3)).collect() or kept.orderBy("text").collect() == near_dedup.keep_one(clash.repartition(3)).orderBy("text").collect()


# --- pipeline ---


def test_pipeline_keeps_schema_and_takes_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.stash(stage(spark, docs, SF), "test")
        assert docs.columns == (names if k + 1 < len(corpus_pipeline.STAGES) else [*names, "taken"]), name
        assert docs.count() <= n
        n = docs.count()
    assert n > 50 and os.path.exists(SF)
    assert corpus_pipeline.run(spark, SF).count() == n


def test_pipeline_on_odd_and_empty_tables(spark, odd):
    import corpus_pipeline

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert quality.keep_good(odd.limit(0), quality.fit(odd, labels)).count() == 0
    for docs in (odd, odd.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:]):
            got = common.stash(stage(spark, docs, SF), "test")
            assert got.columns == (docs.columns if k + 2 < len(corpus_pipeline.STAGES) else [*docs.columns, "taken"])
            docs = got
