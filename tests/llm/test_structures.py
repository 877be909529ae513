import math
import random
from html import unescape

import numpy as np
import xxhash

from lodestone.llm import ann, html, shard, simhash
from tests.llm.cases import PROSE, empty_docs, odd_docs


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in words.translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        t = rng.choice([" ", "\n", "\x1c"]).join(rng.choices(["a", "Bc", "É", "d\te"], k=rng.randint(0, 30)))
        assert int.from_bytes(simhash.fingerprint(t), "big") == brute_fingerprint(t), repr(t)


def brute_components(fps, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def chains(seed, n):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(fps) < n:
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << b
        fps.append(x)
    return fps


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_lose_nothing_with_and_without_tiles(spark):
    fps = sorted({*chains(2, 300), 0, (1 << 64) - 1})
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3}
    for tile in (2048, 2):
        got = [tuple(r) for r in simhash.links(df, tile=tile).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (150, 300)]
    got = {r.v: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys((100, 150, 200, 300), 100)}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(8)
    words = [f"word{k}" for k in range(500)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(25)]
    for _ in range(40):
        w = rng.choice(texts).split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += ["", " \n", "one", texts[0]]
    order = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame([*zip(order, texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    own = brute_components(fps)
    for i, d in enumerate(order):
        assert int(got[d].fingerprint, 16) == fps[i]
        assert got[d].component_id == min(order[j] for j in range(len(texts)) if own[j] == own[i])
    kept = simhash.one_each(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({got[d].component_id for d in order})


def test_near_duplicates_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2}
    assert {r.component_id for r in rows if r.doc_id in (1, 5)} == {1}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0
    plain = docs.toDF(*docs.columns[:5], "other", "score", "block")
    kept = simhash.one_each(plain).collect()
    assert sorted((r.doc_id is not None, r.doc_id) for r in kept)[0] == (False, None) and sum(r.doc_id == 5 for r in kept) == 0


def brute_jump(key, n):
    b, j = -1, 0
    key %= 1 << 64
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = math.floor((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_matches_the_published_loop(spark):
    rng = random.Random(9)
    keys = [0, 1, -1, (1 << 63) - 1, -(1 << 63), *(signed(rng.getrandbits(64)) for _ in range(300))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 40, 41):
        got = {r.k: r.s for r in df.select("k", shard.jump_hash(df.k, n).alias("s")).collect()}
        assert all(got[k] == brute_jump(k, n) for k in keys)
        last = {r.k: r.s for r in df.select("k", shard.jumps(df.k, n).alias("s")).collect()}
        assert all((n if last[k].j == n else last[k].b) == brute_jump(k, n + 1) for k in keys)


def test_shards_of_odd_rows(spark):
    import zlib

    docs = odd_docs(spark)
    rows = shard.assign(docs, shards=3).collect()
    assert len(rows) == docs.count()
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    texts = {r[0]: r[1] for r in docs.collect()}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.shard == brute_jump(-1 if r.doc_id is None else r.doc_id, 3)
        assert r.grown_shard in (r.shard, 3)
    assert shard.assign(empty_docs(spark)).count() == 0


def test_slots_of_a_hot_id(spark):
    docs = spark.range(2000).selectExpr("CAST(IF(id % 3 = 0, 7, id) AS long) AS doc_id", "CAST(id % 5 AS string) AS text")
    rows = shard.assign(docs, shards=4).collect()
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_recall_of_additive_quantisation(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = ann.nearest(e, e.where("vec_id % 100 = 0"), k=10, train=2000).collect()
    assert len(rows) == 300
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        true = set(np.argsort(d)[:10].tolist())
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-9 for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hits += len(true & {r.vec_id for r in mine})
    assert hits / 300 >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 0.5]), (7, [1.0, 0.5]), (None, [1.0, 0.1]), (8, [1.0, 2.0, 3.0]), (9, []), (6, [1.0, 0.5])]
    e = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, codes string")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(e, e.where("vec_id IN (0, 1, 2, 8)")).collect()]
    assert sorted(got) == [(0, 1, 6), (0, 2, 7)]
    assert ann.nearest(e.limit(0), e.limit(0)).count() == 0


ARTICLE = "".join(f"<p>{PROSE}</p>" for _ in range(4))
WANT = "\n".join([PROSE.strip()] * 4)


def test_article_is_found_among_boilerplate():
    menu = "<ul>" + "".join(f'<li><a href="/{k}">Item {k}</a></li>' for k in range(12)) + "</ul>"
    page = f"<html><head><title>T &amp; t</title><style>p{{}}</style></head><body><header>Site</header><div class='x'>{menu}</div><div class='sidebar'><p>{PROSE}</p></div><div id='main'><h1>A &lt; B</h1>{ARTICLE}<div class='comments'><p>{PROSE * 9}</p></div></div><div class='cookie-notice'>We use cookies</div><form><p>Sign up</p></form><footer>(c)</footer></body></html>"
    assert html.extract(page) == "A < B\n" + WANT
    assert html.extract(f"<body><nav>{menu}</nav><article><h1>H</h1>{ARTICLE}<aside>{PROSE}</aside></article>") == "H\n" + WANT


def test_broken_pages():
    assert html.extract("") == html.extract("  \n") == html.extract("<script>var a = '<p>x</p>'</script>") == ""
    assert html.extract("just text &amp; more") == "just text & more"
    assert html.extract("<p>a<br>b\n  c<p>d<!-- x --><script>no()") == "a b c\nd"
    assert html.extract("<p>" * 3000 + "deep") == "deep"
    assert html.extract("<div>" * 3000 + "deep") == "deep"
    assert unescape("&copy;") in html.extract("<article><p>&copy; &#65; &nosuch; 1 < 2</p></article>")


def test_pages_of_odd_rows(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "c"), (2, None, None, "c"), (None, "u", "", "c"), (1, "u", f"<article>{ARTICLE}</article>", "c"), (3, "v", "<p>" + "long word " * 50_000, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.main_text(pages).collect()
    assert len(got) == 5 and sum(r.text == WANT for r in got) == 2 and sum(r.n_chars == 0 for r in got) == 2
    assert max(r.n_chars for r in got) == len(("long word " * 50_000).strip())
    assert html.main_text(pages.limit(0)).count() == 0


def test_text_in_several_sections_is_kept_whole():
    body = ["".join(f"<p>{PROSE} {k}{j}</p>" for j in range(5)) for k in range(2)]
    want = [f"{PROSE.strip()} {k}{j}" for k in range(2) for j in range(5)]
    links = "<ul>" + "".join(f'<li><a href="/{k}">Item {k}</a></li>' for k in range(12)) + "</ul>"
    page = f"<html><body><div>{links}</div><div><h1>H</h1><section><h2>A</h2>{body[0]}</section><section><h2>B</h2>{body[1]}</section></div></body></html>"
    assert html.extract(page).split("\n") == ["H", "A", *want[:5], "B", *want[5:]]
    assert html.extract(f"<body><div>{body[0]}</div><div>{body[1]}</div></body>").split("\n") == want


def test_names_do_not_cut_the_article():
    for wrapper in ("class='content with-sidebar'", "id='post' class='comments-open'", "class='share'", "data-id='share'", "title='The hidden lake'", "data-x='class=ads'"):
        assert html.extract(f"<body><div {wrapper}>{ARTICLE}</div><div class='sidebar'>Other</div></body>") == WANT, wrapper
    kept = html.extract(f"<article>{ARTICLE}<p title='The hidden lake'>One</p><p><a href='/hidden-valley'>Two</a> <b href=/hidden>three</b></p><p hidden>no</p><p class='x ads'>no</p><p CLASS=ad-slot>no</p><p style='display: none'>no</p></article>")
    assert kept == WANT + "\nOne\nTwo three"


def test_equal_vectors_tie_to_the_smaller_id(spark):
    rng = np.random.default_rng(3)
    other = [(i, rng.normal(size=4).tolist()) for i in range(1000, 1300)]
    rows = [(int(i), [1.0, 0.5, 0.25, 2.0]) for i in rng.permutation(400)] + other + [(5000, [1.0, 0.5, 0.25, 2.1])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = sorted((r["rank"], r.vec_id) for r in ann.nearest(e, e.where("vec_id = 5000")).collect())
    assert got == [(k + 1, k) for k in range(10)]


def test_attributes_are_parsed_and_forms_unwrapped():
    wrappers = ["<div class='content has-sidebar'>", "<div class='single with-comments'>", "<div class='layout no-sidebar'>", "<div class='social-science'>", "<form action='/x'>", "<div data-hidden='false'>", "<div data-role='header-less'>", "<div title='the hidden valley'>", '<div class=a">', "<div class='a'b>", "<div a='>'>", "<div a=b=c'>", "<div =x>"]
    for w in wrappers:
        end = w[1:].split()[0]
        assert html.extract(f"<body><div class='menu'><a href='/x'>x</a></div>{w}{ARTICLE}</{end}><form><p>Sign up</p><input></form></body>") == WANT, w


def test_deep_pages_take_linear_time():
    import time

    for part in ("<b>", "<div>", "<p><b>", "<ul><li>", "<dl><dd>"):
        times = []
        for n in (5_000, 50_000):
            began = time.perf_counter()
            assert html.extract(part * n + "deep") == "deep"
            times.append(time.perf_counter() - began)
        assert times[1] < 40 * times[0] + 0.5, (part, times)


def brute_measure(x, share):
    """Characters, tags, link characters, link tags, density and sum of a node, by recursion from the definition."""
    kids = [k for k in x.kids if not isinstance(k, str) and not k.cut]
    below = [brute_measure(k, share) for k in kids]
    c = sum(len(k.strip()) for k in x.kids if isinstance(k, str)) + sum(b[0] for b in below)
    t = sum(b[1] + 1 for b in below)
    lc = c if x.name == "a" else sum(b[2] for b in below)
    lt = sum(b[3] + (k.name == "a") for b, k in zip(below, kids))
    density = 0.0
    if c:
        density = c / max(1, t) * max(0.0, math.log(c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(c / max(1, c - lc) * lc + share * c + math.e)
    total = sum(b[4] for b in below) if below else density
    assert (x.chars, x.tags, x.link_chars, x.link_tags) == (c, t, lc, lt) and math.isclose(x.density, density, abs_tol=1e-12) and math.isclose(x.total, total, abs_tol=1e-9)
    return c, t, lc, lt, density


def test_densities_and_sums_match_the_definition():
    rng = random.Random(12)

    def tree(depth):
        name = rng.choice(["div", "p", "a", "b", "section", "ul", "span"])
        inner = "".join(rng.choice(["some words ", "x", tree(depth - 1) if depth else "end"]) for _ in range(rng.randint(0, 4)))
        return f"<{name}>{inner}</{name}>"

    for _ in range(200):
        root = html.parse("<body>" + "".join(tree(4) for _ in range(4)) + "</body>")
        body = html.measure(root)
        brute_measure(body, body.link_chars / max(1, body.chars))


def test_string_ids_are_sharded_by_their_text(spark):
    docs = spark.createDataFrame([("a-1", "x"), ("b", "y"), (None, "z"), ("a-1", "x")], "doc_id string, text string")
    rows = shard.assign(docs, shards=5).collect()
    assert len(rows) == 4 and len({r.shard for r in rows if r.doc_id == "a-1"}) == 1
    assert all(r.grown_shard in (r.shard, 5) for r in rows) and {r.shard for r in rows if r.doc_id is None} == {brute_jump(-1, 5)}


def test_hot_fingerprints_and_stars(spark):
    texts = [(i, "") for i in range(3000)] + [(5000 + i, PROSE * 2) for i in range(2500)] + [(9000 + i, f"w{i} w{i * 7} w{i * 11} other") for i in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    fps = {t: brute_fingerprint(t) for _, t in texts}
    names = sorted(fps)
    own = brute_components([fps[t] for t in names])
    least = {}
    for i, t in texts:
        least[own[names.index(t)]] = min(least.get(own[names.index(t)], i), i)
    assert got == {i: least[own[names.index(t)]] for i, t in texts}
    edges = spark.createDataFrame([(i, 5000) for i in range(4000)] + [(7000, 7001)], "u long, v long")
    roots = {r.v: r.root for r in simhash.components(edges).collect()}
    assert roots == {**dict.fromkeys([*range(4000), 5000], 0), 7000: 7000, 7001: 7000}


def test_recall_at_production_settings_over_several_blocks(spark):
    few = np.stack(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()["embedding"].to_numpy())
    rng = np.random.default_rng(2)
    x = np.concatenate([few + rng.normal(scale=0.3 * few.std() * (k > 0), size=few.shape) for k in range(6)]).astype(np.float32).astype(np.float64)
    ids = np.arange(len(x))
    assert len(ids) > 2 * 4096
    e = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in ann.nearest(e, e.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in got:
        d = ((x - x[ids == q][0]) ** 2).sum(1)
        d[ids == q] = np.inf
        hits += len(got[q] & set(ids[np.argsort(d)[:10]].tolist()))
    assert len(got) == (ids % 100 == 0).sum() and hits >= 0.95 * 10 * len(got)
