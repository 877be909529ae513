import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import pii, quality, toxicity
from lodestone.llm.lm import LADDER, Batch, Starts, answers, flags_of, own_phrases, ranked, relative_entropy, score, symbols
from tests.llm.cases import PROSE, empty_docs, odd_docs

EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m.group())
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
        if 14 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= sum(c.isdigit() for c in m.group()) <= 15])


def test_base_spans_are_those_of_the_expressions():
    rng = random.Random(3)
    texts = ["".join(rng.choices("0123456789012 .-+@ab()é1279", k=rng.randint(0, 80))) for _ in range(15000)]
    for t in [*texts, "x" * 50 + "4111 1111 1111 1111", "1" * 5000, "a@" * 500, "+1 " * 300]:
        assert [s for s in pii.find(t) if s[1] < 4] == brute_spans(t), t


def test_anchors_add_urls_and_accounts():
    t = "See https://a.example.org/x?y=1. IBAN DE89 3704 0044 0532 0130 00 and account no 12345678, but my account is fine"
    kinds = [(pii.KINDS[k], t[a:b]) for a, k, b in pii.find(t) if k >= 4]
    assert kinds == [("url", "https://a.example.org/x?y=1"), ("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678")]
    assert pii.redact("mail a@b.co.uk now") == "mail [EMAIL] now"
    assert pii.redact(PROSE) == PROSE


def test_detection_and_redaction_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = pii.detect(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r for r in rows}
    assert (got[8].n_email, got[8].n_ip, got[8].n_card, got[8].n_phone) == (1, 1, 1, 1)
    assert got[2].spans == got[3].spans == "" and got[None].n_email == 1
    assert pii.detect(empty_docs(spark)).count() == 0
    plain = docs.drop("TEXT") if spark.conf.get("spark.sql.caseSensitive") == "true" else docs.toDF(*docs.columns[:5], "other", "score", "block")
    clean = pii.redacted(plain).collect()
    assert [r.text for r in clean if r.doc_id == 2] == [None] and "[CARD]" in [r.text for r in clean if r.doc_id == 8][0]


def brute_features(t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_features_match_brute_force():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["a", "b", "cé", "#x", "\n", "\x0b", "\x1c", "d d\nd d\n"], k=rng.randint(0, 40))) for _ in range(3000)]
    for t in [*texts, "", "a b c a b c", "x\n" * 5, "\x85 \x1c"]:
        f = quality.Features(t)
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == brute_features(t), repr(t)


def test_order_changes_time_not_the_verdict():
    texts = [PROSE * 3, "few words", "a b c " * 60, "x# " * 60, "LOUD WORDS HERE NOW " + " ".join(f"W{k}ORD" for k in range(90)), "same line of text here\n" * 20, "y" * 2000]
    orders = [quality.order_rules(texts), list(range(len(quality.RULES))), list(reversed(range(len(quality.RULES))))]
    kept = [[quality.verdict(quality.Features(t), o) is None for t in texts] for o in orders]
    assert kept[0] == kept[1] == kept[2] and sorted(orders[0]) == orders[1]
    varied = " ".join(f"word{k}" for k in range(70))
    assert quality.verdict(quality.Features(varied), orders[0]) is None


def test_a_rejected_text_needs_no_more_features():
    f = quality.Features("a b c " * 5)
    assert quality.verdict(f, [0, 1, 2, 3, 4, 5]) == "few_words" and "n_repeat_words" not in f.__dict__ and "n_upper" not in f.__dict__


def test_sample_is_of_all_rows(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "CAST(id AS string) AS text").coalesce(1)
    got = [int(t) for t in quality.sample_texts(docs, 256)]
    assert 150 < len(got) < 400 and min(got) < 2000 and max(got) > 18000
    assert quality.sample_texts(docs.limit(0)) == [] and len(quality.sample_texts(docs.limit(5))) == 5


def test_quality_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = quality.assess(docs).collect()
    assert len(rows) == docs.count() and all(not r.kept or not r.base_failed for r in rows)
    assert {r.n_words for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert quality.assess(empty_docs(spark)).count() == 0
    renamed = docs.toDF(*docs.columns[:5], "other", "score", "block")
    assert quality.keep_good(renamed).columns == renamed.columns


def labelled(spark, n=240):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("aeioulnrst", k=6)) for _ in range(300)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(5, 200))
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["wretchling", "dungbrain"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_classifier_on_held_out_rows(spark):
    rows = labelled(spark)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, per_class=100)
    truth = {r[0]: r[2] for r in rows}
    got = toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    odd = toxicity.score(odd_docs(spark), model).collect()
    assert len(odd) == odd_docs(spark).count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(empty_docs(spark), model).count() == 0


def brute_grams(text):
    t = f" {text.lower()} "
    t = "".join(" " if c <= " " else c for c in t)
    return {t[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)}


def test_features_are_the_n_grams_of_one_text():
    rng = random.Random(7)
    texts = ["".join(rng.choices("ab Cé\n😀", k=rng.randint(0, 40))) for _ in range(300)] + ["", "x", "abcd"]
    number = {}
    for t in texts:
        mine = set(toxicity.features_of([t])[1].tolist())
        assert len(brute_grams(t)) - 2 <= len(mine) <= len(brute_grams(t))  # two n-grams may have one hash
        number[t] = mine
    for order in (texts, texts[::-1]):
        text, feature = toxicity.features_of(order)
        for i, t in enumerate(order):
            assert set(feature[text == i].tolist()) == number[t]
    long = "".join(rng.choices("abcdef gh", k=3000))
    cut = [f for places, held in toxicity.pieces_of([long], 100) for f in held]
    assert set().union(*({p[i : i + n] for n in toxicity.ORDERS for i in range(len(p) - n + 1)} for p in cut)) == brute_grams(long)


def test_scores_do_not_depend_on_neighbours(spark):
    rows = labelled(spark)
    texts = [r[1] for r in rows]
    scorer = toxicity.fit_texts(texts, np.array([r[2] for r in rows])).scorer()
    together = scorer(texts)
    assert (together == scorer(texts[::-1])[::-1]).all()
    assert all(together[i] == scorer([texts[i]])[0] for i in range(0, len(texts), 7))


def test_weights_are_scaled_by_log_count_ratios():
    texts, y = ["good words here", "good words too", "good dogs here"] * 3 + ["vile words here", "vile dogs", "vile words"] * 3, np.array([0] * 9 + [1] * 9)
    model = toxicity.fit_texts(texts, y, steps=1)
    counts = [Counter(f for t, k in zip(texts, y) if k == label for f in toxicity.features_of([t])[1].tolist()) for label in (0, 1)]
    for h, w in zip(model.hashes.tolist(), model.weights):
        ratio = np.log((counts[1][h] + 1) / 11) - np.log((counts[0][h] + 1) / 11)
        assert counts[0][h] + counts[1][h] >= 3 and 0.01 * abs(ratio) < abs(w) < 0.05 * abs(ratio) and (w > 0) == (ratio > 0) or abs(w) <= 0.03 * abs(ratio)


def test_a_repeated_id_reaches_the_driver_once(spark):
    docs = spark.createDataFrame([(1, "a vile text"), (1, "a vile text, longer")] * 50 + [(i, "some good words") for i in range(2, 9)] + [(1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1)] * 3 + [(i, 1, 0) for i in range(2, 9)], "doc_id long, quality int, toxic int")
    seen = []
    real = toxicity.fit_texts
    toxicity.fit_texts = lambda texts, y, **o: seen.append((texts, y.tolist())) or real(texts, y, **o)
    try:
        toxicity.fit(docs, labels)
    finally:
        toxicity.fit_texts = real
    (texts, y), = seen
    assert texts.count("a vile text, longer") <= 1 and len(texts) == len(y) <= 8


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    row = toxicity.score(docs, toxicity.fit(docs, none)).first()
    assert row.predicted == 0 and 0 < row.score < 0.7
    assert np.isfinite(toxicity.fit_texts(["a"], np.array([1])).bias)


def brute_phrases(words, reference):
    """Greedy parse; a factor is known if all its windows of the longest length of the ladder in it are in a reference text."""
    known = {tuple(text[i : i + n]) for text in reference for n in LADDER for i in range(len(text) - n + 1)}

    def accepted(p):
        n = max(m for m in LADDER if m <= len(p))
        return all(tuple(p[i : i + n]) in known for i in range(len(p) - n + 1))

    i = count = 0
    while i < len(words):
        n = 1
        while i + n < len(words) and accepted(words[i : i + n + 1]):
            n += 1
        i += n
        count += 1
    return count


def exact_phrases(words, reference):
    texts = [" " + " ".join(t) + " " for t in reference]
    i = count = 0
    while i < len(words):
        n = 1
        while i + n < len(words) and any(" " + " ".join(words[i : i + n + 1]) + " " in t for t in texts):
            n += 1
        i += n
        count += 1
    return count


def brute_own(words):
    known, count, i = set(), 0, 0
    while i < len(words):
        n = 1
        while i + n <= len(words) and tuple(words[i : i + n]) in known:
            n += 1
        known.add(tuple(words[i : i + n]))
        count += 1
        i += n
    return count


def test_own_parse():
    for seed in range(200):
        words = random.Random(seed).choices("ab", k=seed % 40)
        assert own_phrases(words) == brute_own(words)
    assert relative_entropy(0, 0, 0) is None


def lm_rows():
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(12)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(60)]
    rows += [(60 + k, rows[k][1]) for k in range(0, 8)] + [(70, rows[2][1] + " xq xq zz " + rows[4][1]), (71, "xq xq zz xq yy " * 12)]
    return rows


def test_scores_against_all_good_text_but_the_own(spark):
    rows = lm_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = {i for i, _ in rows if i % 2 == 0 and i < 66}
    labels = spark.createDataFrame([(i,) for i in good], "doc_id long")
    got = {r.doc_id: r for r in score(docs, labels).collect()}
    assert len(got) == len(rows)
    exact = mine = 0
    for i, text in rows:
        words, reference = symbols(text), [symbols(t) for j, t in rows if j in good and j != i]
        c, o = brute_phrases(words, reference), brute_own(words)
        assert (got[i].n_symbols, got[i].n_phrases, got[i].n_own_phrases) == (len(words), c, o), i
        assert not words or abs(got[i].score - relative_entropy(len(words), c, o)) < 1e-12
        exact, mine = exact + exact_phrases(words, reference), mine + c
    assert mine <= exact <= 1.02 * mine
    assert got[71].score > max(r.score or -9 for k, r in got.items() if k < 60)
    # many batches and shards, other rows, another order and other partitions change nothing
    other = spark.createDataFrame([(1000 + i, f"z{i} z{i + 1} z{i % 7}") for i in range(50)], docs.schema)
    for d, options in ((docs, {"batch": 50, "shard": 40}), (docs.union(other).repartition(3), {}), (docs.orderBy(F.desc("doc_id")).coalesce(1), {"batch": 300})):
        again = {r.doc_id: r for r in score(d, labels, **options).collect()}
        assert all(again[i] == got[i] for i in got)


def test_a_repeated_row_is_the_others_reference(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j")] * 2 + [(2, "k l m")], "doc_id long, text string")
    got = score(docs, docs.select("doc_id").distinct()).collect()
    assert sorted((r.doc_id, r.n_phrases) for r in got) == [(1, 1), (1, 1), (2, 3)]


def test_lm_scores_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = score(docs, docs.select("doc_id")).collect()
    assert len(rows) == docs.count()
    assert all(r.score is None for r in rows if r.doc_id in (2, 3, 4))
    assert score(empty_docs(spark), docs.select("doc_id")).count() == 0
    bare = score(docs, docs.select("doc_id").limit(0)).collect()
    assert all(r.n_phrases == r.n_symbols for r in bare)


def test_matches_of_every_length_are_exact(spark):
    """Overlapping windows that are known one by one, in different texts or places, are not a match."""
    rng = random.Random(9)
    rows = []

    def spliced(n, cut, part):  # all windows of ``part`` words but not the whole: two halves in different texts, ``part - 1`` words in both
        words = [f"s{len(rows)}_{k}" for k in range(n)]
        rows.append((len(rows), " ".join(words[: cut + part - 1]) + " x y"))
        rows.append((len(rows), "z z " + " ".join(words[cut:])))
        rows.append((1000 + len(rows), " ".join(words)))

    for n in (5, 6, 7, 8, 9, 12, 15, 16, 17, 31, 40, 65, 130):
        for part in (4, 8):
            if n > part:
                spliced(n, (n - part) // 2 + 1, part)
    source = [f"c{k}" for k in range(400)]
    for _ in range(60):  # citations of one text that begin and end anywhere, some in good texts
        a = rng.randrange(390)
        rows.append((rng.choice((0, 1000)) + len(rows), " ".join(source[a : a + rng.randint(3, 200)] + [f"t{len(rows)}"] + source[a // 2 : a // 2 + rng.randint(2, 40)])))
    for k in (5, 40, 41, 300):  # periods, and the same in good and other texts
        rows += [(len(rows), "p q r " * k), (1000 + len(rows), "q r p " * (k + 1) + "p p")]
    for k in range(20):
        rows.append((len(rows) + 1000 * (k % 2), " ".join(rng.choices("ab", k=60))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    good = spark.createDataFrame([(i,) for i, _ in rows if i < 1000], "doc_id long")
    want = {i: exact_phrases(symbols(t), [symbols(u) for j, u in rows if j < 1000 and j != i]) for i, t in rows}
    assert len(want) == len(rows)
    for options in ({}, {"batch": 700, "shard": 900}):
        got = {r.doc_id: r.n_phrases for r in score(docs, good, **options).collect()}
        assert got == want


def test_a_start_that_serves_no_one_asks_for_its_own_match_alone():
    rng = random.Random(4)
    source = [f"c{k}" for k in range(600)]
    texts = [[f"h{k}", *source[: rng.randint(20, 600)], f"t{k}"] for k in range(24)]
    good = np.arange(24) % 3 == 0
    numbers = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    hashes = np.random.default_rng(4).integers(0, 1 << 64, len(numbers), np.uint64)
    b = Batch(np.array([numbers[w] for t in texts for w in t], np.uint32), hashes, np.array([len(t) for t in texts]), good)
    known = np.concatenate([[False, *[True] * (len(t) - 5), *[False] * 4] for t in texts])
    starts = Starts.of(b, known, known, b.left == np.repeat(b.lengths, b.lengths) - 1)
    assert len(starts.start) == len(texts)
    while len(starts.start):
        stretch, length, found, which, owner, flags, held = starts.request()
        (code,), (sums,) = answers([found], [flags], None, [held])
        code, count, start = code[which], sums[which].astype(np.int64), starts.start[stretch]
        knows = (code & 1 > 0) | (code & 2 > 0) & (owner[which] != starts.text[start])
        starts.narrowed(stretch, length, knows, np.where(knows | starts.good[start] & (code & 4 > 0), count, 0))
        assert np.bincount(starts.start[~starts.good[starts.start]]).max(initial=0) <= 1
    assert starts.best.tolist() == [min(len(t), max(len(u) for j, u in enumerate(texts) if good[j] and j != k)) - 2 for k, t in enumerate(texts)]


def test_hashes_that_begin_alike_are_ranked_apart():
    rng = np.random.default_rng(5)
    for n, high in ((0, 9), (1, 9), (700, 5), (5000, 1 << 56)):
        h = rng.integers(0, high, n, np.uint64)
        h[n // 2 :] = (h[: n - n // 2] ^ np.uint64(1)) * np.uint64(n > 1)  # equal but for the last bit
        found, which = ranked(h)
        want = np.unique(h, return_inverse=True)
        assert found.tolist() == want[0].tolist() and which.tolist() == want[1].tolist()
