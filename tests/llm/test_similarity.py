"""SimHash, byte-string dedup, top-k search, URL filter, quality and language-model scores against plain Python."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docsieve.llm import gru, lm_score, quality, simhash, suffix_dedup, topk, url_filter
from docsieve.llm.graph import components
from tests.llm.conftest import ODD


def slow_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(nodes, near):
    """The least member of each node's component."""
    label = {n: n for n in nodes}
    again = True
    while again:
        again = False
        for a in nodes:
            for b in nodes:
                if near(a, b) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    again = True
    return label


def slow_simhash(rows):
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    label = closure({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, p in prints:
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    return sorted(((i, f"{p:016x}", least.get(label[p])) for i, p in prints), key=repr)


def test_simhash_matches_brute_force(documents):
    rng = random.Random(2)
    base = [[f"v{rng.randrange(500)}" for _ in range(rng.randint(1, 400))] for _ in range(12)]
    rows = []
    for i in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "edit"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, t) for i, (_, t) in enumerate(ODD) if t != "word " * 30_000]
    got = sorted((tuple(r) for r in simhash.simhash(documents(rows)).collect()), key=repr)
    assert got == slow_simhash(rows)
    assert len({c for _, _, c in got}) < len({f for _, f, _ in got})


def test_simhash_of_odd_rows(odd, clashing, documents):
    want = slow_simhash(ODD)
    for df in (odd, clashing):
        assert sorted((tuple(r) for r in simhash.simhash(df).collect()), key=repr) == want
        kept = simhash.keep_first(df)
        assert kept.columns == df.columns and kept.count() == len({c if c is not None else f for _, f, c in want})
    assert simhash.simhash(documents([])).count() == 0


@pytest.mark.parametrize("group_rows", [2048, 3])
def test_near_components_with_large_groups(spark, group_rows):
    """Dense clusters, cut again when a group is larger than allowed."""
    rng = random.Random(9)
    codes = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            code = centre
            for _ in range(rng.randint(0, 3)):
                code ^= 1 << rng.randrange(64)
            codes.add(code)
    codes |= {rng.getrandbits(64) for _ in range(60)}
    signed = {c - (1 << 64) if c >> 63 else c for c in codes}
    want = closure(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    got = {r["fp"]: r["root"] for r in simhash.near_components(df, 2, group_rows).collect()}
    assert {c: got.get(c, c) for c in signed} == want


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 501), (501, 500), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, 501: 500}


def slow_suffix(rows, length=100):
    seen, result, known = set(), [], {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        if (i, raw) in known:
            result.append(known[i, raw])
            continue
        mark = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                mark[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, m in zip(raw, mark, strict=True) if not m)
        spans = sum(1 for j, m in enumerate(mark) if m and (j == 0 or not mark[j - 1]))
        known[i, raw] = (i, len(raw), sum(mark), spans, hashlib.sha256(kept).hexdigest())
        result.append(known[i, raw])
    return sorted(result, key=repr)


def shared_passages(seed):
    rng = random.Random(seed)
    passage = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(60, 400))) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = ["".join(rng.choice("abcdefgh \n") for _ in range(rng.randint(0, 200))) if rng.random() < 0.6 else rng.choice(passage) for _ in range(5)]
        rows.append((i, "".join(parts)))
    return [*rows, (70, "xy" * 400), (71, "xy" * 60), (72, "z" * 99), (73, "z" * 100), (74, rows[3][1]), (75, rows[4][1][5:])]


@pytest.mark.parametrize("chunk_bytes", [2_000, 1 << 22])
def test_suffix_dedup_matches_brute_force(documents, chunk_bytes):
    rows = shared_passages(chunk_bytes)
    got = suffix_dedup.suffix_dedup(documents(rows), chunk_bytes=chunk_bytes).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == slow_suffix(rows)


def test_suffix_dedup_of_odd_rows(odd, clashing, documents):
    want = slow_suffix(ODD)
    for df in (odd, clashing):
        got = suffix_dedup.suffix_dedup(df, with_text=True)
        assert sorted((tuple(r) for r in got.drop("kept").collect()), key=repr) == want
        assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got.collect())
    assert suffix_dedup.suffix_dedup(documents([])).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(odd, length=20)


def test_suffix_texts_are_shuffled_once(spark, small):
    df = suffix_dedup.suffix_dedup(spark.read.parquet(f"{small}/documents.parquet"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"\bScan parquet|FileScan parquet", plan)) - plan.count("ReusedExchange") <= 1


def test_suffix_order_is_sorted():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(97, 99, 3000, dtype=np.uint8)] * 2)
    order = suffix_dedup.suffix_order(text, suffix_dedup._words(text), 100)
    keys = [text[i : i + 100].tobytes() for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(len(text)))


VECTORS = "vec_id long, embedding array<float>"


def slow_top(rows, asks, k=5):
    usable = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    result = []
    for q in filter(asks, usable):
        scores = sorted((-sum(a * b for a, b in zip(usable[q], v, strict=True)), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
        result += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(result)


@pytest.mark.parametrize("shard_rows", [16_384, 40])
def test_top_k_matches_brute_force(spark, shard_rows):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).round(1).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(120)]  # copies and so ties
    rows += [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, []), (905, [1.0, 2.0]), (910, [3.0, 1.0]), (None, rows[0][1])]
    df = spark.createDataFrame([*rows, rows[20]], VECTORS).withColumn("shard", F.lit("x"))
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, shard_rows=shard_rows).collect()
    assert sorted(map(tuple, got)) == slow_top(rows, lambda i: i % 10 == 0)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], VECTORS)
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 131072)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_ball_tree_leaves_leaves_out():
    """Branch and bound visits few leaves where points are clustered."""
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.integers(-20, 20, (500, 6)) + 1000 * rng.integers(-3, 4, 6) for _ in range(40)])
    shard = topk.Shard(np.arange(len(points)), points, 6)
    visits = []
    visit = shard._visit
    shard._visit = lambda leaf, *rest: (visits.append(leaf), visit(leaf, *rest))
    list(shard.search(points[:1], np.array([0]), np.array([-np.inf]), 5))
    assert len(visits) < sum(c is None for c in shard.tree.child) / 4


PAGES = "page_id long, url string, html string"


def test_url_parts_and_rules(spark):
    cases = [
        ("http://Example.NET/en/1", "example.net", "/en/1", "example.net/en/", "allow"), ("http://a.b.net/x?y#z", "a.b.net", "/x", "net/", "block"),
        ("https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), ("https://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
        ("https://x.net", "x.net", "", None, None), ("nothing", "", "", None, None), (None, "", "", None, None),
        ("a://notexample.net/en/", "notexample.net", "/en/", "net/", "block"), ("q?a://h.com/p", "h.com", "/p", None, None),
        ("http://x.com#frag/ment", "x.com", "", None, None), ("http://net/", "net", "/", "net/", "block"),
    ]
    df = spark.createDataFrame([(i, c[0], "<p>some words here</p>") for i, c in enumerate(cases)], PAGES)
    rows = url_filter.url_filter(df).orderBy("page_id").collect()
    for row, (_, host, path, rule, verdict) in zip(rows, cases, strict=True):
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == verdict or verdict is None and row["verdict"] in ("allow", "block")


def test_url_words_decide(spark):
    """Blocked and allowed sites share no words, so the others are told apart by the words run together in their names."""
    words = "<p>" + "casino bonus poker garden flower tulip " * 20 + "<script>tulipbonus</script></p>"
    urls = [f"http://casinobonus{i}.net/poker" for i in range(20)] + [f"http://gardenflower{i}.org/fr/tulip" for i in range(20)]
    urls += ["http://pokerbonus.com/casino", "http://flowergarden.com/tulip", None, "x"]
    df = spark.createDataFrame([(i, u, words) for i, u in enumerate(urls)], PAGES).withColumn("word", F.lit(1))
    rows = url_filter.url_filter(df).orderBy("page_id").collect()
    assert [r["verdict"] for r in rows] == ["block"] * 20 + ["allow"] * 20 + ["block", "allow", "allow", "allow"]
    assert url_filter.url_filter(df.limit(0)).count() == 0


def test_segmentation_is_the_best_one(spark):
    long = "donaudampfschifffahrtsgesellschaften"
    counts = {"the": 50, "cat": 9, "sat": 8, "thecat": 1, "on": 20, "cats": 2, "at": 15, long: 3}
    total, unknown = sum(counts.values()), 2 * math.log(sum(counts.values()))

    def cost(parts):
        return sum(-math.log(counts[p] / total) if p in counts else unknown if len(p) == 1 else math.inf for p in parts)

    @functools.cache
    def best(name):
        if not name:
            return 0.0
        return min(cost([name[:k]]) + best(name[k:]) for k in range(1, len(name) + 1))

    names = ["thecatsat", "thecatsatonthecats", "zcat", "q", "onat", f"the{long}cat", long[:-1]]
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = url_filter.segment_names(spark.createDataFrame([(n,) for n in names], "name string"), table).collect()
    for r in rows:
        assert "".join(r["words"]) == r["name"]
        assert cost(r["words"]) == pytest.approx(best(r["name"]))
    assert len(rows) == len(names)
    assert next(r["words"] for r in rows if r["name"] == f"the{long}cat") == ["the", long, "cat"]


def test_url_verdicts_match_plain_naive_bayes(spark):
    """Scores and verdicts of all urls from counts in plain Python, given the split of every name."""
    rng = random.Random(12)
    texts = ["red blue green apple pear", "apple stone river red", "river river pear blue " + "longword" * 5]
    host = lambda: "".join(rng.choice(["red", "blue", "apple", "river", "stone", "xq"]) for _ in range(rng.randint(1, 3)))
    ends = ["net", "org/fr", "com", "example.com/de", "info"]
    urls = [f"http://{host()}.{rng.choice(ends)}/{host()}/{rng.randrange(50)}".replace(".example", "-x.example") for _ in range(150)] + [None]
    df = spark.createDataFrame([(i, u, f"<p>{texts[i % 3]}</p>") for i, u in enumerate(urls)], PAGES)
    rows = url_filter.url_filter(df).orderBy("page_id").collect()
    counts = collections.Counter(w for i in range(len(urls)) for w in texts[i % 3].split())
    bags = [[n for n in re.split(r"[^a-z0]+", re.sub(r"[0-9]+", ".0.", f"{r['host']}/{r['path']}".lower())) if n] for r in rows]
    names = spark.createDataFrame([(n,) for n in {n for b in bags for n in b}], "name string")
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    split = {r["name"]: r["words"] for r in url_filter.segment_names(names, table).collect()}
    seen = {"block": collections.Counter(), "allow": collections.Counter()}
    for r, bag in zip(rows, bags, strict=True):
        if r["rule"]:
            seen[r["verdict"]].update(w for n in bag for w in split[n])
    size, total = len({w for words in split.values() for w in words}), {c: sum(k.values()) for c, k in seen.items()}
    ruled = collections.Counter(r["verdict"] for r in rows if r["rule"])
    odds = lambda w: math.log((seen["block"][w] + 1) / (total["block"] + size)) - math.log((seen["allow"][w] + 1) / (total["allow"] + size))
    judged = 0
    for r, bag in zip(rows, bags, strict=True):
        if not r["rule"]:
            want = sum(odds(w) for n in bag for w in split[n]) + math.log((ruled["block"] + 1) / (ruled["allow"] + 1))
            assert r["score"] == pytest.approx(want, abs=1e-8) and r["verdict"] == ("block" if want > 0 else "allow")
            judged += 1
    assert judged > 30 and min(ruled.values()) > 10


def labelled(rng, n):
    good = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(good) for _ in range(rng.randint(20, 80))]
        bad, toxic = rng.random() < 0.2, rng.random() < 0.2
        if bad:
            words = [w + rng.choice(["%%%", "***", "&&&"]) for w in words]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["rotten", "vile"])
        docs.append((i, " ".join(words), "en", f"site{i % 7}"))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_quality_on_held_out_rows(spark, documents):
    docs, labels = labelled(random.Random(1), 900)
    known = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.quality(documents(docs), known).collect()}
    wrong = [i for i, q, t in labels[600:] if rows[i]["keep"] != (q == 1 and t == 0)]
    assert len(rows) == 900 and len(wrong) <= 6
    kept = quality.keep_good(documents(docs), known)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["keep"]}


def test_site_posteriors_shrink(spark):
    """A bad host pulls its documents down; a host with one document hardly moves."""
    rows = [(i, 0, "good", "a", 1.0) for i in range(200)] + [(i, 0, "bad", "a", -1.0) for i in range(200)] + [(1, 0, "tiny", "a", -1.0)]
    sites, mean = quality.site_posteriors(spark.createDataFrame(rows, "doc_id long, version long, host string, path string, own double"))
    site = {r["host"]: r["site"] for r in sites.collect()}
    assert site["bad"] < site["tiny"] < mean + 0.01 < site["good"]
    assert abs(site["bad"] - 1 / (1 + math.e)) < 0.02


def test_quality_of_odd_rows(spark, odd, clashing, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    partial = spark.createDataFrame([(1, None, None), (6, 1, None), (7, 1, 0), (999, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for df in (odd, clashing):
        for labels in (none, partial):
            rows = quality.quality(df, labels).collect()
            assert len(rows) == len(ODD) and all(r["keep"] for r in rows)
            kept = quality.keep_good(df, labels)
            assert kept.count() == len(ODD) and kept.columns == df.columns
    assert quality.quality(documents([]), none).count() == 0


def slow_base(rows):
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            counts.update((t or "").encode().lower().split())
            counts[None] += 1
    n, v, result = sum(counts.values()), len(counts), []
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), None]
        held = zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
        result.append((i, held, len(words), sum(counts[w] > 0 for w in words), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 6)))
    return sorted(result, key=repr)


@pytest.mark.parametrize("known", [65_536, 5])
def test_base_scores_match_brute_force(documents, clashing, known):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["Aa", "b", "c", "d", "e", "f", f"x{i}"]) for _ in range(rng.randint(0, 30)))) for i in range(80)] + ODD
    for df in (documents(rows), clashing):
        own = rows if df is not clashing else ODD
        got = lm_score.lm_scores(df, known=known, share=9, buckets=3, rounds=2).collect()
        assert sorted(((*r[:5], round(r["base_score"], 6)) for r in got), key=repr) == slow_base(own)
    assert lm_score.lm_scores(documents([])).count() == 0


def test_untrained_network_is_the_base(documents):
    rows = [(i, f"a b c d{i} e{i % 3} " * (i % 5)) for i in range(40)]
    df = documents(rows)
    for known in (3, 1_000):
        for r in lm_score.lm_scores(df, known=known, share=12, buckets=1, rounds=0).collect():
            assert r["score"] == pytest.approx(r["base_score"], rel=1e-4)


def test_network_covers_unknown_words(documents):
    """Over all words of the counts and one unseen word of each hash class, the probabilities after a start add to one."""
    rows = [(i, f"a b c d{i} e{i % 3} " * (i % 5)) for i in range(40)]
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*t.encode().split(), lm_score.END])
    weights = np.zeros(4, dtype=np.int64)
    for w, n in counts.items():
        weights[zlib.crc32(w) % 4] += n + 1
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    lexicon = lm_score.Lexicon(top, sum(counts.values()), len(counts), 20, weights)
    assert lexicon.size == sum(n * 20 >= sum(counts.values()) for n in counts.values()) > 2
    inside = Counter()
    for w, n in top:
        i = int(lexicon.network_ids[lexicon.ids[w]])
        inside[i] += 1 if i < lexicon.size else (n + 1) / 10 ** lexicon.log_weights[i]
    for i in range(lexicon.size, lexicon.size + 4):
        inside[i] += 1 / 10 ** lexicon.log_weights[i]
    assert all(v == pytest.approx(1) for v in inside.values())


def test_scores_do_not_depend_on_files(documents):
    rng = random.Random(5)
    df = documents([(i, " ".join(rng.choice("abcdefgh") + "x" * (i % 3) for _ in range(60))) for i in range(120)])
    by_files = []
    for n in (1, 4, 32):
        got = lm_score.lm_scores(df.repartition(n), share=100, buckets=4, rounds=2, learner=500).collect()
        by_files.append([x for _, x in sorted((r["doc_id"], r["score"]) for r in got)])
    assert by_files[0] == pytest.approx(by_files[1], rel=1e-4) and by_files[0] == pytest.approx(by_files[2], rel=1e-4)


def test_network_learns_order(documents):
    """Words follow each other in a ring, which counts alone cannot see."""
    ring = [f"r{i}" for i in range(12)]
    rng = random.Random(3)
    rows = []
    for i in range(300):
        at = rng.randrange(12)
        rows.append((i, " ".join(ring[(at + k) % 12] for k in range(40))))
    got = lm_score.lm_scores(documents(rows), rounds=3).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.8 * got[1]


def test_gradients():
    """Backpropagation inside one window against differences."""
    rng = np.random.default_rng(0)
    net = gru.Network.untrained(rng.integers(1, 50, 70).astype(float), hidden=4)
    for name in gru.Network.NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.to_class += rng.standard_normal(net.to_class.shape) * 0.1
    texts = [rng.integers(0, 70, n) for n in (5, 9, 7)]
    args = gru.lanes(texts, 2, net.start)
    before = net.flat().astype(np.float64)

    def loss(flat):
        return -gru.score(net.like(flat), texts, 2, 64).sum() / args[1].size

    seen = {}
    trainer = gru.Trainer(net)
    trainer._step = lambda name, gradient, rows=None: seen.__setitem__(name, (gradient, rows))
    trainer._window(args[0], args[1], args[2] >= 0, args[3], np.zeros((args[0].shape[1], 4)))
    at = 0
    for name in gru.Network.NAMES:
        own, (gradient, rows) = getattr(net, name), seen[name]
        full = np.zeros(own.shape)
        full[rows if rows is not None else slice(None)] = gradient
        for place in rng.choice(own.size, min(own.size, 12), replace=False):
            step = np.zeros_like(before)
            step[at + place] = 5e-2
            slope = (loss(before + step) - loss(before - step)) / 1e-1
            assert full.ravel()[place] == pytest.approx(slope, abs=3e-4, rel=0.05), name
        at += own.size


def test_state_is_carried_across_windows():
    rng = np.random.default_rng(0)
    net = gru.Network.untrained(np.arange(100, 0, -1.0))
    net.to_class += rng.standard_normal(net.to_class.shape).astype(np.float32)
    texts = [rng.integers(0, 100, n) for n in (3, 200, 1, 77, 130)]
    whole = gru.score(net, texts, width=1, window=10_000)
    assert gru.score(net, texts, width=3, window=7) == pytest.approx(whole, rel=1e-5)


def test_average_is_weighted(spark):
    rows = [(float(t), np.full(3, t, dtype=np.float16).tobytes(), np.full(2, 2 * t, dtype=np.float32).tobytes()) for t in range(1, 101)]
    df = spark.createDataFrame(rows, lm_score.CHANGE).repartition(100)
    change, sums = lm_score.average(df, 100)
    wanted = sum(t * t for t in range(1, 101)) / 5050
    assert change == pytest.approx(wanted, rel=2e-3) and sums == pytest.approx(2 * wanted)
    assert lm_score.average(df.limit(0), 0) is None
