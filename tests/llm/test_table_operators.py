"""Operators that relate rows: URL rules, shards, nearest vectors, substring windows, the pipeline."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from knotwork.llm import onebit, sharding, substring, urlfilter
from knotwork.llm.queries import URL_RULES
from knotwork.llm.sketch import Sketch, cells, repeated

from .common import frame, rows

URLS = [None, "", "no scheme", "http://Example.COM/en/7x?q=1", "https://a.b.example.net/de/81#t", "https://a.net/de/", "http://badexample.com/fr/", "http://x.org/es/9", "http://org/es/", "ftp://c.com?x/en/", "http://c.com/en", "://d.com/en/a://b", "http://é.com/en/\n?"]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]


def rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_url_rules(spark):
    rng = random.Random(0)
    more = [f"http://{rng.choice(['w', 'm.x'])}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(9999)}" for _ in range(400)]
    data = list(enumerate([*URLS, *more, more[0]]))
    out = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(data, "page_id long, url string"), URL_RULES).collect()}
    assert len(out) == len(data)
    for i, url in data:
        host, path = parse(url)
        name, verdict = rule(host, path)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, name)
        assert out[i]["verdict"] == verdict if verdict else out[i]["verdict"] in ("allow", "block")
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


def test_url_model_is_the_witten_bell_mixture(spark):
    data = [("allow", "abab"), ("allow", "abc"), ("block", "bbba")]
    t = urlfilter.counts(spark.createDataFrame(data, "verdict string, rest string")).toPandas()
    model = urlfilter.Model(*(t[t["allow"]][c].to_numpy() for c in ("context", "symbol", "n")))
    counted = {}
    for _, s in data[:2]:
        b = [*s.encode(), 256]
        for k in range(len(b)):
            for order in range(min(k, urlfilter.ORDER) + 1):
                counted.setdefault(tuple(b[k - order : k]), Counter())[b[k]] += 1
            for order in range(k + 1, urlfilter.ORDER + 1):  # before the start
                counted.setdefault((-1,) * (order - k) + tuple(b[:k]), Counter())[b[k]] += 1

    def want(text):
        total, b = 0.0, [*text.encode(), 256]
        for k in range(len(b)):
            p = 1 / 257
            for order in range(urlfilter.ORDER + 1):
                c = tuple(b[k - order : k]) if order <= k else (-1,) * (order - k) + tuple(b[:k])
                if c in counted:
                    p = (counted[c][b[k]] + len(counted[c]) * p) / (sum(counted[c].values()) + len(counted[c]))
            total += np.log(p)
        return total

    for text in ("abab", "ba", "", "zzz"):
        raw = np.frombuffer(text.encode(), np.uint8)
        _, symbol, contexts = urlfilter._codes(raw, np.array([0, len(raw)]))
        assert np.isclose(model.log_likelihood(symbol, contexts).sum(), want(text))


def test_url_model_learns(spark):
    data = [(k, f"http://good{k % 7}.com/en/7{k}" if k % 2 else f"http://spam{k % 9}.com/en/{k % 6}") for k in range(600)]
    data += [(9001, "http://good3.info/"), (9002, "http://spam4.info/")]
    out = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame(data, "page_id long, url string"), [("block", "com", "/en/"), ("allow", "com", "/en/7")]).collect()}
    assert (out[9001], out[9002]) == ("allow", "block")


def test_urls_without_a_scheme_are_scored_by_their_characters(spark):
    data = [(k, f"http://good{k % 7}.com/en/7{k}" if k % 2 else f"http://spam{k % 9}.com/en/{k % 6}") for k in range(600)]
    data += [(9001, "good3.com/en/71"), (9002, "spam4.com/en/1"), (9003, None), (9004, "")]
    out = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(data, "page_id long, url string"), [("block", "com", "/en/"), ("allow", "com", "/en/7")]).collect()}
    assert (out[9001]["verdict"], out[9002]["verdict"]) == ("allow", "block")
    assert {(out[k]["host"], out[k]["path"], out[k]["rule"]) for k in range(9001, 9005)} == {("", "", None)}
    assert out[9003]["score"] == out[9004]["score"]


def test_url_scores_use_rare_contexts_of_a_large_class(spark):
    hot = [(k, f"http://host.com/en/{k % 10}aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa") for k in range(1500)]
    rare = [(2000 + k, f"http://q{k}zq{k * 7}.com/en/{k}") for k in range(40)]
    other = [(3000 + k, f"http://fine{k}.com/en/7{k}") for k in range(300)]
    asked = [(4000, "http://q3zq21.info/"), (4001, "http://fine5.info/"), (4002, None), (4003, "http://é\u2028.info/")]
    rules = [("block", "com", "/en/"), ("allow", "com", "/en/7")]
    data = hot + rare + other + asked
    d = spark.createDataFrame(data, "page_id long, url string")
    out = {r["page_id"]: r for r in urlfilter.judge(d, rules).collect()}
    assert sorted(out) == sorted(k for k, _ in data)
    rest = F.expr("coalesce(substr(url, instr(url, '://') + 3), '')").alias("rest")
    used = F.pmod(F.xxhash64("rest", F.lit("calibrate")), F.lit(urlfilter.CALIBRATE)) != 0
    verdict = F.when(F.col("url").contains(".com/en/7"), "allow").otherwise("block").alias("verdict")
    seen = [(r["verdict"] == "allow", r["rest"]) for r in d.where("page_id < 4000").select(verdict, rest).where(used).collect()]
    models = []
    for yes in (True, False):
        raw = [t.encode() for a, t in seen if a == yes]
        _, symbol, contexts = urlfilter._codes(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(t) for t in raw])))
        pair, n = np.unique(np.concatenate([c * 257 + symbol for c in contexts]), return_counts=True)
        models.append(urlfilter.Model(pair // 257, pair % 257, n))
    for k, url in data[::50] + rare + asked:
        raw = (url or "").split("://")[-1].encode()
        _, symbol, contexts = urlfilter._codes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        want = (models[0].log_likelihood(symbol, contexts) - models[1].log_likelihood(symbol, contexts)).sum() / (len(raw) + 1)
        assert np.isclose(out[k]["score"], want, rtol=1e-9, atol=1e-12), url


def test_verdicts_without_a_rule_by_brute_force(spark):
    """Threshold: of all cuts between bins the one that gets the largest share of both held-out classes right."""
    rng = random.Random(5)
    data = [(k, f"http://{rng.choice(['good', 'fine', 'mix'])}{rng.randrange(40)}.com/en/7{k}" if k % 2 else f"http://{rng.choice(['spam', 'junk', 'mix'])}{rng.randrange(40)}.com/en/{k % 6}") for k in range(1200)]
    data += [(5000 + k, f"http://{rng.choice(['good', 'spam', 'mix', 'junk'])}{rng.randrange(40)}.info/{'x' * (k % 50)}") for k in range(200)]
    data += [(9000, "http://" + "long" * 20_000 + ".info/")]
    d = spark.createDataFrame(data, "page_id long, url string")
    out = {r["page_id"]: r for r in urlfilter.judge(d, [("block", "com", "/en/"), ("allow", "com", "/en/7")]).collect()}
    rest = F.expr("coalesce(substr(url, instr(url, '://') + 3), '')")
    apart = {r[0] for r in d.where(F.pmod(F.xxhash64(rest, F.lit("calibrate")), F.lit(urlfilter.CALIBRATE)) == 0).select("page_id").collect()}
    held = [(out[k]["score"], out[k]["verdict"] == "allow") for k, _ in data[:1200] if k in apart]
    good, bad = [s for s, a in held if a], [s for s, a in held if not a]
    bins = {s: min(max(math.floor((s + 4) / 8 * 4000), 0), 3999) for s, _ in held}
    right = [sum(bins[s] >= b for s in good) / len(good) + sum(bins[s] < b for s in bad) / len(bad) for b in range(4001)]
    best = [b for b, v in enumerate(right) if v >= max(right) - 1e-12]
    cut = (best[0] + best[-1]) / 2 / 4000 * 8 - 4
    for k, _ in data[1200:]:
        assert out[k]["rule"] is None and out[k]["verdict"] == ("allow" if out[k]["score"] >= cut else "block")
    assert {out[k]["verdict"] for k, _ in data[1200:]} == {"allow", "block"}


def test_shards(spark):
    data = rows(7, 120)
    out = sharding.assign(frame(spark, data), 24).collect()
    text = {r[0]: r[1] for r in data}
    assert len(out) == len(data)
    slots = {}
    for r in out:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 24)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(frame(spark, []), 24).count() == 0


def shard_brute(key, n, weights=None):
    """The shard with the earliest time: every node's winning child has the node's time, the others come later."""

    def draw(name, w):
        h = xxhash.xxh64(name.encode(), seed=xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()).intdigest()
        return -math.log((h % (1 << 52) + 0.5) / (1 << 52)) / w

    def weight(first, size):
        return sum((weights or {}).get(s, 1.0) for s in range(first, first + size))

    def times(kind, first, size, step, time):
        places = [(s, f"{kind}{s // step}", weight(s, step)) for s in range(first, first + size, step)]
        won = min(places, key=lambda p: draw(p[1], p[2]))[0]
        return [(s, time if s == won else time + draw(f"{name}/later", w)) for s, name, w in places]

    found = []
    for region in range(0, n, sharding.REGION):
        time = draw(f"region{region // sharding.REGION}", weight(region, sharding.REGION))
        for rack, t in times("rack", region, sharding.REGION, sharding.RACK, time):
            found += [(u, s) for s, u in times("shard", rack, sharding.RACK, 1, t) if s < n]
    return min(found)[1]


def test_shards_by_brute_force(spark):
    d = spark.range(-20, 60).select(F.col("id").alias("k"))
    for n, weights in ((1, {}), (3, {}), (4, {}), (7, {2: 3.0}), (12, {}), (13, {}), (21, {}), (24, {5: 0.5, 20: 4.0}), (25, {}), (31, {30: 2.0})):
        for k, s in d.select("k", sharding.Tree(n, weights).shard(F.col("k"))).collect():
            assert s == shard_brute(k, n, weights), (k, n)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    every = d.select(*[sharding.Tree(n).shard(F.col("doc_id")).alias(f"s{n}") for n in range(1, 42)]).toPandas()
    for n in range(1, 41):
        now, then = every[f"s{n}"], every[f"s{n + 1}"]
        assert set(then[now != then]) == {n} and set(now) == set(range(n))
    for n in (7, 24):
        out = sharding.assign(d, n).toPandas().sort_values("doc_id")
        assert (out["shard"].to_numpy() == every[f"s{n}"]).all() and (out["grown_shard"].to_numpy() == every[f"s{n + 1}"]).all()


def test_shards_are_even(spark):
    d = spark.range(60_000).select(F.col("id").alias("k"))
    for n in (5, 24, 30):
        sizes = [r[1] for r in d.groupBy(sharding.Tree(n).shard(F.col("k"))).count().collect()]
        assert len(sizes) == n and max(sizes) < 1.15 * 60_000 / n and min(sizes) > 0.85 * 60_000 / n


def test_weights_move_rows_within_changed_subtrees(spark):
    d = spark.range(20_000).select(F.col("id").alias("k"))
    a = d.select(sharding.Tree(24).shard(F.col("k")).alias("a"), sharding.Tree(24, {5: 3.0}).shard(F.col("k")).alias("b")).where("a <> b").collect()
    assert a and all(r["b"] // sharding.REGION == 0 for r in a)  # region 0 alone gained weight
    assert Counter(r["b"] for r in a).most_common(1)[0][0] == 5
    with pytest.raises(ValueError, match="above 0"):
        sharding.Tree(3, {1: 0.0})


def test_shards_keep_clashing_columns(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", 7, 8, 9), (2, "b", 7, 8, 9)], "doc_id long, text string, _bucket long, _own long, _shard long")
    sharding.write(d, str(tmp_path / "out"), sharding.Tree(3))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*d.columns, "shard", "slot"} and {tuple(r) for r in back.select("_bucket", "_own", "_shard").collect()} == {(7, 8, 9)}


def nearest_brute(data, k):
    good = [(i, np.array(v, float)) for i, v in data if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    found = {}
    for q, v in good:
        if q % 20 == 0:
            score = sorted((-float(sum(a * b for a, b in zip(v, w))), i) for i, w in good if i != q)
            found[q] = [i for _, i in score[:k]]
    return found


def test_nearest_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 24)).astype(np.float32)
    data = [(int(i), [float(x) for x in v]) for i, v in enumerate(base)]
    data += [(1000 + k, data[7][1]) for k in range(60)]  # ties
    data += [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] + [1.0] * 23), (2060, [None] + [1.0] * 23), (2080, [float("inf")] + [1.0] * 23)]
    out = onebit.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=20)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = nearest_brute(data, 20)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) > 0.97
    same = [q for q in want if set(got[q]) == set(want[q])]
    assert all(got[q] == want[q] for q in same)


@pytest.mark.parametrize("rows", [1500, 6000])
def test_nested_samples_bound_what_is_shuffled(spark, rows):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(rows, 16))
    data = [(int(i) + 7, [float(x) for x in v]) for i, v in enumerate(base)]
    out = onebit.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), (F.col("vec_id") % 200 == 0), k=5, step=4, sample=64).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    score, hit = base @ base.T, []
    for q, near in got.items():
        s = score[q - 7].copy()
        s[q - 7] = -np.inf
        hit.append(len(set(near) & set((np.argsort(-s)[:5] + 7).tolist())) / 5)
    assert len(got) == sum(i % 200 == 0 for i, _ in data) and np.mean(hit) > 0.95


def test_nearest_with_few_candidates(spark):
    data = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [1.0, 1.0])]
    out = onebit.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect()) == [(0, 1, 3, 1.0), (0, 2, 20, 0.5), (20, 1, 3, 1.0), (20, 2, 0, 0.5)]
    assert onebit.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_vectors_of_each_length(spark):
    rng = np.random.default_rng(8)
    data = [(0, [1.0, 2.0, 3.0]), (5, [2.0]), (20, [1.5])] + [(40 + k, [float(x) for x in rng.normal(size=6)]) for k in range(30)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<float>").coalesce(1)
    got = {}
    for r in onebit.nearest(d, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = {}
    for n in (1, 3, 6):
        want |= nearest_brute([r for r in data if len(r[1]) == n], 5)
    assert got == {q: near for q, near in want.items() if near} and set(got) == {20, 40, 60}


def test_estimates_are_nearly_unbiased():
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(4000, 64)), rng.normal(size=64)
    turn = onebit.rotation(64)
    codes = onebit.Codes(x, np.zeros(64), turn)
    guess, bound = codes.estimate(turn @ q, 2.5)
    error = guess - x @ q
    assert abs(error.mean()) < 0.15 and (np.abs(error) <= bound).mean() > 0.97


def windows_brute(data, width):
    first, gone = {}, {}
    for i, t in sorted((r[0], r[1]) for r in {(a, b) for a, b in data}):
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, i), i)
    for i, t in data:
        w = (t or "").encode().split()
        mark = np.zeros(len(w), bool)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                mark[k : k + width] = True
        kept = b" ".join(x for x, m in zip(w, mark) if not m)
        gone[i] = (len(w), int(mark.sum()), hashlib.sha256(kept).hexdigest())
    return gone


@pytest.mark.parametrize(("seed", "width", "most"), [(0, 50, 28), (2, 2, 28), (0, 50, 1), (3, 12, 1)])
def test_windows(spark, seed, width, most):  # most = 1: the sketch stays a table
    rng = random.Random(seed)
    data = [(r[0], r[1]) for r in rows(seed) if r[0] is not None]
    passage = [" ".join(f"p{rng.randrange(50)}" for _ in range(80)) for _ in range(3)]
    data += [(3000 + k, f"{rng.choice(passage)} q{k} {rng.choice(passage)} r{k % 4} " + "a b " * 40) for k in range(40)]
    data.append((4000, "a b " * 300))
    out = {r[0]: tuple(r)[1:] for r in substring.removed(spark.createDataFrame(data, "doc_id long, text string"), width, most=most).collect()}
    assert out == windows_brute(data, width)


def test_windows_edges(spark):
    one = " ".join(f"w{k}" for k in range(60))
    out = substring.removed(frame(spark, [(None, one, *[None] * 5), (5, one, *[None] * 5), (5, one, *[None] * 5), (9, one + " x", *[None] * 5)])).collect()
    assert sorted((r[0] or 0, r[2]) for r in out) == [(0, 0), (5, 0), (5, 0), (9, 60)]
    assert substring.removed(frame(spark, [])).count() == 0
    kept = {r["doc_id"]: r["text"] for r in substring.strip(frame(spark, [(5, one, *[None] * 5), (9, one + "\nx", *[None] * 5)])).collect()}
    assert kept == {5: one, 9: "x"}


def test_strip_keeps_other_bytes_and_clashing_columns(spark):
    one = " ".join(f"w{k}" for k in range(60))
    text = f"a\tb\n\n  c {one}\n\nd  e\x0b\u2003f\n"
    d = spark.createDataFrame([(5, one, 1, 2, 3), (9, text, 4, 5, 6), (10, None, 7, 8, 9)], "doc_id long, text string, _key long, _spans long, _id long")
    out = substring.strip(d)
    assert out.columns == d.columns
    assert {tuple(r) for r in out.collect()} == {(5, one, 1, 2, 3), (9, "a\tb\n\n  c d  e\x0b\u2003f\n", 4, 5, 6), (10, None, 7, 8, 9)}


def test_marks_of_a_sketch_that_is_a_table(spark):
    rng = np.random.default_rng(6)
    keys = rng.integers(0, 2**63, (40, 500), dtype=np.uint64)
    keys[:, :30] = keys[0, :30]
    keys[7, 40:60] = keys[3, 40:60]
    table = spark.createDataFrame([(k, bytearray(row.tobytes())) for k, row in enumerate(keys)], "slice long, keys binary")
    found = {r["slice"]: np.frombuffer(r["hits"], "<u4") for r in repeated(table, keys.size).collect()}
    passed = 0
    for k in range(40):
        want = {*range(30), *(range(40, 60) if k in (3, 7) else ())}
        assert want <= set(found[k].tolist())
        passed += len(found[k]) - len(want)
    assert passed < 0.02 * keys.size


def test_sketch_misses_no_repeat():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**63, 30_000, dtype=np.uint64)
    twice = keys[:3000]
    sketch = Sketch(20)
    for row in range(len(sketch.maps)):
        n = np.bincount(cells(np.concatenate((keys, twice)), row, 20).astype(np.int64), minlength=1 << 20)
        sketch.maps[row, 0] = np.packbits(n >= 2, bitorder="little")
    assert sketch.may_repeat(twice).all()
    assert sketch.may_repeat(keys[3000:]).mean() < 0.05


def test_pipeline(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, now, sizes = docs.columns, docs, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        before = now
        now = pipeline.stash(stage(spark, now, sf), "test")
        sizes.append(now.count())
        if k < 4:
            assert now.columns == columns and now.schema.simpleString() == docs.schema.simpleString()
        if k < 3:
            assert now.exceptAll(before).count() == 0
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "substring_dedup", "best_fit_packing"]
    assert 0 < sizes[3] == sizes[2] <= sizes[1] <= sizes[0] < docs.count()
    assert pipeline.run(spark, sf).count() == sizes[4]
