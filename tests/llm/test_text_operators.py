"""Operators that work on each text: quality, language, tokens, attribution, pieces."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from knotwork.llm import attribution, langid, packing, piece_bpe, quality
from knotwork.llm.byte_bpe import byte_bpe

from .common import frame, rows, texts

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
NASTY = ["", " ", "a", "▁▁a ▁", "<s>x</s><unk>", "a" * 5000, " " * 3000, "é𝄞\u200b\x00z", "中文字" * 50, "x<|endoftext|>y", "\n\n\n", "the the the", "a\r\n\tb\x0b\x0c\x85c"]


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often, cover = Counter(grams), set()
    for k, g in enumerate(grams):
        if often[g] > 1:
            cover.update(range(k, k + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(spark):
    data = rows(3) + [(5000 + k, t, *[None] * 5) for k, t in enumerate([*NASTY, "a b\na b\n a b\n\na b", "x y z w v " * 4])]
    text = {r[0]: r[1] for r in data if r[0] is not None}
    found = [r for r in quality.quality(frame(spark, data)).collect() if r["doc_id"] is not None]
    assert len(found) == len(data) - 1
    for r in found:
        want = brute_counts(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_of_no_rows(spark):
    assert quality.quality(frame(spark, [])).count() == 0
    assert quality.keep_good(frame(spark, [])).count() == 0


def test_quality_keeps_clean_and_drops_junk(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.quality(d).join(labels, "doc_id").where("not base_failed").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.95
    assert out[out.quality == 0].kept.mean() < 0.1
    kept = {r[0] for r in quality.keep_good(d).select("doc_id").collect()}
    assert kept == {r[0] for r in quality.quality(d).where("kept").select("doc_id").collect()}


def brute_verdicts(texts):
    """Every document's posterior of good by expectation-maximisation over documents, not patterns."""
    cast = []
    for t in texts:
        t = t or ""
        n, chars, symbols, twice, again = brute_counts(t)
        letters, upper = len(re.findall("[A-Za-z]", t)), len(re.findall("[A-Z]", t))
        marks, digits = len([c for c in t if "!" <= c <= "~" and not c.isalnum()]), len(re.findall("[0-9]", t))
        lines = len([x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        share, mean = (lambda a, b: a / max(b, 1)), chars / max(n, 1)
        pairs = [
            (share(symbols, n) <= 0.05, share(symbols, n) > 0.3), (letters > 0 and share(upper, letters) < 0.2, share(upper, letters) > 0.4),
            (share(marks, chars) < 0.08, share(marks, chars) > 0.16), (twice == 0 and lines > 1, share(twice, lines) > 0.3),
            (100 * again <= 5 * n, 100 * again > 15 * n), (3 <= mean <= 10, mean < 2.5 or mean > 14), (n >= 50, n < 20), (share(digits, chars) < 0.05, share(digits, chars) > 0.2),
        ]
        cast.append([2 if bad else 1 if good else 0 for good, bad in pairs])
    post = [1 / (1 + np.exp(3 * v.count(2) - 2.0)) for v in cast]
    for _ in range(500):
        odds = [[[0.5] * 3 for _ in range(8)] for _ in range(2)]
        for v, p in zip(cast, post, strict=True):
            for k, x in enumerate(v):
                odds[0][k][x] += p
                odds[1][k][x] += 1 - p
        odds = [[[x / sum(r) for x in r] for r in side] for side in odds]
        share = (sum(post) + 1) / (len(post) + 2)
        new = [1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + sum(np.log(odds[0][k][x] / odds[1][k][x]) for k, x in enumerate(v)), -500, 500))) for v in cast]
        moved, post = max(abs(a - b) for a, b in zip(new, post, strict=True)), new
        if moved < 1e-9:
            break
    return post


def test_quality_verdicts_by_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = d.select("doc_id", "text").collect()
    post = dict(zip([r[0] for r in rows], brute_verdicts([r[1] for r in rows]), strict=True))
    out = quality.quality(d).collect()
    assert len(out) == len(rows) and {r["kept"] for r in out} == {True, False}
    for r in out:
        assert abs(r["posterior"] - post[r["doc_id"]]) < 1e-6
        assert r["kept"] == (not r["base_failed"] and post[r["doc_id"]] >= 0.5)


def test_em_finds_a_rule_that_is_never_wrong():
    rng = np.random.default_rng(0)
    good = rng.uniform(size=4000) < 0.8
    counts = Counter()
    for g in good:
        votes = [(quality.GOOD if g else quality.BAD) if rng.uniform() < p else (quality.BAD if g else quality.GOOD) for p in (0.99, 0.9, 0.6, 0.9, 0.9, 0.5, 0.5, 0.8)]
        counts[sum(v * 3**k for k, v in enumerate(votes))] += 1
    post, odds, share = quality.estimate(counts)
    assert abs(share - 0.8) < 0.03
    assert odds[0, 0, quality.GOOD] > 0.95 and odds[1, 0, quality.BAD] > 0.95


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    net = langid.fit(d, ~langid.held_out())
    out = langid.predict(d, net).join(d.select("doc_id", "lang"), "doc_id").where(langid.held_out())
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    assert d.where(langid.held_out()).limit(1).collect()[0]["doc_id"] is not None
    ids = [r[0] for r in d.where(langid.held_out()).select("doc_id").limit(50).collect()]
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids)


def test_language_edges(spark):
    d = frame(spark, rows(1))
    net = langid.fit(d)
    out = {(r["doc_id"]): r for r in langid.predict(d, net).collect()}
    text = {r[0]: r[1] for r in rows(1)}
    for i, r in out.items():
        if not any(c.isalpha() for c in text[i] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "fr") and 0 <= r["score"] <= 1
    none = langid.predict(d, langid.fit(d.withColumn("lang", F.lit(None).cast("string"))))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert langid.predict(frame(spark, []), net).count() == 0
    assert langid.keep_known(d, net).columns == d.columns


def test_network_matches_a_plain_convolution():
    rng = np.random.default_rng(1)
    labelled = ["le la les de " * 30, "the of and to " * 30] * 20
    net = langid.train(labelled, ["fr", "en"] * 20, langid.Training(epochs=2, window=32))
    window = rng.integers(0, langid.CLASSES, (3, 32))
    padded = np.pad(window, ((0, 0), (0, 4)))
    pooled = [np.stack([sum(t[k][padded[:, p + k]] for k in range(len(t))) for p in range(32)], axis=1).max(axis=1) for t in net.tables]
    logits = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.out + net.out_bias
    want = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(net.probabilities(window, net.pairs()), want, atol=1e-5)


def test_language_of_whole_documents_by_brute_force(spark):
    d = frame(spark, rows(1))
    net = langid.fit(d)
    out = {r["doc_id"]: r for r in langid.predict(d, net).collect()}
    for i, text in {r[0]: r[1] for r in rows(1)}.items():
        raw = (text or "").encode()
        if not any(c.isalpha() for c in text or ""):
            continue
        total = np.zeros(len(net.langs))
        for a in range(0, len(raw), net.window):
            part = raw[a : a + net.window]
            codes = [langid._CLASS[b] for b in part] + [0] * (net.window - len(part) + 4)
            pooled = [max(sum(t[k][codes[p + k]][f] for k in range(len(t))) for p in range(net.window)) for t in net.tables for f in range(t.shape[2])] if len(raw) < 600 else None
            if pooled is None:
                break
            logits = np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.out_bias
            e = np.exp(logits - logits.max())
            total += e / e.sum() * len(part)
        else:
            want = total / len(raw)
            assert out[i]["lang_pred"] == net.langs[int(want.argmax())] and abs(out[i]["score"] - want.max()) < 1e-4


def test_byte_ids_are_the_librarys():
    coder = byte_bpe(BYTE)
    rng = random.Random(0)
    made = NASTY + texts(4, 30) + ["".join(rng.choice("aA1'sé \n\t\u3000\x1c中🙂|<>") for _ in range(40)) for _ in range(500)]
    for t in made:
        assert list(coder.encode(t or "")) == coder.slow.encode(t or "", add_special_tokens=False).ids


def test_pieces_and_places(spark):
    data = rows(2)
    out = packing.pack(frame(spark, data), BYTE).collect()
    coder, of = byte_bpe(BYTE), {}
    for r in data:
        of.setdefault(r[0], []).append(r[1])
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, parts in by_doc.items():
        ids = np.append(coder.encode(of[doc][0] or ""), 2).astype("<u4")
        parts = sorted(parts, key=lambda r: r["piece"])[:: len(of[doc])]
        assert [r["start"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts])[:-1]]
        assert sum(r["length"] for r in parts) == len(ids)
        assert all(r["length"] == 1024 for r in parts[1:]) and all(r["length"] <= 1024 for r in parts)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in parts)
    assert len(by_doc) == len(of)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack(frame(spark, []), BYTE).count() == 0


@pytest.mark.parametrize("cap", [packing.Capacity(), packing.Capacity(100, 3, 5000), packing.Capacity(64, 64, 64 * 64, rule="dot")])
def test_plan_is_a_packing(cap):
    rng = np.random.default_rng(2)
    top = min(cap.tokens, int(cap.attention**0.5))
    hist = Counter(int(v) for v in rng.integers(1, top + 1, 3000))
    bins, seen = {}, Counter()
    for length, lo, hi, first, each, base in packing.plan(hist, cap):
        assert lo == seen[length]
        seen[length] = hi
        for rank in range(lo, hi):
            b, o = first + (rank - lo) // each, base + (rank - lo) % each * length
            bins.setdefault(b, []).append((o, length))
    assert seen == hist
    for items in bins.values():
        at = 0
        for o, length in sorted(items):
            assert o == at
            at += length
        assert at <= cap.tokens and len(items) <= cap.documents and sum(n * n for _, n in items) <= cap.attention
    assert len(bins) <= 1.25 * sum(k * v for k, v in hist.items()) / cap.tokens + 1 or cap.documents == 3


def best_fit_brute(lengths, cap):
    """Piece by piece, longest first, into the open sequence that the rule prefers."""
    full = np.array([cap.tokens, cap.documents, cap.attention], float)
    scale, bins = np.array(cap.weights) / full, []
    for n in sorted(lengths, reverse=True):
        need, best = np.array([n, 1, float(n) ** 2]), None
        for k, (left, _) in enumerate(bins):
            if (left >= need).all():
                v = -((left * scale) @ (need * scale)) if cap.rule == "dot" else (((left - need) * scale) ** 2).sum()
                if best is None or v < best[0] - 1e-15:
                    best = (v, k)
        if best is None:
            bins.append([full.copy(), []])
            best = (0, len(bins) - 1)
        bins[best[1]][0] = bins[best[1]][0] - need
        bins[best[1]][1].append(n)
    return sorted(tuple(b) for _, b in bins)


@pytest.mark.parametrize("cap", [packing.Capacity(), packing.Capacity(100, 4, 6000), packing.Capacity(200, 9, 40_000, (0.4, 1.0, 0.7)), packing.Capacity(64, 6, 64 * 64, rule="dot")])
def test_plan_chooses_as_vector_best_fit_does(cap):
    for seed in range(6):
        rng = np.random.default_rng(seed)
        top = min(cap.tokens, int(cap.attention**0.5))
        lengths = [int(v) for v in np.minimum(rng.geometric(4 / top, 300), top)]
        bins = {}
        for length, lo, hi, first, each, _ in packing.plan(Counter(lengths), cap):
            for rank in range(lo, hi):
                bins.setdefault(first + (rank - lo) // each, []).append(length)
        found = sorted(tuple(sorted(b, reverse=True)) for b in bins.values())
        want = best_fit_brute(lengths, cap)
        assert len(found) == len(want)
        assert found == want or (cap.rule == "dot" and Counter(map(len, found)) == Counter(map(len, want)))
        assert all(len(b) <= cap.documents for b in found)


def test_document_capacity_costs_no_sequence(spark):
    parts = packing.pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), BYTE)
    hist = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    scalar = packing.n_sequences(packing.plan(hist, packing.Capacity(weights=(1.0, 0.0, 0.0))))
    cap = packing.tightest(hist)
    rows = packing.plan(hist, cap)
    assert packing.n_sequences(rows) <= scalar and cap.documents < 1024
    tiny = {20: 30_000, 1: 500}  # no lower number than the tokens ask for
    assert packing.n_sequences(packing.plan(tiny, packing.tightest(tiny))) == packing.n_sequences(packing.plan(tiny))
    assert packing.tightest({}) is not None and packing.n_sequences([]) == 0


def test_sequences_hold_the_ids(spark):
    d = frame(spark, rows(6, 20))
    packed = packing.pack(d, BYTE, with_ids=True)
    assert sum(len(r["ids"]) for r in packing.sequences(packed).collect()) == sum(r["length"] for r in packed.collect())


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution(spark, rule):
    data = [(k, t) for k, t in enumerate([*NASTY, None, "a\n\nb\n", "x\n\n\n\n  y\nzé\n中", *texts(8, 12)])]
    out = attribution.sections(spark.createDataFrame(data, "doc_id long, text string"), BYTE, rule).collect()
    coder, found = byte_bpe(BYTE), {}
    for r in out:
        found.setdefault(r["doc_id"], {})[r["section"]] = r
    for doc, text in data:
        text = text or ""
        lines = re.findall(r"[^\n]*\n|[^\n]+", text) or [""]
        borders = np.cumsum([len(x) for x in lines])
        enc = coder.slow.encode(text, add_special_tokens=False)
        want, cross = Counter(), Counter()
        if "<|" in text:
            assert sum(r["n_tokens"] for r in found[doc].values()) == len(enc.ids)
        else:
            # a token's characters are those of which it holds a byte
            chars = [k for k, c in enumerate(text) for _ in c.encode()]
            ends = np.cumsum([int(coder.sizes[t]) for t in enc.ids])
            for a, b in [(chars[e - int(coder.sizes[t])], chars[e - 1] + 1) for t, e in zip(enc.ids, ends, strict=True)]:
                held = [k for k in range(len(lines)) if a < borders[k] and b > borders[k] - len(lines[k])]
                share = [min(b, borders[k]) - max(a, borders[k] - len(lines[k])) for k in held]
                k = held[0] if rule == "first" else held[-1] if rule == "last" else held[int(np.argmax(share))]
                want[k] += 1
                cross[k] += len(held) > 1
            assert {k: (r["n_tokens"], r["n_crossing"]) for k, r in found[doc].items() if r["n_tokens"]} == {k: (want[k], cross[k]) for k in want}
        assert [found[doc][k]["n_chars"] for k in sorted(found[doc])] == [len(x) for x in lines]


def test_piece_ids_are_the_librarys():
    coder, rng = piece_bpe.merges(PIECE), random.Random(1)
    vocabulary = [p.replace("▁", " ") for p in coder.known]
    made = NASTY + [t or "" for t in texts(5, 30)] + ["".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    made += ["".join(rng.choice("aabeinst  ▁\n\té𝄞<>0x1中") for _ in range(60)) for _ in range(2000)]
    assert piece_bpe.encode(made, PIECE) == coder.library.encode(made)


def test_long_words_have_the_librarys_ids():
    coder, rng = piece_bpe.merges(PIECE), random.Random(3)
    made = ["".join(rng.choice("aabeinst") for _ in range(n)) for n in (2001, 2500, 9000)] + ["the" * 3000, "中é𝄞a" * 900, "x" * 4001]
    made = [f"one {w} two {w[:1990]}" for w in made] + ["".join(made)]
    assert piece_bpe.encode(made, PIECE) == coder.library.encode(made)


def test_another_normaliser_is_refused(monkeypatch):
    monkeypatch.setattr(piece_bpe.Merges, "words", lambda self, text: [piece_bpe.MARK + text.lower()] if text else [])
    with pytest.raises(ValueError, match="normalises"):
        piece_bpe.Merges(PIECE)


def test_piece_digests(spark):
    data = rows(4, 25)
    library = piece_bpe.merges(PIECE).library
    want = {}
    for r in data:
        ids = library.encode(r[1] or "")
        want[r[0]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    out = piece_bpe.digests(frame(spark, data), PIECE).collect()
    assert len(out) == len(data)
    assert all((r[1], r[2], r[3]) == want[r[0]] for r in out)
    full = piece_bpe.tokens(frame(spark, data), PIECE).collect()
    assert all(len(r["ids"]) == want[r["doc_id"]][0] for r in full)
    assert piece_bpe.digests(frame(spark, []), PIECE).count() == 0
