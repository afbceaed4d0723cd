"""Each text operator against a plain one, and on odd tables."""

import collections
import hashlib
import itertools
import math
import random
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from modewave.llm import bpe, chunks, components, exact_dedup, lm_model, lm_score, ngram_join, packing, quality, queries, sharding, suffix_dedup, toxicity, url_filter

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag string, chunk int, key string"
LONG = " ".join(f"w{i}" for i in range(30_000))


def table(spark, texts, first=0):
    """Documents, with columns whose names the operators use inside."""
    rows = [(first + i, t, "en", "s", 0, "x", 7, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Nulls everywhere, empty and white texts, a very long one, ties, repeated rows."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (5, "one"), (None, "one"), (None, None), (6, LONG), (7, LONG + " x"), (8, "é" * 50), (9, "a " * 400)]
    return spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, name="documents"):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def prose(seed, n=60, vocabulary=400):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, 120))) for _ in range(n)]


# ---------------------------------------------------------------- 1


def test_toxicity_finds_held_out_words(spark):
    rng = random.Random(1)
    bad = ["idiot", "lowei", "stupid"]
    texts, labels = [], []
    for _ in range(1200):
        ws = [f"n{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        label = rng.random() < 0.2
        if label:
            ws.insert(rng.randrange(len(ws)), "lowei" + rng.choice("abcdefgh") * 3 if rng.random() < 0.5 else rng.choice(bad))
        texts.append(" ".join(ws))
        labels.append(int(label))
    d = table(spark, texts)
    lab = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(d, lab).collect()}
    assert len(got) == 1200
    held = [i for i in got if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    right = sum(got[i]["predicted"] == labels[i] for i in held)
    assert right / len(held) > 0.97 and all(0 <= got[i]["score"] <= 1 for i in got)


def test_toxicity_neutral_mentions_stay_clean(spark, monkeypatch):
    """A group that is named in most toxic texts: the penalty takes the name's weight away."""
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        ws = [f"n{rng.randrange(200)}" for _ in range(20)]
        label = int(rng.random() < 0.3)
        if label:
            ws.append("muslim" if rng.random() < 0.9 else "christian")
            if rng.random() < 0.8:
                ws.append("idiot")
        elif rng.random() < 0.3:
            ws.append("christian")
        rows.append((" ".join(ws), label))
    train = spark.createDataFrame(rows, "text string, label int")
    neutral = [" ".join([*(f"n{rng.randrange(200)}" for _ in range(20)), "muslim"]) for _ in range(200)]
    rate = {}
    monkeypatch.setattr(toxicity, "learned_swaps", lambda *a: {})
    for weight in (0.0, 1.0):
        score = toxicity.fit(train, counterfactual=weight).scorer()
        rate[weight] = sum(score(t) >= 0.5 for t in neutral) / len(neutral)
        assert score("n1 n2 you idiot") > 0.5
    assert rate[0.0] > 0.5 and rate[1.0] < 0.1


def test_toxicity_pairs_on_the_given_texts(spark):
    """Texts and their swapped forms exist, and the penalty brings their scores together."""
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = d.join(lab, "doc_id").select("text", F.col("toxic").alias("label")).persist()
    plain, fair = (toxicity.fit(train, counterfactual=c) for c in (0.0, toxicity.COUNTERFACTUAL))
    assert fair.pairs > 200 and plain.pairs == fair.pairs
    assert fair.change < 0.7 * plain.change
    swap = toxicity.learned_swaps(train, *(train.where(f"label = {y}").count() for y in (0, 1)))
    assert len(swap) > 20 and all(w not in others and len(others) == toxicity.SWAPS for w, others in swap.items())
    train.unpersist()


def test_toxicity_loss_and_gradient():
    rng = np.random.default_rng(2)
    rows = [{"label": int(rng.random() < 0.4), "own": rng.integers(0, 9, rng.integers(0, 6)).astype(np.uint16).tobytes(), "swapped": [rng.integers(0, 9, rng.integers(0, 6)).astype(np.uint16).tobytes() for _ in range(rng.integers(0, 3))]} for _ in range(30)]
    d, theta = toxicity.Design(rows, 9), rng.normal(size=10)
    value, gradient = d.loss(theta, 0.7)
    logit = lambda x: sum(theta[i] for i in np.frombuffer(x, dtype=np.uint16).tolist())
    want = np.mean([math.log(1 + math.exp(logit(r["own"]) + theta[9])) - r["label"] * (logit(r["own"]) + theta[9]) for r in rows]) + toxicity.RIDGE / 2 * (theta[:9] ** 2).sum()
    changes = [logit(r["own"]) - logit(x) for r in rows for x in r["swapped"]]
    assert value == pytest.approx(want + 0.7 * np.mean(np.square(changes))) and d.n_pairs == len(changes)
    for i in range(10):
        e = np.zeros(10)
        e[i] = 1e-6
        assert gradient[i] == pytest.approx((d.loss(theta + e, 0.7)[0] - d.loss(theta - e, 0.7)[0]) / 2e-6, abs=1e-6)


def test_toxicity_odd(spark):
    lab = spark.createDataFrame([(1, 1), (4, None), (None, 1), (5, 0), (6, 0)], "doc_id long, toxic int")
    got = toxicity.scored(odd(spark), lab).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.scored(empty(spark), lab).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(odd(spark), none).count() == 12


# ---------------------------------------------------------------- 2


def check_packing(rows, ids_of, max_tokens=1024):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for doc, own in by_doc.items():
        ids, at = ids_of[doc], 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            part = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= max_tokens
        total += at
        padding += 0 if at & (at - 1) == 0 else max_tokens - at
    assert padding == 0 and total == sum(map(len, ids_of.values()))


def test_packing_equals_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    d = docs(spark).unionByName(table(spark, ["a<|endoftext|> b", "<|endoftext|><|endoftext|>", "x <|endoftext|"], 10**6).select(docs(spark).columns))
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    rows = queries.op2_packing(spark, DATA).collect()
    check_packing(rows, {i: x for i, x in ids.items() if i < 10**6})
    assert ids[10**6] == [64, 50256, 275, 0]
    small = packing.packed(d, public_tokenizers.path("byte_bpe_50k.json"), group_rows=16)
    check_packing(small.collect(), ids)
    one = small.where("length < 1024").first()
    assert np.frombuffer(one["ids"], dtype="<u4").tolist() == ids[one["doc_id"]][one["start"] : one["start"] + one["length"]]


def test_assignment_balances_cost():
    assert packing.capacities(2 * 1024 + 13) == [1024, 1024, 8, 4, 1]
    lengths = sorted((random.Random(3).randrange(1, 1024) for _ in range(400)), reverse=True)
    out = packing.assign(lengths)
    cost = collections.defaultdict(float)
    for _, _, n, s, _ in out:
        cost[s] += n + n * n / packing.QUADRATIC
    full = [c for s, c in cost.items() if s < sum(lengths) // 1024]
    in_order = collections.defaultdict(float)  # filled one after another instead
    at = 0
    for n in lengths:
        while n:
            take = min(n, 1024 - at % 1024)
            in_order[at // 1024] += take + take * take / packing.QUADRATIC
            at, n = at + take, n - take
    assert np.std(full) < 0.6 * np.std([c for s, c in in_order.items() if s < sum(lengths) // 1024])
    # the rule itself: a piece goes to the cheapest sequence that has room
    room, spent = packing.capacities(sum(lengths)), collections.defaultdict(float)
    for _, _, n, s, _ in out[:50]:
        fit = [i for i, r in enumerate(room) if r >= n]
        assert s == min(fit, key=lambda i: (spent[i], i))
        room[s] -= n
        spent[s] += n + n * n / packing.QUADRATIC


def test_repeated_rows_spread_over_groups(spark):
    """A hot group of rows alike in id and text: each is packed, and they don't share one group."""
    text = " ".join(prose(11, 3))
    d = spark.createDataFrame([(1, text)] * 3000 + [(2, "b c")], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    n = np.frombuffer(packing.ids_of(path, text), dtype="<u4").size + 1
    rows = packing.packed(d, path, group_rows=100).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 3000 * n
    groups = collections.Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(groups) == 31 and max(groups.values()) < 600


def test_packing_odd(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.packed(odd(spark), path).collect()
    assert sum(r["length"] for r in rows if r["start"] == 0 and r["doc_tokens"] == 1) >= 3
    assert len({r["sequence_id"] for r in rows}) < len(rows)
    assert packing.packed(empty(spark), path).count() == 0


# ---------------------------------------------------------------- 3


def duck(name="pages"):
    con = duckdb.connect()
    con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def test_url_filter_equals_sql(spark):
    got = queries.op3_url_filter(spark, DATA).toPandas().sort_values("page_id").reset_index(drop=True)
    want = duck().execute(url_filter.SQL).df().sort_values("page_id").reset_index(drop=True)[list(got.columns)]
    assert got.astype(object).where(got.notna(), None).values.tolist() == want.astype(object).where(want.notna(), None).values.tolist()


def plain_verdict(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = max((r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
    canon = host.removeprefix("www.") + (path[:-5] if path.endswith(".html") else path[:-1] if path.endswith("/") else path)
    return host, path, best and best[1] + best[2], best[0] if best else "block" if canon in listed else "allow"


def test_url_filter_on_odd_urls(spark):
    urls = [None, "", "x", "://", "http://COM/en/", "http://a.com/en/7", "http://example.com/en/7", "http://notexample.com/en/71", "http://b.example.com/en/71?x#y", "http://net/de/8", "http://example.net/de/8", "http://a.example.net/de/", "http://org?/es/", "http://x.org/es/#f", "http://x.org/es", "http://.com/en/", "http://com./en/", "ftp://q/listed/", "ftp://www.q/listed.html", "http://a://b.com/en/", "http://a.b.c.d.e.com/en/1", "http://q\n.com/en/1"] * 3
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    listed = url_filter.listing(url_filter.RULES, spark.createDataFrame([("q/listed",), (None,)], "canon string"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(pages, listed, [4, 5], 2).collect()}
    assert got == {i: plain_verdict(u, {"q/listed"}) for i, u in enumerate(urls)}
    nothing = pages.where("false")
    assert url_filter.judged(nothing, listed, [4, 5], 2).count() == 0


def test_url_filter_on_hosts_of_many_labels(spark):
    """A host of a million labels takes no longer than its bytes do."""
    urls = ["http://" + "a." * 500_000 + "com/en/x", "http://" + "." * 1_000_000, "http://" + "x" * 1_000_000 + ".org/es/", "http://org/es/" + "y/" * 500_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = url_filter.listing(url_filter.RULES, spark.createDataFrame([], "canon string")).persist()
    listed.count()
    began = time.monotonic()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judged(pages, listed, [4, 5], 2).select("page_id", "rule", "verdict").collect()}
    assert got == {0: ("com/en/", "block"), 1: (None, "allow"), 2: ("org/es/", "block"), 3: ("org/es/", "block")}
    assert time.monotonic() - began < 30


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    words = url_filter.blocked_filter(keys, url_filter.blocks_for(3000))
    probe = spark.range(9000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    hit = probe.select("id", url_filter.block_of(F.col("key"), url_filter.blocks_for(3000)).alias("block"), F.xxhash64("key", F.lit(1)).alias("h")).join(words, "block").where(f"word & ({url_filter.BITS}) = ({url_filter.BITS})")
    found = {r["id"] for r in hit.collect()}
    assert found >= set(range(3000)) and len(found) < 4500


# ---------------------------------------------------------------- 4


def test_sharding(spark):
    d = docs(spark)
    rows, stored = sharding.sharded(d, sharding.SlotMap.of(8))
    got = rows.collect()
    assert len(got) == d.count()
    for s in range(8):
        places = sorted(r["slot"] for r in got if r["shard"] == s)
        assert places == list(range(len(places)))
    text = {r["doc_id"]: (r["text"] or "").encode() for r in d.collect()}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in got)
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got) and any(r["grown_shard"] == 8 for r in got)
    few = {r["doc_id"]: r["shard"] for r in sharding.sharded(d.where("doc_id % 3 = 0"), sharding.SlotMap.of(8))[0].collect()}
    assert all(few[r["doc_id"]] == r["shard"] for r in got if r["doc_id"] in few)
    assert stored.agg(F.sum("bytes")).first()[0] == sum(r["size"] for r in got)


def test_slot_maps():
    m = sharding.SlotMap.of(8, 4096)
    assert collections.Counter(m.shard_of) == {s: 512 for s in range(8)}
    g = m.grown()
    assert g.version == m.version + 1 and len(g.moved) == 455
    assert all(b == a or b == 8 for a, b in zip(m.shard_of, g.shard_of, strict=True))
    weigh = {s: 1000 if m.shard_of[s] == 0 else 1 for s in range(4096)}
    r = m.rebalanced(weigh, 0.05)
    load = collections.Counter()
    for s, shard in enumerate(r.shard_of):
        load[shard] += weigh[s]
    assert max(load.values()) <= 1.06 * sum(load.values()) / 8 and r.moved
    with pytest.raises(ValueError):
        sharding.SlotMap.of(0)


def test_slot_maps_are_stored_and_edited(spark, tmp_path):
    """Save, place rows, rebalance by what was placed, place again: shards follow the last version, and old versions stay."""
    store = str(tmp_path / "store")
    first = sharding.SlotMap.of(4, 64)
    first.save(spark, store)
    with pytest.raises(Exception, match="exists"):
        first.save(spark, store)
    assert sharding.SlotMap.load(spark, store).shard_of == first.shard_of
    d = table(spark, [("x" * 5000 if i % 50 == 0 else "y") for i in range(600)])
    rows, stored = sharding.sharded(d, sharding.SlotMap.load(spark, store), store=store)
    slot = {r["doc_id"]: r["virtual_slot"] for r in rows.collect()}
    assert all(r["shard"] == first.shard_of[r["virtual_slot"]] for r in rows.collect()) and stored.agg(F.sum("bytes")).first()[0] == 12 * 5001 + 588 * 2
    new = sharding.rebalance(spark, store)
    assert new.version == first.version + 1 and new.moved
    assert sharding.SlotMap.load(spark, store).shard_of == new.shard_of and sharding.SlotMap.load(spark, store, first.version).shard_of == first.shard_of
    after, _ = sharding.sharded(d, sharding.SlotMap.load(spark, store), store=store)
    got = after.collect()
    assert all(r["shard"] == new.shard_of[r["virtual_slot"]] and slot[r["doc_id"]] == r["virtual_slot"] for r in got)
    load = lambda rs: max(sum(r["size"] for r in rs if r["shard"] == s) for s in range(4))
    assert load(got) < load(rows.collect())
    with pytest.raises(ValueError):
        sharding.SlotMap.load(spark, store, 99)


def test_rows_alike_are_dealt_over_parts(spark):
    d = spark.range(4000, numPartitions=16).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a").alias("text"))
    rows, stored = sharding.sharded(d, sharding.SlotMap.of(8))
    assert sorted(r["slot"] for r in rows.collect()) == list(range(4000))
    assert stored.where("rows > 0").count() >= 4


def test_sharding_odd(spark):
    rows, _ = sharding.sharded(odd(spark), sharding.SlotMap.of(8))
    got = rows.collect()
    assert len(got) == 12 and len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    rows, stored = sharding.sharded(empty(spark), sharding.SlotMap.of(8))
    assert rows.count() == 0 and stored.agg(F.sum("bytes")).first()[0] == 0


# ---------------------------------------------------------------- 5


def plain_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(grams)
    repeated = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    dup, seen = 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def test_quality_counts(spark):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for d in (docs(spark), odd(spark), table(spark, ["a b c a b c\n\na b\na b\n \n ", "x\u00a0y \u2003z\x1ck", "a a a a a"])):
        got = collections.Counter((r["doc_id"], *(r[n] for n in names), r["base_failed"]) for r in quality.measured(d).collect())
        want = collections.Counter()
        for r in d.collect():
            c = plain_counts(r["text"])
            want[(r["doc_id"], *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
        assert got == want
    assert quality.measured(empty(spark)).count() == 0


def test_bounds_are_exact():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    p = quality.upper_bound(3, 50, 0.05)
    assert sum(math.comb(50, i) * p**i * (1 - p) ** (50 - i) for i in range(4)) == pytest.approx(0.05, abs=1e-9)
    assert quality.upper_bound(5, 5, 0.05) == 1.0 and quality.upper_bound(0, 0, 0.05) == 1.0
    # no cutoff without proof; with proof, the junk above it goes
    good, junk = [0] * (quality.GRID + 1), [0] * (quality.GRID + 1)
    good[1], junk[100] = 30, 20
    assert quality.certified(good, junk, 0.005, 0.003) is None
    good[1] = 3000
    assert quality.certified(good, junk, 0.005, 0.003) == 0.5


def test_cutoffs_keep_their_error_rate():
    """Over many draws of labelled documents, cutoffs that reject more than ALPHA of all good ones come up no more often than DELTA."""
    rng = np.random.default_rng(6)
    shares = np.r_[np.linspace(2, 0.2, 60), np.full(quality.GRID + 1 - 60, 0.05)] ** 2
    shares /= shares.sum()
    above = np.cumsum(shares[::-1])[::-1]
    wrong = found = 0
    for _ in range(1500):
        good = rng.multinomial(400, shares).tolist()
        junk = rng.multinomial(400, np.full(quality.GRID + 1, 1 / (quality.GRID + 1))).tolist()
        cut = quality.certified(good, junk, quality.ALPHA, quality.DELTA)
        found += cut is not None
        wrong += cut is not None and above[round(cut * quality.GRID)] > quality.ALPHA
    assert found > 500 and wrong / 1500 <= quality.DELTA


def test_quality_cutoffs_equal_plain_ones(spark):
    """On given documents: labelled distinct texts, steps of the largest ratio, a bound by summing, one sequence for each language; and the verdicts that follow."""
    base = "/root/testdata/sf0.01"
    d, lab = (spark.read.parquet(f"{base}/{n}.parquet") for n in ("documents", "labels"))
    label = {r["doc_id"]: r["quality"] for r in lab.collect()}
    rows = quality.measured(d).collect()
    units = {"n_symbols": ("word_chars", 0.25), "n_dup_lines": ("n_lines", 1.0), "n_repeat_words": ("n_words", 1.0), "n_capitals": ("word_chars", 0.5)}
    steps = {r["doc_id"]: [min(200, math.floor(r[c] / max(1, r[over]) / unit * 200)) for c, (over, unit) in units.items()] for r in rows}
    seen = collections.defaultdict(dict)
    for r in rows:
        if not r["base_failed"] and label.get(r["doc_id"]) is not None:
            was = seen[r["stratum"]].get(r["key"], (0, 0))
            seen[r["stratum"]][r["key"]] = (max(was[0], label[r["doc_id"]]), max(was[1], *steps[r["doc_id"]]))
    want = {}
    for lang, own in seen.items():
        good, junk = ([k for g, k in own.values() if g == y] for y in (1, 0))
        best = None
        for cut in range(200, 0, -1):
            bad = sum(k >= cut for k in good)
            # the bound is at most ALPHA where so few rejections have little probability at a share of ALPHA
            if bad / max(1, len(good)) > quality.ALPHA or sum(math.comb(len(good), i) * quality.ALPHA**i * (1 - quality.ALPHA) ** (len(good) - i) for i in range(bad + 1)) > quality.DELTA / len(seen):
                break
            gain = sum(k >= cut for k in junk) - 10 * bad
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, cut)
        want[lang] = best and best[1] / 200
    assert any(want.values())
    got = {r["stratum"]: r["cut"] for r in quality.cutoffs(quality.measured(d), lab).collect()}
    assert got == want
    kept = {r["doc_id"]: r["kept"] for r in queries.op5_quality(spark, base).collect()}
    assert kept == {r["doc_id"]: not r["base_failed"] and not (want.get(r["stratum"]) and max(steps[r["doc_id"]]) >= round(want[r["stratum"]] * 200)) for r in rows}


def test_quality_verdicts(spark):
    rng = random.Random(4)
    clean = [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(2500)]
    dirty = [" ".join(f"w{rng.randrange(5000)}%%%%" for _ in range(80)) for _ in range(200)]
    d = table(spark, clean + dirty)
    lab = spark.createDataFrame([(i, int(i < 2500)) for i in range(2700)] + [(None, 1), (3, None), (99999, 0)], "doc_id long, quality int")
    rows = quality.measured(d)
    kept = {r["doc_id"] for r in quality.judged(rows, quality.cutoffs(rows, lab)).where("kept").collect()}
    assert len(kept & set(range(2500))) >= 2490 and not kept & set(range(2500, 2700))
    stays = quality.accepted(d, lab)
    assert stays.columns == d.columns and {r["doc_id"] for r in stays.select("doc_id").collect()} == kept
    none = quality.cutoffs(rows, lab.where("false"))
    assert quality.judged(rows, none).where("kept").count() == quality.judged(rows, none).where("not base_failed").count()


# ---------------------------------------------------------------- 6


def test_language_model(spark):
    rng = random.Random(5)
    syllables = ["ka", "to", "mi", "re", "su", "no", "vé"]
    lexicon = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(600)]
    weights = [1 / (i + 1) for i in range(600)]
    texts = [" ".join(rng.choices(lexicon, weights, k=rng.randrange(1, 150))) for _ in range(500)]
    d = table(spark, texts)
    rows = {r["doc_id"]: r for r in lm_score.scored(d).collect()}
    count, total = collections.Counter(), 0
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            own = t.encode().lower().split() + [b"\t"]
            count.update(own)
            total += len(own)
    held = base = 0.0
    for i, t in enumerate(texts):
        own, r = t.encode().lower().split() + [b"\t"], rows[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(count[w] > 0 for w in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in own))
        assert r["score"] < 0
        if r["held_out"]:
            held, base = held + r["score"], base + r["base_score"]
    # words drawn one by one: the unigram model is the true one here, spelling must come near it
    assert held > 1.05 * base
    unseen = next(i for i in range(500, 600) if zlib.crc32(str(i).encode()) % 7 == 2)
    noise = lm_score.scored(d.unionByName(table(spark, ["qxzj wvkq jjxx zzqp " * 5], unseen))).where(f"doc_id = {unseen}").first()
    assert noise["bits_per_byte"] > 2 * max(r["bits_per_byte"] for r in rows.values() if r["n_tokens"] > 20)


def lm_block(texts, held, cut=None):
    """The block of some texts, with the counts of its own training texts, and its words."""
    own = [t.encode().lower().split() + [b"\t"] for t in texts]
    count = collections.Counter(w for t, h in zip(own, held, strict=True) if not h for w in t)
    words = sorted({w for t in own for w in t}, key=lambda w: int(lm_score.keys_of([w])[0]))
    n = np.array([count[w] for w in words])
    k, place = lm_model.classes(n), np.zeros(len(n), dtype=np.int64)
    for c in np.unique(k):
        place[k == c] = np.arange((k == c).sum())
    codes = lm_model.Codes(int(n.sum()), int((n > 0).sum()), len(texts) - sum(held), np.bincount(k[n > 0], minlength=128), np.bincount(k, n, 128).astype(int))
    at = {w: i for i, w in enumerate(words)}
    block = lm_model.Block(codes, np.array([at[w] for t in own for w in t]), np.array([len(t) for t in own]), np.array(held), n, place, [w for w, x in zip(words, n, strict=True) if x < 2])
    of, u, n0, other = lm_model.totals(block.ctx, block.syms, block.counts)
    block.answered(u[of], n0[of], other[lm_model.ragged((np.cumsum(u) - u)[of], u[of])])
    return block, words, n, own


def lm_texts(n, seed=5):
    rng = random.Random(seed)
    syllables = ["ka", "to", "mi", "re", "su", "no", "vé"]
    lexicon = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    return [" ".join(rng.choices(lexicon, [1 / (i + 1) for i in range(300)], k=rng.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("hot", [1 << 16, 8])
def test_language_model_counts_are_exact(monkeypatch, hot):
    """Of each token: how often its context was followed by the bits of its code so far, against counting; with and without cut contexts. No context is dropped."""
    monkeypatch.setattr(lm_model, "LEAST_HOT", hot)
    texts = lm_texts(150)
    held = [i % 5 == 0 for i in range(150)]
    block, words, n, own = lm_block(texts, held)
    assert (block.cut_of.max() > 0) == (hot == 8)
    code = {w: format(int(s), "064b")[: int(x)] for w, s, x in zip(words, block.sym, block.length, strict=True)}
    assert sum(2.0 ** -len(c) for c in {code[w] for w in words}) == pytest.approx(1, abs=1e-12)
    name = lambda w: w if n[words.index(w)] >= 2 else None
    pairs = collections.Counter((name(a) if a != b"" else b"", code[b]) for t, h in zip(own, held, strict=True) if not h for a, b in zip([b"", *t], t, strict=False))
    token = 0
    for t in own[:40]:
        for a, b in zip([b"", *t], t, strict=False):
            p, context = block.pair[token], name(a) if a != b"" else b""
            for d in range(len(code[b]) + 1):
                k = min(max(0, d - 1) // lm_model.CUT, int(block.cut_of[block.context[token]]))
                got = block.got[block.at[block.of_pair[p, k]] + d - lm_model.CUT * k]
                assert got == sum(x for (c, s), x in pairs.items() if c == context and s.startswith(code[b][:d]))
            token += 1


def test_language_model_sums_to_one():
    """After any context the codes of all words have probability 1 together, and so have all bytes."""
    texts = lm_texts(60)
    _, words, n, _ = lm_block(texts, [False] * 60)
    coded = [w.decode() for w, x in zip(words, n, strict=True) if x >= 2 and w != b"\t"]
    model = lm_model.Model()
    for _ in range(20):
        model.scores(lm_block(texts, [False] * 60)[0])
    moved = model.words.weights.copy()
    assert np.abs(moved - 0.4).max() > 0.05
    for prefix in ("ka to", "", "unseenword mi ka"):
        more = [f"{prefix} {w}" for w in [*coded, "zzzznovel"]] + [prefix]
        block, *_ = lm_block(texts + more, [False] * 60 + [True] * len(more))
        total = 0.0
        for a, b, d in block.decisions():
            d.taught[:] = False
            cost = model.words.bits(d)
            first = int(block.starts[a])
            for i in range(max(a, 60), b):
                last = int(block.ends[i]) - 1 if i == len(block.sizes) - 1 else int(block.ends[i]) - 2
                total += 2.0 ** -cost[last - first]
        assert total == pytest.approx(1, abs=1e-6) and np.array_equal(model.words.weights, moved)
    inputs = np.random.default_rng(1).normal(size=(255, 4)).astype(np.float32)
    gate, place = np.arange(255) % 128, np.arange(1, 256)
    p = model.bytes.ones_of(inputs, gate, place)[0].astype(float)  # any predictions of the 255 inner nodes of a byte
    total = sum(math.prod(p[(1 << d | b >> 8 - d) - 1] if b >> 7 - d & 1 else 1 - p[(1 << d | b >> 8 - d) - 1] for d in range(8)) for b in range(256))
    assert total == pytest.approx(1, abs=1e-9)


def test_language_model_answers_tell_shared_bits_once():
    """What entries of one context share is told with the first of them, and all comes back."""
    rng = np.random.default_rng(4)
    pairs = np.unique(np.stack([rng.integers(0, 60, 30_000).astype(np.uint64), rng.integers(0, 1 << 12, 30_000).astype(np.uint64) << np.uint64(52)]), axis=1)
    of, u, n0, other = lm_model.totals(*pairs, rng.integers(0, 5, pairs.shape[1]))
    off = np.cumsum(u) - u
    for share in (1.0, 0.3, 0.0):  # of all entries, as a block asks for them
        own = np.flatnonzero(rng.random(len(of)) < share)
        (ctx, syms), i = pairs[:, own], of[own]
        told = lm_model.told_once(ctx, syms, u[i], off[i], other)
        assert np.array_equal(lm_model.told_whole(ctx, syms, u[i], told), other[lm_model.ragged(off[i], u[i])])
        assert not share or len(told) < 0.6 * u[i].sum()


def test_language_model_entries_are_ordered_by_whole_symbols():
    rng = np.random.default_rng(5)
    ctx = rng.integers(0, 50, 4000).astype(np.uint64) << np.uint64(42)
    syms = rng.integers(0, 8, 4000).astype(np.uint64) << np.uint64(60) | rng.integers(0, 8, 4000).astype(np.uint64) << np.uint64(40)
    for n in (4000, 1, 0):
        order, want = lm_model.in_order(ctx[:n], syms[:n]), np.lexsort((syms[:n], ctx[:n]))
        assert sorted(order.tolist()) == list(range(n))
        assert np.array_equal(ctx[order], ctx[want]) and np.array_equal(syms[order], syms[want])


def test_language_model_totals():
    rng = np.random.default_rng(3)
    ctx = rng.integers(0, 40, 3000).astype(np.uint64)
    syms = rng.integers(0, 64, 3000).astype(np.uint64) << np.uint64(58)
    counts = rng.integers(0, 5, 3000)
    of, u, n0, other = lm_model.totals(ctx, syms, counts)
    off = np.cumsum(u) - u
    data = lm_model.packed_answer(u[of], n0[of], other[lm_model.ragged(off[of], u[of])])
    assert all(np.array_equal(a, b) for a, b in zip(lm_model.opened_answer(data, 3000), (u[of], n0[of], other[lm_model.ragged(off[of], u[of])]), strict=True))
    for i in range(0, 3000, 37):
        e, now = of[i], n0[of[i]]
        for d in range(7):
            assert now == counts[(ctx == ctx[i]) & (syms >> np.uint64(64 - d) == syms[i] >> np.uint64(64 - d) if d else ctx == ctx[i])].sum()
            if d < u[e]:
                now -= other[off[e] + d]


def test_texts_that_occur_twice_stand_out(spark):
    texts = [t for t in prose(9, 400, 3000) if len(t.split()) > 20]
    d = table(spark, [*texts, *texts[:20]])
    got = {r["doc_id"]: r for r in lm_score.scored(d).collect()}
    learned = lambda i: not got[i]["held_out"]  # noqa: E731  the other copy must be learned from
    twice = [got[a]["bits_per_byte"] for i in range(20) for a, b in ((i, len(texts) + i), (len(texts) + i, i)) if learned(b)]
    once = [got[i]["bits_per_byte"] for i in range(20, len(texts))]
    assert max(twice) < np.quantile(once, 0.05)


def test_language_model_takes_long_texts_in_pieces(spark):
    d = table(spark, [*lm_texts(50), " ".join(lm_texts(300, 8)), "x" * 5000])
    small = {r["doc_id"]: r for r in lm_score.scored(d, block_bytes=2000).collect()}
    large = {r["doc_id"]: r for r in lm_score.scored(d).collect()}
    assert all(small[i][c] == large[i][c] for i in large for c in ("n_tokens", "n_known", "train_tokens", "held_out"))
    assert all(small[i]["base_score"] == pytest.approx(large[i]["base_score"]) for i in large)
    assert small[50]["score"] == pytest.approx(large[50]["score"], rel=0.15)


def test_language_model_odd(spark):
    got = lm_score.scored(odd(spark)).collect()
    assert len(got) == 12 and all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm_score.scored(empty(spark)).count() == 0
    assert all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (1, 2, 3))


# ---------------------------------------------------------------- 7


def plain_components(texts, k, t):
    sets = {}
    for i, x in texts.items():
        w = (x or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= t * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= t * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("k", "t"), [(4, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, t):
    rng = random.Random(k)
    texts = [""] * 2 + ["One two", "one TWO", "three"]
    for size in (4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 20, 30, 50, 80, 130, 300, 900):
        base = " ".join(f"b{rng.randrange(10**6)}" for _ in range(size))
        texts.append(base)
        texts += [edited(rng, base, n) for n in (0, 1, 1, 2, 3, max(1, size // 60), max(1, size // 40), max(1, size // 25))]
        texts += [" ".join(base.split()[: max(1, size - n)]) for n in (1, 2, max(1, size // 8), max(1, size // 6))]
        texts += [base + " " + " ".join(f"c{rng.randrange(10**6)}" for _ in range(n)) for n in (1, 2, max(1, size // 9))]
    passage = " ".join(f"p{i}" for i in range(12))
    texts += [passage + " " + " ".join(f"d{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 40))) for _ in range(60)]
    group = " ".join(f"g{i}" for i in range(100))
    texts += [edited(rng, group, rng.randrange(0, 6)) for _ in range(60)]
    d = table(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(d, k, t, block=24).collect()}
    want = plain_components(dict(enumerate(texts)), k, t)
    assert got == want


def test_long_chains_are_verified_pair_by_pair(spark, monkeypatch):
    """A chain of sets, each like the next: no block compares them all, and none is lost."""
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words[4 * i : 4 * i + 100]) for i in range(700)]  # 4 of 100 words move on
    texts += [" ".join(f"x{j}y{i}" for j in range(60)) for i in range(20)]
    d = table(spark, texts)
    seen = []
    own = ngram_join.paired_links
    monkeypatch.setattr(ngram_join, "paired_links", lambda *a: seen.append(a[2].count()) or own(*a))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(d, 5, 80, block=24).collect()}
    assert seen and seen[0] <= ngram_join.SPARSE * 700
    assert {got[i] for i in range(700)} == {0} and all(got[i] == i for i in range(700, 720))


def test_near_duplicates_on_given_documents(spark):
    d = docs(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op7_ngram_join(spark, DATA).collect()}
    assert got == plain_components({r["doc_id"]: r["text"] for r in d.collect()}, 4, 85)


def test_differences_change_at_most_one_cell():
    rng = np.random.default_rng(0)
    for size in (10, 60, 200, 1000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:-1], rng.integers(0, 1 << 63, 1, dtype=np.uint64)]))
        x, y = ngram_join.keys_of(a, 85)[0], ngram_join.keys_of(b, 85)[0]
        if size >= 200:
            assert len(np.setdiff1d(x, y)) <= 2
        assert size < 14 or len(np.intersect1d(x, y))


def test_similar_sets_share_as_many_keys_as_their_cells_leave():
    """Of each two similar sets, down to the bound: the keys they share in the join of the smaller one's band are no fewer than either set's cells leave."""
    rng = np.random.default_rng(1)
    for t, size in itertools.product((80, 85), (8, 12, 20, 33, 58, 59, 80, 92, 93, 120, 300, 700)):
        most = max(ngram_join.max_difference(s, t) for s in (2 * size, 2 * size + 1))
        for apart in range(0, most + 1, max(1, most // 4)):
            for less in {0, apart // 2, apart}:
                pool = rng.integers(0, 1 << 63, size + apart, dtype=np.uint64)
                a, b = np.unique(pool[:size]), np.unique(pool[less : size + apart - less])
                both = len(np.intersect1d(a, b))
                if 100 * both < t * (len(a) + len(b) - both):
                    continue
                a, b = sorted((a, b), key=len)
                step = ngram_join.band_of(len(b), t) - ngram_join.band_of(len(a), t)
                (x, spare_x), (y, spare_y) = ngram_join.keys_and_spare(a, t)[0], ngram_join.keys_and_spare(b, t)[step]
                if ngram_join.parts_of(ngram_join.band_of(len(a), t), t)[0]:
                    assert len(np.intersect1d(x, y)) >= ngram_join.WITNESSES + max(spare_x, spare_y), (t, size, apart, less)


def test_near_duplicates_odd(spark):
    got = ngram_join.near_duplicates(odd(spark)).collect()
    assert len(got) == 12
    of = {(r["doc_id"], r["n_shingles"] > 0): r["component_id"] for r in got}
    assert of[1, False] == 1 and of[2, False] == 2 and of[4, True] == of[5, True] == of[None, True] == 4 and of[None, False] is None and of[7, True] == of[6, True] == 6
    assert ngram_join.near_duplicates(empty(spark)).count() == 0
    kept = ngram_join.one_of_each(odd(spark))
    assert kept.columns == empty(spark).columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} >= {1, 2, 3, 4, 6, 8, 9}
    assert not {5, 7} & {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_one_of_each_component_whatever_the_ids(spark):
    """Unlike texts under null ids, or under one id, are components of their own; near copies among them still go."""
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1] + " z"), (7, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[4] + " z"), (9, texts[5]), (None, " ")]
    d = spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in rows], SCHEMA)
    kept = collections.Counter((r["doc_id"], (r["text"].split() or [""])[0][:1]) for r in ngram_join.one_of_each(d).collect())
    assert kept == {(None, "a"): 1, (None, "b"): 1, (7, "c"): 1, (7, "d"): 1, (7, "e"): 1, (9, "f"): 1, (None, ""): 1}


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 8


def test_exact_duplicates(spark):
    con = duck("documents")
    got = sorted(map(tuple, queries.op8_exact_dedup(spark, DATA).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    want = sorted(con.execute(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({exact_dedup.SQL})").fetchall())
    assert got == want


def test_exact_duplicates_odd(spark):
    got = exact_dedup.exact_groups(odd(spark)).collect()
    assert len(got) == 12
    ones = [r for r in got if r["text_sha256"] == hashlib.sha256(b"one").hexdigest()]
    assert {r["keep_id"] for r in ones} == {5} and {r["group_size"] for r in ones} == {4} and sum(r["kept"] for r in ones) == 2
    none = [r for r in got if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert {r["keep_id"] for r in none} == {2} and len(none) == 3
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    kept = exact_dedup.drop_exact(odd(spark))
    assert kept.columns == empty(spark).columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 6, 7, 8, 9]
    prefix = "p" * 300
    t = table(spark, [prefix + "a", prefix + "b", prefix + "a"])
    assert [r["group_size"] for r in exact_dedup.exact_groups(t).orderBy("doc_id").collect()] == [2, 1, 2]


CLASHING = ["doc_id", "text", "lang", "tag", "__tag", "__own", "__id", "__sha", "__n", "n", "len", "prefix", "sha", "rest", "k0", "c0", "root", "keep", "node", "chunk", "data", "Text"]


def clashing(spark):
    """Columns named as operators might name theirs, one of them a struct, one apart from another in case only."""
    spark.conf.set("spark.sql.caseSensitive", "true")
    rows = [(i, t, "en", *[f"{c}{i}" for c in CLASHING[3:]]) for i, t in enumerate([*prose(12, 30, 50), "same words here", "same words here", None, None])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING[3:]))


@pytest.mark.parametrize("stage", ["accepted", "drop_exact", "one_of_each", "without_repeats"])
def test_clashing_columns_come_back(spark, stage):
    try:
        d = clashing(spark)
        if stage == "accepted":
            out = quality.accepted(d, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
        else:
            out = {"drop_exact": exact_dedup.drop_exact, "one_of_each": ngram_join.one_of_each, "without_repeats": suffix_dedup.without_repeats}[stage](d)
        assert out.columns == d.columns and out.schema["doc_id"].dataType == d.schema["doc_id"].dataType
        whole = {tuple(r) for r in d.collect()}
        got = [tuple(r) for r in out.collect()]
        assert got and set(got) <= whole and len(set(got)) == len(got)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_hot_copies_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_HEAVY", 20)
    texts = ["hot"] * 400 + ["warm"] * 5 + [f"w{i % 150}" for i in range(300)] + ["x" * 300 + str(i % 3) for i in range(90)]
    d = table(spark, texts)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(d).collect()}
    last, size = {t: i for i, t in enumerate(texts)}, collections.Counter(texts)
    assert got == {i: (last[t], size[t]) for i, t in enumerate(texts)}
    assert {r["doc_id"] for r in exact_dedup.drop_exact(d).collect()} == set(last.values())


def test_native_operators_run_no_python(spark):
    plan = exact_dedup.exact_groups(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    pages = docs(spark, "pages")
    listed = url_filter.listing(url_filter.RULES, url_filter.listed_urls(pages))
    plan = url_filter.judged(pages, listed, [4, 5], 2)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert all("html:string" not in line for line in plan.split("\n") if "ReadSchema" in line)


# ---------------------------------------------------------------- 9


def test_bpe(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = bpe.encoding(path)
    for d in (docs(spark), odd(spark), empty(spark)):
        got = collections.Counter(map(tuple, bpe.round_trip(d, path).collect()))
        want = collections.Counter()
        for r in d.collect():
            ids = enc.encode_ordinary(r["text"] or "")
            want[(r["doc_id"], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
        assert got == want
    ids = bpe.encoded(docs(spark), path)
    back = {r["doc_id"]: bytes(r["data"]).decode() for r in bpe.decoded(ids, path).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs(spark).collect()}


@pytest.mark.parametrize("run", [" ", "\n", "\t", "\u00a0", " \n", "\u3000"])
def test_long_runs_of_white_space(run):
    """Runs on which the library's pattern overflows: equal to the library below that, and to the pattern's definition beyond."""
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = lambda t: np.frombuffer(bpe.encode_bytes(enc, t), dtype="<u4").tolist()
    around = [("", ""), ("a", ""), ("", "b"), ("word,", "word"), ("1 ", " !"), ("\x1c", "\x1c")]
    for before, after in around:
        for n in (bpe.RUN - 1, bpe.RUN, 10**5):
            text = before + run * n + after
            assert ids(text) == enc.encode_ordinary(text)
    for n in (10**6, 10**7) if run in " \n" else (10**6,):
        text = "word," + run * (n // len(run)) + "word"
        got = bpe.encode_bytes(enc, text)
        assert bpe.decode_bytes(enc, got) == text.encode()
        first, last = enc.encode_ordinary("word,"), enc.encode_ordinary(run[-1] + "word")
        middle = enc._core_bpe.encode_single_piece((run * (n // len(run)))[:-1].encode())
        assert np.frombuffer(got, dtype="<u4").tolist() == first + middle + last


def test_safe_boundaries():
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(7)
    alphabet = ["a", "é", " ", "  ", "\n", "'s", "1", "!", "\u00a0", "word", "漢", "<|endoftext|>", "\t "]
    for size in (1, 5, 50):
        for _ in range(40):
            text = "".join(rng.choice(alphabet) for _ in range(300))
            parts = list(bpe.pieces(text, size))
            assert "".join(parts) == text
            assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    assert list(bpe.pieces("x" * 500, 10)) == ["x" * 500]


# ---------------------------------------------------------------- 10


def plain_cover(texts, n=50):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    where = collections.defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - n + 1):
            where[tuple(w[j : j + n])].add(i)
    out = {i: set() for i in words}
    for i, w in words.items():
        for j in range(len(w) - n + 1):
            if len(where[tuple(w[j : j + n])]) > 1:
                out[i].update(range(j, j + n))
    return out


def passages(seed):
    rng = random.Random(seed)
    shared = [[f"s{p}x{i}" for i in range(n)] for p, n in enumerate((30, 49, 50, 51, 60, 120, 400))]
    texts = []
    for _ in range(70):
        parts = [[f"u{rng.randrange(10**7)}" for _ in range(rng.randrange(0, 90))] for _ in range(3)]
        for p in rng.sample(shared, rng.randrange(0, 3)):
            a = rng.randrange(0, max(1, len(p) - 40))
            parts.insert(rng.randrange(4), p[a:] if rng.random() < 0.4 else p)
        texts.append(" ".join(w for part in parts for w in part))
    own = " ".join(f"r{i}" for i in range(60))
    texts += [own + " z " + own, "q " * 300, "q " * 200 + "end"]
    return texts


def test_repeated_passages_equal_brute_force(spark):
    texts = passages(8)
    d = table(spark, texts)
    got = collections.defaultdict(set)
    for r in suffix_dedup.repeated_spans(d).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
        cut = texts[r["doc_id"]][r["start_char"] : r["end_char"]]
        assert cut.split() == texts[r["doc_id"]].split()[r["start_word"] : r["end_word"]] and r["n_words"] >= 50
    want = plain_cover(dict(enumerate(texts)))
    assert all(got.get(i, set()) == c for i, c in want.items())
    assert not got.get(70)  # a passage that repeats in one document only


def test_cut_texts_hold_no_repeats_and_lose_nothing_else(spark):
    texts = passages(9)
    out = suffix_dedup.without_repeats(table(spark, texts))
    assert out.columns == empty(spark).columns
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    want = plain_cover(dict(enumerate(texts)))
    assert all(left[i] == t for i, t in enumerate(texts) if not want[i])
    seen = collections.Counter()
    for t in left.values():
        w = t.split()
        seen.update({tuple(w[j : j + 50]) for j in range(len(w) - 49)})
    assert max(seen.values()) == 1
    windows = {tuple(t.split()[j : j + 50]) for t in texts for j in range(len(t.split()) - 49)}
    whole = {w for w in windows if seen[w]}
    alone = [w for w in windows if sum(1 for t in texts if " ".join(w) in t) == 1]
    assert all(w in whole for w in alone if all(not want[i] for i, t in enumerate(texts) if " ".join(w) in t))


def test_minimisers_follow_from_content():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 62, 500, dtype=np.uint64)
    g = chunks.grams(words, 18)
    assert len(g) == 483 and np.array_equal(chunks.grams(words[7:], 18), g[7:])
    low = chunks.sliding(g, 33, np.minimum)
    assert all(low[i] == g[i : i + 33].min() for i in range(len(low)))
    assert len(chunks.grams(words[:5], 18)) == 0


def test_repeated_passages_odd(spark):
    spans = suffix_dedup.repeated_spans(odd(spark)).collect()
    assert {r["doc_id"] for r in spans} == {6, 7}
    assert suffix_dedup.repeated_spans(empty(spark)).count() == 0 and suffix_dedup.without_repeats(empty(spark)).count() == 0
    kept = suffix_dedup.without_repeats(odd(spark)).collect()
    assert sum(r["text"] is None for r in kept) == 2 and len(kept) >= 11
