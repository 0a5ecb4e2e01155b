"""Each corpus operator against a plain brute-force version, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfspark.llm import ann, components, fmindex, langid, linededup, mixing, packing, secrets, simhash, substrings, tokenfile, topk
from shelfspark.llm import vectors as vectors_
from shelfspark.llm.tokenize import CachedEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, cut string, hot int, shard long"


def vocabulary(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéñ") for _ in range(rng.randint(1, 8))) for _ in range(n)]


def awkward_texts():
    """Copies, near copies, shared passages and lines, repeats, empty and odd texts."""
    rng, words = random.Random(3), vocabulary(400)
    passage = [rng.choice(words) for _ in range(80)]
    base = [rng.choice(words) for _ in range(300)]
    texts = [None, "", " ", "\n\n", "one", "a  b\tc\r\nd", "x" * 5000, "ñ é 漢字 😀 İſ", "Share this page\nShare this page"]
    for i in range(40):
        own = [rng.choice(words) for _ in range(rng.randint(1, 150))]
        if i % 3 == 0:
            own = own[: len(own) // 2] + passage[rng.randint(0, 20) :] + own[len(own) // 2 :]
        if i % 4 == 0:
            own = list(base)
            own[rng.randrange(300)] = "changed"
        lines = [" ".join(own[k : k + 20]) for k in range(0, len(own), 20)]
        texts.append("\n".join(["Share this page ", *lines, "All rights reserved"] if i % 2 else lines))
    texts += [texts[12]] * 5
    texts.append(" ".join(rng.choice(words) for _ in range(6000)))
    texts.append(" ".join(["again"] * 400))
    texts.append(" ".join(passage * 6))
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, ("en", "fr", None)[i % 3], None if i % 11 == 5 else f"s{i // 2 % 12}" if i % 5 else "s0", len(t or ""), "x", i, i) for i, t in enumerate(awkward_texts())]
    rows.append(rows[20])  # a repeated row
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def collected(df):
    return [r.asDict() for r in df.collect()]


def by_id(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# 1


def brute_spans(text):
    text, out = text or "", []
    rules = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    ]
    for k, (name, p, g, n) in enumerate(rules):
        for m in re.compile(p, re.ASCII).finditer(text):
            if len(m[g]) >= n:
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


SECRETS = [
    'é password = "hunter2hunter2" and TOKEN:abc', "secret=token:abcdefgh1", "AKIAABCDEFGHIJKL AKIAKIAABCDEFGH AKIA123", "0123456789abcdef" * 2 + " " + "deadbeef" * 7,
    "api_key='x'  apikey: ABCDEFGH/+=._-", "😀 passwd:=12345678 passwd==12345678", "token" + " " * 500 + "= " + "a" * 3000, None, "", "PASSWORD=aaaaaaaa" * 3,
]


def test_secret_spans_and_ledger(spark, docs, tmp_path):
    rows = [(i, t) for i, t in enumerate(SECRETS)] + [(100 + i, t) for i, t in enumerate(SECRETS)]
    versions = spark.createDataFrame([*rows, (None, SECRETS[0])], "path long, text string")
    ledger = str(tmp_path / "ledger")
    got = {r.path: r.s for r in secrets.scan(versions.filter("path < 100"), ledger=ledger).select("path", secrets.named(F.col("spans")).alias("s")).collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(SECRETS)}
    scanned = spark.read.parquet(ledger).count()
    assert scanned == len({t or "" for t in SECRETS})
    again = {r.path: r.s for r in secrets.scan(versions, ledger=ledger).select("path", secrets.named(F.col("spans")).alias("s")).collect()}
    assert spark.read.parquet(ledger).count() == scanned  # nothing was scanned twice
    assert again == got | {100 + i: x for i, x in got.items()} | {None: got[0]}
    secrets.scan(versions, ledger=ledger, rule_version="base-2")
    assert spark.read.parquet(ledger).count() == 2 * scanned
    assert secrets.scan(versions.limit(0)).count() == 0
    assert secrets.scan(docs, path="doc_id").count() == docs.count()


def test_rules_of_any_form_and_many_matches(spark):
    rules = (secrets.Rule("live", r"sk_live_[a-z]+", 0, 16), secrets.Rule("quoted", r"'([a-z]*)'", 1, 3))
    many = "é" + "token=abcdefgh1 x" * 100_000 + "f" * 40  # over a megabyte
    rows = [(0, "sk_live_abcdefgh sk_live_abc 'ab' 'abc'"), (1, many), (2, "'" + "z" * 2_000_000 + "'")]
    versions = spark.createDataFrame(rows, "path long, text string")
    got = {r.path: r.s for r in secrets.scan(versions, rules=rules, rule_version="own").select("path", secrets.named(F.col("spans"), rules).alias("s")).collect()}
    assert got == {0: "live:0:16,quoted:34:39", 1: "", 2: "quoted:0:2000002"}
    base = {r.path: r.s for r in secrets.scan(versions).select("path", secrets.named(F.col("spans")).alias("s")).collect()}
    assert base[1] == brute_spans(many) and base[0] == base[2] == ""


# 2


def test_fingerprint_of_a_long_text(docs):
    rng, words = random.Random(4), vocabulary(200)
    text = " ".join(rng.choice(words) for _ in range(70_000))
    w = text.split(" ")
    h = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    assert simhash.fingerprint(text, 3)[0] % (1 << 64) == want


def brute_fingerprint(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, near):
    """Smallest name reachable; nodes: (name, value)."""
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if near(nodes[i][1], nodes[j][1]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: float("inf"))
    for i, (name, _) in enumerate(nodes):
        least[find(i)] = min(least[find(i)], name)
    return {name: least[find(i)] for i, (name, _) in enumerate(nodes)}


def test_simhash_components(docs, nothing):
    texts = by_id(docs)
    fp = {k: brute_fingerprint(t, 3) for k, t in texts.items()}
    want = brute_components(list(fp.items()), lambda a, b: (a ^ b).bit_count() <= 2)
    got = simhash.components(docs).select("doc_id", simhash.hexed(F.col("fp")).alias("f"), "component_id").collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (int(r.f, 16), r.component_id) for r in got} == {k: (fp[k], want[k]) for k in texts}
    assert simhash.components(nothing).count() == 0


@pytest.mark.parametrize("links,distance", [(lambda f: simhash.near_links(f, hot_bucket=3), 2), (simhash.near_links, 2), (lambda f: simhash.block_links(f, 5), 5), (lambda f: simhash.block_links(f, 3), 3)])
def test_links_of_dense_and_sparse_fingerprints(spark, links, distance):
    rng = random.Random(distance)
    values = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(4):  # clusters of many near values
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(values)]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = links(fps)
    pairs = [(r.a, r.b) for r in found.collect()]
    assert all(0 < ((a ^ b) & (2**64 - 1)).bit_count() <= distance for a, b in pairs)
    got = {r.node: r.root for r in components.connected_components(found).collect()}
    want = brute_components([(x, x & (2**64 - 1)) for x in signed], lambda a, b: (a ^ b).bit_count() <= distance)
    assert {x: got.get(x, x) for x in signed} == want


def broadcast_rows(plan):
    """Rows of each table that a plan has broadcast; stages and adaptive plans are opened."""
    kind = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
    below = plan.children()
    own = [plan.metrics().apply("numOutputRows").value()] if kind == "BroadcastExchangeExec" else []
    return own + [n for p in inner + [below.apply(i) for i in range(below.size())] for n in broadcast_rows(p)]


@pytest.mark.parametrize("dense", [False, True])
def test_looked_up_words_are_not_broadcast(spark, tmp_path, dense):
    rng = random.Random(12)
    if dense:  # one hot bucket: the low 32 bits are equal, the others have at most three ones
        values = {sum({1 << rng.randrange(32, 63) for _ in range(3)}) for _ in range(5000)}
    else:
        values = {rng.getrandbits(63) for _ in range(3000)}
        values |= {x ^ 1 << rng.randrange(63) for x in sorted(values)[:200]}
    spark.createDataFrame([(x,) for x in sorted(values)], "fp long").coalesce(1).write.parquet(f"{tmp_path}/fps")
    fps = spark.read.parquet(f"{tmp_path}/fps")  # a file, whose size the planner knows
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    found = {}
    try:
        for limit in ("300k", "-1"):
            spark.conf.set(threshold, limit)
            links = simhash.near_links(fps)
            found[limit] = sorted(tuple(r) for r in links.collect())
            assert max([0, *broadcast_rows(links._jdf.queryExecution().executedPlan())]) <= len(values)
    finally:
        spark.conf.set(threshold, before)
    assert found["300k"] == found["-1"] and len(found["-1"]) >= 200


def test_large_buckets_give_a_forest():
    rng = random.Random(21)
    centre, values = rng.getrandbits(63), set()
    while len(values) < 400:  # one bucket: the low 21 bits are the centre's, or one bit off
        x = centre
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(21, 63)
        values.add(x ^ (1 << rng.randrange(21) if rng.random() < 0.4 else 0))
    fp = np.array(sorted(values), np.int64)
    own = (fp & (2**21 - 1)) == (centre & (2**21 - 1))
    found = fp[np.concatenate(simhash._ball_links(fp[:, None], own, np.array([0]), np.array([len(fp)]), 5), axis=1)]
    assert found.shape[1] < len(fp)
    linked = {frozenset(p) for p in found.T.tolist()}
    # the same components as all links with a member of the bucket at one end
    allowed = {frozenset((a, b)) for a in fp[own].tolist() for b in fp.tolist() if a != b and (a ^ b).bit_count() <= 5}
    assert linked <= allowed
    nodes = [(x, x) for x in fp.tolist()]
    assert brute_components(nodes, lambda a, b: frozenset((a, b)) in linked) == brute_components(nodes, lambda a, b: frozenset((a, b)) in allowed)


def test_links_of_two_bits_in_every_segment(spark):
    rng, values, pairs = random.Random(8), set(), set()
    for n in (16, 17, 19, 21):  # eight segments of sixteen bits, two or three bits in each
        for _ in range(20):
            x = y = rng.getrandbits(128)
            for s in range(8):
                for i in rng.sample(range(16), 2 + (s < n - 16)):
                    y ^= 1 << 16 * s + i
            pairs.add((x, y))
            values |= {x, y}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = {x: (signed(x & (2**64 - 1)), signed(x >> 64)) for x in values}
    fps = spark.createDataFrame(list(rows.values()), "fp long, fp2 long")
    named = {(r.fp, r.fp2): r.node for r in fps.select("fp", "fp2", simhash.node(2).alias("node")).collect()}
    near = {frozenset(named[rows[v]] for v in (x, y)) for x in values for y in values if x < y and (x ^ y).bit_count() <= 21}
    assert len(near) >= len(pairs)
    assert {frozenset(r) for r in simhash.block_links(fps, 21, 2, 4).collect()} == near


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(docs, nothing):
    sets = [(k, shingle_set(t)) for k, t in by_id(docs).items()]
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(set(brute_components(sets, alike).values()))
    assert simhash.deduplicate(nothing).count() == 0


def test_large_buckets_are_dealt_in_parts(spark, monkeypatch):
    """Both rounds with parts of a few rows find what they find with whole buckets."""
    monkeypatch.setattr(simhash, "PART_ROWS", 7)
    rng, words = random.Random(5), vocabulary(500, 3)
    texts = []
    for size in (120, 60):
        body = [rng.choice(words) for _ in range(size)]
        for _ in range(60):
            copy = list(body)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(size)] = rng.choice(words)
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [(i, shingle_set(t)) for i, t in enumerate(texts)]
    want = sorted(set(brute_components(sets, alike).values()))
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == want and 2 < len(want) < 100
    rows = simhash.shingled(docs, 5)
    nodes = rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("fp2").alias("fp2"), F.min("text_hash").alias("text_hash")).withColumn("root", F.col("node"))
    pairs = [{tuple(r) for r in simhash.rare_pairs(docs, nodes, np.zeros(0, np.int64), 5, part).collect()} for part in (7, 4096)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 100


def test_edited_copies_go_and_others_stay(spark):
    rng, words = random.Random(31), vocabulary(3000, 5)
    rows, originals = [], 60
    for i in range(originals):
        text = [rng.choice(words) for _ in range(rng.randint(200, 400))]
        rows.append((i, " ".join(text)))
        for edits in (1, 2, 4):  # five-word similarities from about 0.99 to 0.87
            copy = list(text)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "edited"
            rows.append((1000 * edits + i, " ".join(copy)))
    left = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left >= set(range(originals)) and len(left) <= originals * 1.1


def shingle_set(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def alike(a, b):
    """A Jaccard similarity of 0.8 or more; texts without a word are alike."""
    return 10 * len(a & b) >= 8 * len(a | b)


def test_groups_are_those_of_the_similarity(spark):
    rng, words = random.Random(77), vocabulary(3000, 6)
    texts = ["", " ", "one", "one two", "Again again " * 40, "again " * 9]
    for shared in range(300, 440, 4):  # similarities from about 0.43 to 0.98, on both sides of 0.8
        text = [rng.choice(words) for _ in range(500)]
        texts += [" ".join(text), " ".join(text[: shared + 50] + [rng.choice(words) for _ in range(450 - shared)])]
    body = [rng.choice(words) for _ in range(200)]
    for _ in range(150):  # a large group, whose members share a bucket
        copy = list(body)
        copy[rng.randrange(200)] = "edited"
        texts.append(" ".join(copy))
    # one shingle repeated often doesn't make two texts alike
    texts += ["say it again and again " * 60 + " ".join(rng.choice(words) for _ in range(60)) for _ in range(2)]
    sets = [(i, shingle_set(t)) for i, t in enumerate(texts)]
    want = sorted(set(brute_components(sets, alike).values()))
    out = simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in out.collect()) == want


def test_all_cross_pairs_of_a_bucket():
    rng = np.random.default_rng(9)
    n, root = rng.integers(20, 40, 700), np.where(rng.random(700) < 0.6, 5, rng.integers(0, 40, 700))
    at = rng.integers(0, 6, 700)
    got = [tuple(sorted(p)) for part in simhash._cross_pairs(n, at, root) for p in part.T.tolist()]
    can = lambda i, j: 9 * min(n[i] - at[i], n[j] - at[j]) >= 4 * (n[i] + n[j])
    assert sorted(got) == [(i, j) for i in range(700) for j in range(i + 1, 700) if root[i] != root[j] and can(i, j)]


def test_marks_leave_no_similar_pair_out():
    rng = np.random.default_rng(10)
    sets, roots = [], []
    for g in range(24):
        body = rng.integers(-(1 << 62), 1 << 62, rng.integers(30, 300))
        for share in (1.0, 0.97, 0.92, 0.89, 0.85, 0.8, 0.6):
            own = rng.integers(-(1 << 62), 1 << 62, len(body))
            sets.append(np.unique(np.where(rng.random(len(body)) < share, body, own)))
    sets.append(np.zeros(0, np.int64))
    n, mark = np.array([len(x) for x in sets]), np.stack([simhash._mark(x) for x in sets])
    zero, root = np.zeros(len(n), np.int64), np.arange(len(n))
    pairs = lambda *m: {tuple(sorted(p)) for part in simhash._cross_pairs(n, zero, root, *m) for p in part.T.tolist()}
    common = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    want = {(i, j) for i, j in pairs() if 9 * common(i, j) >= 4 * (n[i] + n[j])}
    assert len(want) > 50 and want <= pairs(mark) and len(pairs(mark)) < 2 * len(want) < len(pairs())


def test_null_ids_keep_their_text(spark):
    rows = [(None, "a b c d e f g"), (None, "quite another text that has nothing to do with it"), (4, "a b c d e f g"), (4, "a b c d e f g")]
    out = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in out) == [(0, "q"), (4, "a")]


# 3


def filled(sizes):
    """Targets by repeated sharing, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, target = sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    open_ = {s for s in sizes}
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s, x in share.items():
            room = 3 * sizes[s] - target[s]
            target[s] += min(x, room)
            if x >= room:
                left += x - room
                open_.discard(s)
    return target


def test_mix_hits_its_targets(docs, nothing):
    mixed = mixing.mix(docs, block=8)
    got = collected(mixing.taken(mixed))
    rows = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()]
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    want, source_of = filled(sizes), {k: s for k, s, _ in rows}
    assert sorted((r["doc_id"], r["size"], r["source_size"]) for r in got) == sorted((k, n, sizes[s]) for k, s, n in rows)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[source_of[r["doc_id"]]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source_of[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 16 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, collected(mixing.taken(mixing.mix(docs, block=8)))))
    assert mixing.taken(mixing.mix(nothing)).count() == 0


def test_permutation_is_one(spark):
    df = spark.range(1000).select(F.explode(F.array(*(F.lit(n).cast("long") for n in (1, 2, 7, 1000)))).alias("n"), F.col("id").alias("x"), F.lit(3).cast("long").alias("k")).filter("x < n")
    for n in (1, 2, 7, 1000):
        got = [r.x for r in mixing.permuted(df.filter(F.col("n") == n), "x", "n", ["k"], 5).collect()]
        assert sorted(got) == list(range(n)) and (n < 1000 or got != list(range(n)))


def test_shards_and_mixed_documents(docs, nothing):
    mixed = mixing.mix(docs, block=8, slots=16)
    draws = {r.sid: (r.draws, r.blocks) for r in mixed.sources.collect()}
    total = sum(n for n, _ in draws.values())
    slots = mixed.pieces.select("sid", "shard", "i", "epoch", "block").distinct().collect()
    # every slot is one source's; each source's indexes are used once, each pass has a block once
    assert Counter(r.sid for r in slots) == {k: n for k, (n, _) in draws.items() if n} and sorted(Counter(r.shard for r in slots).values())[1:] == [16] * ((total - 1) // 16)
    assert sorted((r.sid, r.i) for r in slots) == sorted((k, i) for k, (n, _) in draws.items() for i in range(n))
    assert len({(r.sid, r.epoch, r.block) for r in slots}) == total and all(r.epoch == r.i // draws[r.sid][1] < 3 for r in slots)
    # the counts are draws: they vary from shard to shard, and their mean and variance are the multinomial's
    counts = defaultdict(dict)
    for r in mixed.counts.collect():
        counts[r.shard][r.sid] = r.n
    assert all(sum(c.values()) == 16 for k, c in counts.items() if k < total // 16)
    held = Counter((r.shard, r.sid) for r in slots)
    assert {(r.shard, r.sid): r.n for r in mixing.shards(mixed).collect()} == held
    out = mixing.mixed_documents(docs, block=8)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    taken = defaultdict(int)
    for r in collected(mixing.taken(mixed)):
        taken[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in taken.items() if v} == dict(words)
    assert mixing.mixed_documents(nothing).count() == 0


def test_shard_counts_are_multinomial(spark):
    share = {0: 30_000, 1: 50_000, 2: 20_000, 3: 0}
    sources = spark.createDataFrame(list(share.items()), "sid long, draws long")
    counts, drawn = mixing.draw(sources, 100_000, 1000, 4)
    got = defaultdict(lambda: np.zeros(100, int))
    for r in counts.collect():
        got[r.sid][r.shard] = r.n
    for k, n in share.items():
        p = n / 100_000
        assert abs(got[k].mean() - 1000 * p) <= 5 * np.sqrt(1000 * p * (1 - p) / 100)
        assert 0.5 * 1000 * p * (1 - p) <= got[k].var() <= 1.7 * 1000 * p * (1 - p)
    # independent from shard to shard
    assert abs(np.corrcoef(got[1][:-1], got[1][1:])[0, 1]) < 0.35
    # settled to what each source needs, and little was drawn again
    assert {r.sid: (r.n, r.m) for r in drawn.groupBy("sid").agg(F.count("i").alias("n"), F.countDistinct("i").alias("m")).collect()} == {k: (n, n) for k, n in share.items() if n}
    after = {(r.shard, r.sid): r["count"] for r in drawn.groupBy("shard", "sid").count().collect()}
    assert sum(abs(after.get((s, k), 0) - got[k][s]) for k in share for s in range(100)) < 0.02 * 100_000


def test_draws_of_a_few_blocks(spark):
    sources = spark.createDataFrame([(i, i % 3) for i in range(50)], "sid long, draws long")
    _, drawn = mixing.draw(sources, 49, 1, 9)
    assert sorted((r.sid, r.i) for r in drawn.collect()) == [(i, j) for i in range(50) for j in range(i % 3)]
    assert sorted(r.shard for r in drawn.collect()) == list(range(49))


def test_null_ids_and_sources_mix(spark):
    rows = [(None, f"w{i} x y z", "a" if i % 2 else None) for i in range(60)] + [(7, "same text here", "a"), (7, "same text here", "b"), (7, "same text here", "b"), (8, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(mixing.mix(docs, block=4, slots=8)).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    words = sum(len(r.text.split()) for r in mixing.mixed_documents(docs, block=4).collect())
    assert words == sum(r.taken for r in mixing.taken(mixing.mix(docs, block=4)).collect())


# 4 and 8


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def test_cached_encoder_is_the_library(plain):
    texts = awkward_texts() + ["a.b c,d e),", "don't we'll 12 3\x1c4 5", " a　b", "<|endoftext|> x", "tail ", " head", "l'an d'un.", "á b", "a\x85b c", "x\n y", "x \ny"]
    for cache in (10, 10_000):
        enc = CachedEncoder(TOKENIZER, 2, cache_chunks=cache)
        for part in (texts, texts[::-1], texts[5:9]):
            got = enc.encode(part)
            assert [x.tolist() for x in got] == [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in part]


def test_codes_give_random_access():
    rng = np.random.default_rng(1)
    for values in ([], [0], [255, 256, 65535, 65536, 2**32 - 1], rng.integers(0, 50_000, 3000), rng.integers(0, 100, 64), 1 << rng.integers(0, 40, 1000)):
        values = np.array(values, np.uint64)
        codes = tokenfile.Codes.of(values)
        back, _ = tokenfile.Codes.load(memoryview(codes.dump()), 0)
        assert np.array_equal(back.slice(0, len(values)), values)
        if len(values):
            at = rng.integers(0, len(values), 500)
            assert np.array_equal(back.access(at), values[at])
            for _ in range(20):
                a, b = sorted(rng.integers(0, len(values) + 1, 2))
                assert np.array_equal(back.slice(int(a), int(b)), values[a:b])


def test_token_files_round_trip(spark, docs, nothing, plain, tmp_path):
    path = str(tmp_path / "files")
    got = tokenfile.round_trip(docs, TOKENIZER, path=path, image_tokens=500).orderBy("start").collect()
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.text is not None) + [(r.doc_id, "") for r in docs.collect() if r.text is None]
    rows.sort()
    ids = [np.array(plain.encode(t, add_special_tokens=False).ids + [2], "<u4") for _, t in rows]
    assert [r.doc_id for r in got] == [k for k, _ in rows]
    assert [r.n_tokens for r in got] == [len(x) for x in ids]
    assert [r.start for r in got] == np.cumsum([0, *map(len, ids[:-1])]).tolist()
    assert [r.ids_crc32 for r in got] == [zlib.crc32(x.tobytes()) for x in ids]
    image = tokenfile.TokenImage(spark.read.parquet(path).orderBy("pid", "seg").first().image)
    assert image.doc(0).tolist() == ids[0].tolist() and image.token(len(ids[0]) - 1) == 2
    assert tokenfile.round_trip(nothing, TOKENIZER).count() == 0
    odd = spark.createDataFrame([(None, "x"), (5, "y"), (5, "y"), (-3, None)], "doc_id long, text string")
    assert [r.doc_id for r in tokenfile.round_trip(odd, TOKENIZER).orderBy("start").collect()] == [None, -3, 5, 5]


def test_packing_is_gapless(docs, nothing, plain):
    pieces = packing.pack(docs, TOKENIZER, window=64, with_ids=True)
    got = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    assert [r.sequence_id * 64 + r.offset for r in got] == np.cumsum([0, *(r.length for r in got[:-1])]).tolist()
    want = sorted(tuple(plain.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs.collect())
    docs_, part = [], []
    for r in got:
        assert r.length == len(r.ids) // 4 and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.offset + r.length <= 64
        part = part if r.start else []
        part += np.frombuffer(bytes(r.ids), "<u4").tolist()
        if len(part) == r.doc_tokens:
            docs_.append(tuple(part))
    assert sorted(docs_) == want
    whole = sorted(packing.sequences(pieces, 64).collect(), key=lambda r: r.sequence_id)
    assert b"".join(bytes(r.ids) for r in whole) == b"".join(bytes(r.ids) for r in got)
    assert all(r.n == 64 for r in whole[:-1])
    assert packing.pack(nothing, TOKENIZER).count() == 0


# 5 and 7


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).astype(float).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # copies: ties
    rows += [(2000, None), (2001, []), (2002, [None] * 16), (2003, [float("nan")] * 16), (2004, [float("inf")] * 16), (2005, [0.0] * 16), (2006, [1.0, 2.0]), (2007, [2.0, 1.0]), (None, [1.0] * 16), (3, rows[3][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("clash"))


def valid_vectors(vectors, zero=True):
    out = {}
    for r in vectors.collect():
        v = r.embedding
        if r.vec_id is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out[r.vec_id] = np.array(v, np.float64)
    return out


def brute_top(v, k, score):
    out = {}
    for q in v:
        if q % 20 == 0:
            s = sorted((-score(v[q], v[c]), c) for c in v if c != q and len(v[c]) == len(v[q]))
            out[q] = [(c, -x) for x, c in s[:k]]
    return {q: x for q, x in out.items() if x}


SHARDS = [(8192, 1024), (40, 7)]  # one shard, and many for small blocks of queries


@pytest.mark.parametrize("shard_rows,query_rows", SHARDS)
def test_exact_topk(vectors, shard_rows, query_rows):
    v = {k: np.floor(64 * x) for k, x in valid_vectors(vectors).items()}
    want = brute_top(v, 20, lambda a, b: int(a @ b))
    out = topk.top_k(vectors, F.col("vec_id") % 20 == 0, shard_rows=shard_rows, query_rows=query_rows)
    got = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == want
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ball_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(4)
    x = np.floor(64 * np.concatenate([rng.normal(c, 0.05, (200, 8)) for c in rng.normal(0, 3, (10, 8))]))
    tree = topk.BallTree.build(np.arange(len(x)), x, leaf=16)
    q = x[::97]
    best = topk.find(tree, np.arange(0, len(x), 97), q, np.full(len(q), -np.inf), 5)
    for row, i in enumerate(range(0, len(x), 97)):
        s = sorted((-float(x[i] @ x[j]), j) for j in range(len(x)) if j != i)[:5]
        assert list(zip(best.ids[row], best.scores[row])) == [(j, -a) for a, j in s]


@pytest.mark.parametrize("shard_rows,query_rows", SHARDS)
def test_one_bit_codes_find_the_nearest(vectors, shard_rows, query_rows):
    v = valid_vectors(vectors, zero=False)
    want = brute_top(v, 20, lambda a, b: sum(x * y for x, y in zip(a.tolist(), b.tolist())))
    got = defaultdict(list)
    for r in sorted(ann.nearest(vectors, F.col("vec_id") % 20 == 0, shard_rows=shard_rows, query_rows=query_rows).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want)
    hit = sum(len({c for c, _ in got[q]} & {c for c, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        assert all(s == pytest.approx(v[q] @ v[c], abs=1e-12) for c, s in found) and len(found) == len(want[q])
    assert got[0] == want[0]  # sixty copies tie; the smallest ids win


def test_error_bound_holds_mostly():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(500, 64)), rng.normal(size=(50, 64))
    codes = ann.Codes.load(500, 64, ann.Codes.build(x).dump())
    estimate, slack = codes.guess(q)
    assert (np.abs(estimate - q @ x.T) <= slack).mean() > 0.97 and np.median(slack) < 0.35 * 8 * 8
    signs = np.where(((x - x.mean(axis=0)) @ ann.rotation(64).T) > 0, 1, -1)
    plain = (q @ codes.centre)[:, None] + (q @ ann.rotation(64).T) @ signs.T / 8 * (codes.length / codes.fit)[None, :]
    assert np.abs(estimate - plain).max() < 0.1 * np.abs(plain).max()  # but for the rounding of the query
    ids, least = np.arange(500), np.full(50, -np.inf)
    true = np.sort(q @ x.T, axis=1)[:, ::-1][:, :20]
    for best in (ann.find(codes, ids, x, np.arange(-50, 0), q, least, 20), ann.score(ids, x, np.arange(-50, 0), q, least, 20, ann.choose(ids, codes.dump(), np.arange(-50, 0), q, least, 20))):
        assert np.isclose(np.sort(best.scores, axis=1)[:, ::-1], true).mean() > 0.97


def test_shards_that_cannot_reach_are_left_out(spark):
    rng = np.random.default_rng(14)
    centres = rng.normal(0, 20, (12, 8))
    x = np.concatenate([c + rng.normal(0, 0.2, (50, 8)) for c in centres])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    kept = vectors_.valid(rows, "vec_id", "embedding", lambda c: c)
    shards = [r.shard for r in vectors_.dealt(kept, 50).select("shard").collect()]
    assert len(shards) == 600 and max(Counter(shards).values()) <= 90
    seen, real = [], vectors_.route
    with pytest.MonkeyPatch.context() as m:
        m.setattr(vectors_, "route", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
        got = topk.top_k(rows, F.col("vec_id") % 20 == 0, k=5, scale=1, shard_rows=50).collect()
    pairs = sum(len(bytes(r.q_ids)) // 8 for r in seen[1].select("q_ids").collect())
    assert pairs < 0.5 * 30 * len(set(shards))  # of 30 queries and all shards
    want = brute_top({i: np.floor(v) for i, v in enumerate(x)}, 5, lambda a, b: int(a @ b))
    assert {(r.query_id, r["rank"] - 1): (r.vec_id, r.score) for r in got} == {(q, i): p for q, f in want.items() for i, p in enumerate(f)}


# 6


@pytest.mark.parametrize("sites", [2, 4, 8])
def test_line_dedup(docs, nothing, sites):
    key = lambda x: x.strip(" \t\r")
    where, first = defaultdict(set), {}
    rows = sorted({(r.doc_id, r.text, r.source) for r in docs.collect() if r.text is not None})
    for k, t, s in rows:
        for i, x in enumerate(t.split("\n")):
            if key(x):
                where[key(x)] |= {s} - {None}
                first.setdefault(key(x), (k, i))
    spread = {x for x, s in where.items() if len(s) >= sites}
    want = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if key(x) not in spread or first[key(x)] == (k, i)) for k, t, _ in rows}
    got = linededup.remove_spread_lines(docs, min_sites=sites)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"] and got.count() == docs.count()
    assert {r.doc_id: r.text for r in got.collect() if r.text is not None} == want
    assert sum(r.n_removed for r in got.collect()) > 0
    assert linededup.remove_spread_lines(nothing).count() == 0


def test_many_lines_in_one_text(spark):
    boiler = [f"boiler {i}" for i in range(3000)]
    rows = [(i, "\n".join([*boiler, *(f"own {i} {j}" for j in range(30_000 if i == 5 else 1))]), f"s{i}") for i in range(6)] + [(9, "", "s1"), (10, None, "s1")]
    out = {r.doc_id: r for r in linededup.remove_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=3).collect()}
    assert out[0].text == rows[0][1] and all(out[i].n_removed == 3000 for i in range(1, 6))
    assert out[5].text == "\n".join(f"own 5 {j}" for j in range(30_000)) and out[9].text == "" and out[10].text is None


# 9


def test_scores_are_those_of_a_plain_loop(spark):
    model = langid.fit(language_docs(spark, 300))
    s = model.settings
    texts = ["Aeiou RST", "<odd> a<b", "  ", "ñandú über 12 x", "é" * 50, "one\u3000two\x1fthree"]

    def bucket(gram):
        h = 0
        for n, c in enumerate(gram, 1):
            h = ((h ^ c) * 16777619 + n) % 2**32
        h = (h ^ h >> 15) * 2246822519 % 2**32
        return (h ^ h >> 13) % s.buckets

    for text, got in zip(texts, model.scores(langid.pa.array(texts)), strict=True):
        ids = []
        for w in text.lower().split():
            w = f"<{w}>".encode()
            ids += [bucket(w[i : i + n]) for n in s.orders for i in range(len(w) - n + 1)]
        mean = np.mean([model.table[i].astype(float) for i in ids], axis=0) if ids else 0
        assert np.allclose(got, langid.softmax((np.zeros((1, 3)) + mean + model.bias) / model.temperature)[0], atol=1e-9)


def test_white_space_round_words_trains_nothing(spark):
    rows = [(f"\n  {w}{i} \n", y) for i in range(200) for w, y in (("aeio", "xx"), ("bcdf", "yy"))]
    plain = langid.train([t.strip() for t, _ in rows], [y for _, y in rows], langid.Settings())
    padded = langid.train([t for t, _ in rows], [y for _, y in rows], langid.Settings())
    assert np.isfinite(padded.table).all() and np.array_equal(plain.table, padded.table)


def test_calibration_is_inside_its_grid(spark):
    model = langid.fit(language_docs(spark))
    assert langid.TEMPERATURES[0] < model.temperature < langid.TEMPERATURES[-1] and model.threshold == 0.5
    rng = np.random.default_rng(3)
    logits, true_t = rng.normal(0, 4, (4000, 3)), 2.5
    p = langid.softmax(logits / true_t)
    truth = np.array([rng.choice(3, p=x) for x in p])
    assert langid.calibrated(logits, truth) == pytest.approx(true_t, rel=0.1)
    perfect = np.eye(3)[np.arange(200) % 3] * 3
    assert langid.TEMPERATURES[0] < langid.calibrated(perfect, np.arange(200) % 3) < langid.TEMPERATURES[-1]


def language_docs(spark, n=600):
    rng = random.Random(8)
    kinds = {"xx": "aeiou", "yy": "bcdfg", "zz": "éñüöß"}
    rows = []
    for i in range(n):
        lang = rng.choice(list(kinds))
        words = ["".join(rng.choice(kinds[lang] + "rstln") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(words), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_language_id_on_held_out_rows(spark, nothing):
    docs = language_docs(spark)
    model = langid.fit(docs)
    assert model.labels == ["xx", "yy", "zz"]
    out = langid.predict(docs, model).withColumn("held", ~langid.trainable(F.col("doc_id")))
    rows = out.collect()
    assert {r.doc_id for r in rows if r.held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    held = [r for r in rows if r.held]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) < 0.02 * len(rows)
    odd = spark.createDataFrame([(1, None, "xx"), (2, "", None), (3, "12 34 !?", "yy"), (None, "a <b> c", None), (5, "a" * 200_000, "xx")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0, True) and got[None][0] in model.labels and got[5][0] in model.labels
    assert langid.fit(nothing) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.predict(nothing, model).count() == 0


def test_labels_and_ids_are_no_inputs(spark):
    docs = language_docs(spark, 200)
    model = langid.fit(docs)
    other = docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("xx").alias("lang"))
    a = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    b = {r.doc_id - 1000: r.lang_pred for r in langid.predict(other, model).collect()}
    assert a == b


# 10


def brute_repeats(rows, window):
    words = {k: WORD.findall(t or "") for k, t in rows.items()}
    first = {}
    for k in sorted(words):
        for i in range(len(words[k]) - window + 1):
            first.setdefault(tuple(words[k][i : i + window]), k)
    out = {}
    for k, w in words.items():
        cut = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < k:
                cut[i : i + window] = [True] * window
        kept = " ".join(x for x, c in zip(w, cut) if not c)
        out[k] = (len(w), sum(cut), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot,shard,window", [(2048, 400_000, 50), (1, 500, 50), (3, 2000, 8), (2048, 400_000, 70)])
def test_repeated_windows(spark, docs, nothing, hot, shard, window):
    want = brute_repeats(by_id(docs), window)
    got = substrings.remove_repeats(docs, window=window, hot_pieces=hot, shard_words=shard).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert any(n for _, n, _ in want.values())
    if shard < 400_000:
        return
    assert substrings.remove_repeats(nothing).count() == 0
    odd = spark.createDataFrame([(None, " ".join("abcde" * 20)), (7, " ".join("abcde" * 20)), (7, " ".join("abcde" * 20))], "doc_id long, text string")
    assert {r.n_removed for r in substrings.remove_repeats(odd).collect()} == {0}


def test_search_against_earlier_pieces_decides():
    """Pieces with one anchor that share windows only in part: what a piece holds of an
    earlier one shows only in the matching statistics, which restart where they differ."""
    import pyarrow as pa

    rng, window = random.Random(12), 12
    common, pieces = [f"c{i}" for i in range(30)], []
    for k in range(40):
        a, b = sorted(rng.sample(range(31), 2))
        text = [f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 6))] + common[a:b] + [f"w{rng.randrange(30)}" for _ in range(rng.randint(12, 20))]
        pieces.append((5, k, 100 - k, 200 - k, " ".join(text)))
    restarts, statistics = [], fmindex.FMIndex.statistics

    def counted(self, *args):
        yield from statistics(self, *args)
        restarts.append(self.restarts)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(fmindex.FMIndex, "statistics", counted)
        table = pa.table(dict(zip(("anchor", "piece", "lo", "hi", "text"), map(list, zip(*pieces)), strict=True)))
        found = substrings.shard_index(table, window).to_pylist()
    got = {(r["piece"], x["offset"] + i): x["lo"] for r in found for x in r["found"] for i in range(x["n"])}
    want, earlier = {}, 0
    for _, k, lo, _, text in pieces:
        w = text.split()
        for i in range(len(w) - window + 1):
            part = " ".join(w[i : i + window])
            want[k, i] = min(p[2] for p in pieces if f" {part} " in f" {p[4]} ")
            earlier += want[k, i] < lo
    assert got == want and earlier > 20 and sum(restarts) > 100 and len(restarts) == 6
    with pytest.raises(ValueError):
        fmindex.FMIndex([np.array([1, 2])], 3, 20).classes(21)


def test_fm_index_matches_brute_force():
    rng = np.random.default_rng(9)
    pieces = [rng.integers(1, 5, rng.integers(1, 120)) for _ in range(30)]
    index = fmindex.FMIndex(pieces, 5)
    text = "".join("".join(map(str, p)) + "0" for p in pieces)
    for m in (1, 3, 9):
        for _ in range(20):
            p = rng.integers(1, 5, m)
            lo, hi = np.array([0]), np.array([index.rows])
            for c in p[::-1]:
                lo, hi = index.step(np.array([c]), lo, hi)
            assert hi[0] - lo[0] == len(re.findall(f"(?={''.join(map(str, p))})", text))
    queries = [rng.integers(1, 5, 60), pieces[3], rng.integers(1, 5, 5)]
    for who, place, n, row in index.statistics(queries, 40):
        for q, a, k, r in zip(who, place, n, row):
            s = "".join(map(str, queries[q][a:]))
            longest = max((m for m in range(min(40, len(s)) + 1) if s[:m] in text), default=0)
            assert k == longest
            at = index.order[r]
            assert k == 0 or text[at : at + k] == s[:k]
