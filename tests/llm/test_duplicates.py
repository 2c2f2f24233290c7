import random
from pathlib import Path

import numpy as np
import pytest

from tidewheel.llm import neardup, passages
from tidewheel.llm.common import alnum_words, space_words
from tidewheel.llm.graph import components


def joined(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in joined(edges).items() if x != c}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, n):
    w = space_words((text or "").encode())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near(rows, n):
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    pairs = [(a, a) for a, _ in sets]
    for k, (a, s) in enumerate(sets):
        pairs += [(a, b) for b, t in sets[:k] if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    group = joined(pairs)
    return sorted([(i, len(shingles(t, n)), group.get(i), i is None or group[i] == i) for i, t in rows], key=repr)


def family(rng, words, size, edits):
    out = []
    for _ in range(size):
        w = list(words)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_match_brute_force(spark, docs, odd, n):
    rng = random.Random(n)
    texts = []
    for f in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 20, 80, 150]))]
        texts += family(rng, base, rng.choice([2, 5, 30]), max(1, len(base) // 8))
    texts += [texts[0]] * 5 + [t.upper() for t in texts[:3]]
    rows = [*odd, *[(100 + i, t) for i, t in enumerate(texts)]]
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs(rows), n).collect()), key=repr)
    assert got == near(rows, n)


def test_a_large_family_in_small_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(neardup, "F_BLOCK", 16)
    monkeypatch.setattr(neardup, "X_BLOCK", 8)
    rng = random.Random(9)
    rows = list(enumerate(family(rng, [f"w{i}" for i in range(120)], 150, 16)))
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs(rows), 2).collect()), key=repr)
    assert got == near(rows, 2)


def test_pairs_meet_in_buckets_of_unrelated_leaders(docs, monkeypatch):
    """One band of one row: texts that share stock phrases (under 30 %) lead the buckets of most pairs."""
    monkeypatch.setattr(neardup, "F_BLOCK", 4)
    monkeypatch.setattr(neardup, "X_BLOCK", 4)
    stock = [f"s{i}" for i in range(25)]
    lone = [[*stock, *(f"u{k}w{i}" for i in range(40))] for k in range(60)]
    pairs = [[*stock, *(f"p{k}w{i}" for i in range(40))] for k in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate([*lone, *pairs, *([*w[:-2], "x", "y"] for w in pairs)])]
    hashes = neardup.WordHashes()
    sets = [neardup.shingle_hashes(hashes.of(space_words(t.encode())), 2) for _, t in rows]
    bucket = neardup.band_hashes(neardup.super_minhash(sets, 1), 1, 1)[:, 0].tolist()
    meet = [(i, i + 30) for i in range(60, 90) if bucket[i] == bucket[i + 30]]
    assert sum(bucket.index(bucket[a]) < 60 for a, _ in meet) > 5
    want = joined([(i, i) for i, _ in rows] + meet)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(rows), 2, bands=1, rows=1).collect()} == want


def test_a_pair_behind_excerpts_that_lead_its_buckets(docs):
    """One excerpt with a smaller id for each band that the pair shares, made of the shingles that decide the band."""
    words = [f"w{i}" for i in range(250)]
    pair = [" ".join(words), " ".join([*words[:120], "x", *words[121:240], "y", *words[241:]])]
    hashes = neardup.WordHashes()
    signature = lambda t: neardup.super_minhash([neardup.shingle_hashes(hashes.of(space_words(t.encode())), 2)], 300)[0]
    signs = [signature(t) for t in pair]
    singles = {f"{a} {b}": signature(f"{a} {b}") for a, b in zip(words, words[1:], strict=False)}
    excerpts = []
    for band in range(50):
        slots = range(6 * band, 6 * band + 6)
        if all(signs[0][k] == signs[1][k] for k in slots):
            excerpts.append(" ".join(next(t for t, sign in singles.items() if sign[k] == signs[0][k]) for k in slots))
    rows = [*enumerate(excerpts), *enumerate(pair, 1000)]
    bands = neardup.band_hashes(np.array([signature(t) for _, t in rows]), 50, 6)
    both = [b for b in range(50) if bands[-1][b] == bands[-2][b]]
    assert len(both) > 10 and sum((bands[:-2, b] == bands[-1][b]).any() for b in both) > 0.9 * len(both)
    assert sorted((tuple(r) for r in neardup.near_duplicates(docs(rows), 2).collect()), key=repr) == near(rows, 2)


def test_an_id_with_several_texts_joins_their_groups(docs):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one), (2, two), (3, one + " c"), (3, two), (4, two + " d"), (5, "alone here")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(rows), 2).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_deduplicated_with_columns_named_like_its_own(spark):
    names = ["doc_id", "text", "row", "_id", "h1", "_dropped"]
    df = spark.createDataFrame([(1, "a b c", "r", "i", "h", "d"), (2, "a b c", "r", "i", "h", "d"), (2, "a b c", "s", "i", "h", "d")], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    left = neardup.deduplicated(df)
    assert left.columns == names and [r.doc_id for r in left.collect()] == [1]


def test_no_documents(docs):
    assert neardup.near_duplicates(docs([])).count() == 0
    assert neardup.deduplicated(docs([])).count() == 0
    assert passages.repeated(docs([])).count() == 0
    assert passages.cut(docs([])).count() == 0


def test_deduplicated_keeps_columns_and_one_of_each(docs, odd):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [*odd, (50, text), (51, text), (52, text + " more")]
    left = neardup.deduplicated(docs(rows))
    assert left.columns == docs(rows).columns
    ids = sorted(r.doc_id for r in left.collect() if r.doc_id is not None)
    assert ids == [1, 2, 3, 4, 5, 6, 7, 8, 50]


def test_signatures_estimate_similarity_and_match_a_plain_loop():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:320], rng.integers(0, 2**63, 80).astype(np.uint64)])
    s = neardup.super_minhash([np.unique(a), np.unique(b), np.unique(a[:3])], 300)
    assert abs((s[0] == s[1]).mean() - 320 / 480) < 0.1
    assert (neardup.super_minhash([np.unique(a[:3])], 300)[0] == s[2]).all()
    m = 20
    few = np.unique(a[:4])
    want = np.full(m, neardup.FULL, dtype=np.uint64)
    for x in few:
        order = list(range(m))
        for j in range(m):
            z = int(neardup.mix(np.array([x], np.uint64), j + 1)[0])
            k = j + ((z >> 32) * (m - j) >> 32)
            order[j], order[k] = order[k], order[j]
            want[order[j]] = min(int(want[order[j]]), j << 32 | z & 0xFFFFFFFF)
    assert (neardup.super_minhash([few], m)[0] == want).all()


# passages


def earlier(rows, length):
    """doc -> word -> the smallest documents that have a window at it, for windows that a document with a smaller id has."""
    texts = sorted({(i, tuple(alnum_words(t.encode()))) for i, t in rows if i is not None and t})
    seen, whole, out = {}, {}, {}
    for doc, w in texts:
        if len(w) < length:
            continue
        if (rep := whole.setdefault(w, doc)) != doc:
            for k in range(len(w)):
                out.setdefault(doc, {}).setdefault(k, set()).add(rep)
            continue
        for i in range(len(w) - length + 1):
            if (source := seen.setdefault(w[i : i + length], doc)) != doc:
                for k in range(i, i + length):
                    out.setdefault(doc, {}).setdefault(k, set()).add(source)
    return out


def by_span(hits):
    """The same as (first, last, sources)."""
    out = {}
    for doc, words in hits.items():
        spans = []
        for k in sorted(words):
            if spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
                spans[-1][2] |= words[k]
            else:
                spans.append([k, k + 1, set(words[k])])
        out[doc] = [(a, b, sorted(x)) for a, b, x in spans]
    return out


def spread(rng):
    vocabulary = [f"v{i}" for i in range(3000)]
    shared = [[rng.choice(vocabulary) for _ in range(n)] for n in (30, 49, 50, 51, 60, 80, 200)]
    out = []
    for _ in range(150):
        w = []
        for _ in range(rng.randrange(4)):
            w += [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
            p = rng.choice(shared)
            w += p[rng.randrange(3) :] if rng.random() < 0.3 else p
        out.append(" ".join(w))
    return out + out[:5] + [" ".join(["a b c"] * 60)] * 2 + [" ".join(["a b c"] * 70)]


def spans_of(df):
    return {r.doc_id: [(x["first"], x["last"], x["sources"]) for x in r.spans] for r in df.collect()}


def test_passages_match_brute_force(docs, odd):
    rows = [*odd, *[(100 + i, t) for i, t in enumerate(spread(random.Random(6)))]]
    assert spans_of(passages.repeated(docs(rows))) == by_span(earlier(rows, 50))


@pytest.mark.parametrize("top", [0, 20, 100_000])
def test_very_common_heads_lose_nothing(docs, monkeypatch, top):
    """What documents share beside boilerplate that all have, and the first one lacks; by look-up, by join, and by both."""
    monkeypatch.setattr(passages, "SHARE", 5)
    monkeypatch.setattr(passages, "TOP", top)
    plate = " ".join(f"c{i}" for i in range(40))
    rows = [(i, f"x{i} y{i} l{i % 20}a l{i % 20}b {plate} " + " ".join(f"r{i % 20}n{k}" for k in range(30)) + f" z{i}") for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(spread(random.Random(6)))]
    assert spans_of(passages.repeated(docs(rows))) == by_span(earlier(rows, 50))


def test_a_head_in_thirty_thousand_documents(docs):
    """Boilerplate of 40 words in every document; pairs of them share 12 words more."""
    plate = " ".join(f"c{i}" for i in range(40))
    rows = [(i, f"x{i} {plate} " + " ".join(f"r{i % 15_000}n{k}" for k in range(12)) + f" z{i}") for i in range(30_000)]
    got = spans_of(passages.repeated(docs(rows)))
    assert got == {i: [(1, 53, [i - 15_000])] for i in range(15_000, 30_000)}


def test_cut_leaves_one_of_each_and_clean_texts_alone(docs, spark):
    passage = " ".join(f"P{i}," for i in range(60))
    rows = [(1, f"Start here. {passage} End."), (2, f"Other — {passage} tail. "), (3, passage), (4, "clean,  text. "), (5, None)]
    df = docs(rows).withColumnRenamed("key", "n_chars")
    got = {r.doc_id: r for r in passages.cut(df).collect()}
    assert passages.cut(df).columns == df.columns
    assert {i: r.text for i, r in got.items()} == {1: rows[0][1], 2: "Other — tail.", 4: "clean,  text. ", 5: None}
    assert got[2].n_chars == 13 and got[4].n_chars == 7


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture
def unlike(spark, tmp_path):
    """Documents of random words and one passage that all hold, read from files, and the bytes of their texts; joins are by shuffles."""
    rng = random.Random(8)
    word = lambda: f"{rng.getrandbits(32):08x}"
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(10_000)] + passage)) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.read.parquet(str(tmp_path / "documents")), sum(len(t) for _, t in rows)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cut_shuffles_a_text_twice(spark, unlike):
    """Once to the heads that it shares and once to its spans; all else is small."""
    df, size = unlike
    before = shuffled(spark)
    assert passages.cut(df).where("length(text) < 90000").count() == 29
    assert 2 * size < shuffled(spark) - before < 2.5 * size + 1_000_000


def test_digests_go_as_soon_as_they_are_read(spark, unlike, monkeypatch):
    """What is left in the shared folder when suffixes are made is small beside the hashes of all kept places."""
    df, size = unlike
    folder, make, seen = Path(spark.conf.get("spark.checkpoint.dir")), passages.suffixes, []
    held = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = held()
    monkeypatch.setattr(passages, "suffixes", lambda *x: seen.append(held() - before) or make(*x))
    assert passages.repeated(df).count() == 29
    assert len(seen) == 1 and seen[0] < size // 50
