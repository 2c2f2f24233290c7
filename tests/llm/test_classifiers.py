import numpy as np
import pytest

from tidewheel.llm import quality, toxicity

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, toxic int, quality int"


def measured(spark, scored, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    rows = scored.select("row.doc_id", "held_out", "score", "predicted").join(labels, "doc_id").where("held_out").collect()
    y, p, s = (np.array(x) for x in zip(*[(r[label], r.predicted, r.score) for r in rows], strict=True))
    assert ((s >= 0) & (s <= 1)).all()
    return y, p, s


def test_toxicity_on_the_held_out_fold(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    machine = toxicity.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    y, p, _ = measured(spark, toxicity.score(documents, machine), "toxic")
    assert (y == p).mean() > 0.97 and y[p == 1].mean() > 0.97 and p[y == 1].mean() > 0.85


def test_quality_on_the_held_out_fold(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    network = quality.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    y, p, s = measured(spark, quality.score(documents, network), "quality")
    assert (y == p).mean() > 0.97
    assert abs(s.mean() - y.mean()) < 0.05


@pytest.mark.parametrize("toxic", [lambda a, b: a and b, lambda a, b: a != b])
@pytest.mark.parametrize("filler", [1, 100])
def test_pairs_say_more_than_their_words(toxic, filler):
    """What no sum of weights can tell; with XOR neither word means anything alone."""
    rng = np.random.default_rng(3)

    def made(n):
        held = rng.random((n, 2)) < 0.5
        texts = [b"insult " * int(a) + b"group " * int(b) + b" ".join(b"filler%d" % i for i in rng.integers(0, 1000, filler)) for a, b in held]
        return texts, np.array([float(toxic(bool(a), bool(b))) for a, b in held])

    hashes = toxicity.WordHashes()
    (texts, y), (others, want) = made(2500), made(500)
    machine = toxicity.fitted(*toxicity.features(texts, hashes), y)
    assert ((machine.scores(*toxicity.features(others, hashes)) >= 0.5) == want).mean() > 0.97


def test_raw_is_the_plain_sum_over_pairs():
    rng = np.random.default_rng(8)
    size = 1 << toxicity.BITS
    machine = toxicity.Machine(0.25, rng.normal(0, 1, size), rng.normal(0, 1, (size, toxicity.FACTORS)))
    texts = [b"some words of a text", b"", b"one", b"words that other texts have, and words again"]
    index, counts = toxicity.features(texts, toxicity.WordHashes())
    want, at = [], 0
    for c in counts:
        own = index[at : at + c]
        at += c
        want.append(0.25 + sum(machine.weights[i] for i in own) + sum(machine.vectors[i] @ machine.vectors[j] for k, i in enumerate(own) for j in own[:k]))
    assert np.allclose(machine.raw(index, counts), want)


def test_a_fit_takes_a_bounded_number_of_terms(spark, docs):
    """The first rows by hash up to the bound; labels outside it change nothing."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(50)) + (" vile" if i % 2 else " kind")) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], LABELS)
    seen = []
    plain, toxicity.fitted = toxicity.fitted, lambda index, counts, y: seen.append((len(index), len(counts))) or plain(index, counts, y)
    try:
        for limit in (10**9, 3000):
            toxicity.fit(docs(rows), labels, limit_terms=limit)
    finally:
        toxicity.fitted = plain
    assert seen[1][0] <= 3000 < seen[0][0] and 0 < seen[1][1] < seen[0][1]


@pytest.mark.parametrize(("module", "fit"), [(toxicity, toxicity.fit), (quality, quality.fit)])
def test_odd_rows_and_labels(spark, docs, odd, module, fit):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)] + [(None, 1, 1), (3, None, None), (99, 1, 0), (4, 1, 1)], LABELS)
    for rows, given in ((odd, labels), (odd, labels.where("doc_id < 0")), ([], labels)):
        df = docs(rows)
        got = module.score(df, fit(df, given), carry=df.columns).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert {r.row.n_words for r in got} <= {"x"}


def test_word_vectors_are_sums_over_all_documents(spark, docs):
    texts = ["a b c", "b c. D!", None, "c c c c", ""]
    places, (at, signs) = quality.Places(), quality.index_vectors()
    total = np.zeros((quality.PLACES, quality.WIDTH))
    for t in texts:
        ids = places.of((t or "").encode())
        for i, own in enumerate(ids):
            for j in range(max(0, i - quality.NEAR), min(len(ids), i + quality.NEAR + 1)):
                if j != i:
                    np.add.at(total[own], at[ids[j]], signs[ids[j]])
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    want = np.divide(total, norm, out=np.zeros_like(total), where=norm > 0)
    assert np.allclose(quality.word_vectors(docs(list(enumerate(texts)))), want, atol=1e-6)


def test_pooling_network_and_temperature_match_plain_loops():
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(quality.PLACES, quality.WIDTH)).astype(np.float32)
    docs_ = [np.array(x, dtype=np.int64) for x in ([], [5], [1, 2, 2, 9, 1, 1], list(rng.integers(0, quality.PLACES, 400)))]
    got = quality.pooled(docs_, vectors)
    for row, ids in zip(got, docs_, strict=True):
        if not len(ids):
            assert not row.any()
            continue
        own = [vectors[i].astype(float) for i in ids]
        mean = [sum(v[k] for v in own) / len(own) for k in range(quality.WIDTH)]
        spread = [max(0.0, sum(v[k] ** 2 for v in own) / len(own) - mean[k] ** 2) ** 0.5 for k in range(quality.WIDTH)]
        times = {i: list(ids).count(i) for i in ids}
        same = sum(a == b for a, b in zip(ids, ids[1:], strict=False)) / (len(ids) - 1) if len(ids) > 1 else 0
        rest = [np.log1p(len(ids)), len(times) / len(ids), max(times.values()) / len(ids), same, np.log1p(len(ids) / len(times)), sum(m * m for m in mean) ** 0.5]
        assert np.allclose(row, [*mean, *spread, *rest], atol=1e-6)
    width = got.shape[1]
    net = quality.Network(vectors, rng.normal(size=width), rng.uniform(1, 2, width), rng.normal(size=(width, quality.HIDDEN)), rng.normal(size=quality.HIDDEN), rng.normal(size=quality.HIDDEN), 0.3, 1.7)
    for row, score in zip(got, net.scores(got), strict=True):
        hidden = [np.tanh(sum((row[i] - net.shift[i]) / net.scale[i] * net.w1[i, j] for i in range(width)) + net.b1[j]) for j in range(quality.HIDDEN)]
        assert score == pytest.approx(1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + 0.3) / 1.7)))


def test_the_temperature_has_the_least_loss_on_what_was_kept_apart():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 2 * quality.WIDTH + quality.EXTRA))
    y = (x[:, 0] + rng.normal(size=400) * 2 > 0).astype(float)
    net = quality.trained(x, y, np.zeros((1, 1)))
    raw, want = net.raw(x[::5]), y[::5]
    loss = lambda t: float(np.mean(np.log1p(np.exp(-np.where(want == 1, raw, -raw) / t))))
    assert net.temperature > 1 and loss(net.temperature) <= min(loss(t) for t in np.geomspace(0.25, 8, 41)) + 1e-9
