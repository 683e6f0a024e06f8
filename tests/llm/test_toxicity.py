import random

import numpy as np

from gridtrack.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, toxic int, score double"


def corpus(seed, n=900):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    common = [word() for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(common) if rng.random() < 0.7 else word() for _ in range(rng.choice([8, 60, 300]))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(max(2, len(w) // 30)):
                w[rng.randrange(len(w))] = rng.choice(["zzquo", "zzquora", "xxvile", "xxvilest"])
        docs.append((i, " ".join(w), rng.choice(["aa", "bb", None]), "s", 7, 0.5))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out(spark):
    docs, labels = corpus(1)
    extra = [(5000, None, "aa", "s", 7, 0.5), (5001, "", "aa", "s", 7, 0.5), (5002, "abc " * 70000 + "zzquo xxvile zzquora", "aa", "s", 7, 0.5), (None, "zzquo xxvile zzquo abc", None, "s", 7, 0.5), docs[3]]
    df = spark.createDataFrame(docs + extra, DOCS)
    lab = spark.createDataFrame(labels + [(3, 1, 0), (7777, 0, 1), (None, 0, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.judged(df, lab, per_class=400).collect()
    assert len(got) == len(docs) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    hits = np.array([(r.predicted, truth[r.doc_id]) for r in held])
    assert len(held) > 200
    assert (hits[hits[:, 1] == 1, 0]).mean() > 0.9 and (hits[hits[:, 1] == 0, 0]).mean() < 0.03
    by = {r.doc_id: r for r in got}
    assert by[5000].score == by[5001].score and by[5002].predicted == 1 and by[None].predicted == 1


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "some words", "aa")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.judged(df, none).collect()] == [0.0]
    assert toxicity.judged(df.limit(0), none).count() == 0


def test_pieces_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [toxicity.word_rows(" ".join(f"w{k}" for k in rng.integers(0, 50, 300))) for _ in range(6)]
    m = toxicity.start(texts, np.array([1, 0, 1, 0, 0, 1.0]), 1)
    whole = [m.pooled(t)[0] for t in texts]
    monkeypatch.setattr(toxicity, "PIECE", 70)
    np.testing.assert_allclose(whole, [m.pooled(t)[0] for t in texts], atol=1e-5)


def test_score_equals_a_plain_forward_pass():
    """Each feature by loops over windows; the wide window's mean of the one-word filters; an empty text has none."""
    rng = np.random.default_rng(4)
    train = [toxicity.word_rows(" ".join(f"w{k}" for k in rng.integers(0, 60, 120))) for _ in range(8)]
    y = np.array([1, 0, 1, 0, 0, 1, 0, 1.0])
    m = toxicity.train(train, y, 2, 0.01, 5)
    m.scale, m.shift = 1.3, -0.2
    for text in ["", "w1", "w1 w2", " ".join(f"w{k}" for k in rng.integers(0, 60, 200))]:
        rows = toxicity.word_rows(text)
        x = [sum(m.emb[r] for r in word) for word in rows]
        relu = lambda w, at: np.maximum(sum(x[at + j] @ m.filters[w - 1][j] for j in range(w)) + m.biases[w - 1], 0)
        best = []
        for w in toxicity.WIDTHS:
            best.append(np.max([relu(w, at) for at in range(len(x) - w + 1)], 0) if len(x) >= w else np.zeros(toxicity.FILTERS))
        wide = min(toxicity.WIDE, len(x))
        one = [relu(1, at) for at in range(len(x))]
        best.append(np.max([np.mean(one[at : at + wide], 0) * toxicity.WIDE_SCALE for at in range(len(x) - wide + 1)], 0) if wide else np.zeros(toxicity.FILTERS))
        z = m.scale * (np.concatenate(best) @ m.out + m.out_bias) + m.shift
        assert abs(m.score(rows) - 1 / (1 + np.exp(-z))) < 1e-4


def test_sample_is_cut_by_characters(spark):
    docs, labels = corpus(2, 300)
    df, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    small = toxicity.fit(df.select("doc_id", "text", "lang"), lab, per_class=300, max_chars=3000)
    assert small is not None and toxicity.scored(df, small).count() == 300


def test_all_labelled_rows_are_learned(spark, monkeypatch):
    """The start's counts are those of every labelled row that is not for calibration, whatever the pieces; a text of many words counts too."""
    docs, labels = corpus(3, 400)
    docs.append((9000, "zzlong " * 60_000, "aa", "s", 7, 0.5))
    df, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, (9000, 1, 1)], "doc_id long, quality int, toxic int")
    seen, own = [], toxicity.begun
    monkeypatch.setattr(toxicity, "begun", lambda df, n0, n1, *a: seen.append((df, n0, n1)) or own(df, n0, n1, *a))
    monkeypatch.setattr(toxicity, "STRETCH", 100)
    assert toxicity.fit(df.select("doc_id", "text", "lang"), lab, epochs=1) is not None
    held = {r[0] for r in spark.createDataFrame([(d[0],) for d in docs], "i long").selectExpr("i", "pmod(xxhash64(5, i), 5) = 4 AS h").where("h").collect()}
    truth, want = {**{i: t for i, _, t in labels}, 9000: 1}, np.zeros((2, toxicity.TABLES * toxicity.ROWS))
    for d in docs:
        if d[0] not in held:
            want[truth[d[0]], np.unique(toxicity.word_rows(d[1]))] += 1
    (counts, n0, n1), = seen
    assert (counts == want).all() and n0 + n1 == len(docs) - len(held)


def test_an_average_of_stretches(spark, monkeypatch):
    """A weight's change is the mean of those stretches that changed it, weighted by rows."""
    docs, labels = corpus(4, 150)
    rows = spark.createDataFrame([(i // 100, t[2], d[1]) for i, (d, t) in enumerate(zip(docs, labels))], "piece int, toxic int, text string").coalesce(1)
    texts, y = [toxicity.word_rows(d[1]) for d in docs], np.array([t[2] for t in labels], float)
    m = toxicity.start(texts, y, 3)
    got = toxicity.averaged(rows, m, (1 - y).sum(), y.sum(), 0.01)
    ends = []
    for own in (slice(0, 100), slice(100, 150)):
        one = toxicity.moved(m, np.zeros(0, np.int64), np.zeros((0, toxicity.DIM), np.float32))
        adam, weight = toxicity.Adam(one, 0.01), toxicity.weights(y, (1 - y).sum(), y.sum())
        for at in range(own.start, own.stop, 32):
            k = slice(at, min(at + 32, own.stop))
            adam.step(texts[k], y[k], weight[k])
        ends.append(one)
    change = np.stack([e.emb - m.emb for e in ends])
    share = np.array([100, 50])[:, None] * (change != 0).any(2)
    want = (change * share[:, :, None]).sum(0) / np.maximum(share.sum(0), 1)[:, None]
    np.testing.assert_allclose(got.emb - m.emb, want, atol=1e-6)
    np.testing.assert_allclose(got.out, (100 * ends[0].out + 50 * ends[1].out) / 150, atol=1e-6)
