import random

import numpy as np

from gridtrack.llm import langid

WORDS = {"xa": ["kato", "mero", "tuli", "kana", "rako"], "xb": ["schlom", "grund", "wacht", "streng"], "xc": ["oiseau", "beaux", "quai", "êtreé"], "xd": ["привет", "мир", "слово"]}
SCHEMA = "doc_id long, text string, lang string, score string, lang_pred int"


def rows(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 60))), lang if rng.random() < 0.9 else None, "s", 1))
    return out


def test_held_out_accuracy(spark):
    data = rows(1)
    extra = [(9001, None, "xa", "s", 1), (9002, "", None, "s", 1), (9003, "123 !? \n", "xb", "s", 1), (9004, "kato " * 30000, None, "s", 1), (None, "grund wacht", None, "s", 1), (5, data[5][1], data[5][2], "s", 1)]
    got = langid.identified(spark.createDataFrame(data + extra, SCHEMA))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
    out = got.collect()
    assert len(out) == len(data) + len(extra)
    truth = {i: next(k for k, v in WORDS.items() if t.split()[0] in v) for i, t, *_ in data}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (9001, 9002, 9003, 9004)] == ["und", "und", "und", "xa"]
    assert not by[None].held_out and by[None].lang_pred == "xb"
    assert all(0 <= r.score <= 1 for r in out)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "xa")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identified(df).collect()] == ["und", "und"]
    assert langid.identified(df.limit(0)).count() == 0


def test_one_language(spark):
    df = spark.createDataFrame([(i, "kato mero tuli", "xa") for i in range(30)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identified(df).collect()} == {("xa", 1.0)}


def test_codes_are_far_apart():
    for k in (2, 3, 4, 6, 9):
        m = langid.code_matrix(k)
        assert m.shape[0] == k and set(np.unique(m)) <= {-1.0, 1.0}
        assert min((a != b).sum() for i, a in enumerate(m) for b in m[:i]) >= max(1, m.shape[1] // 4)
        assert (np.abs(m.sum(0)) < k).all()


def test_decoding_corrects_a_wrong_bit():
    m = langid.code_matrix(4)
    model = langid.Model(list("abcd"), m, np.zeros((1, 7)), np.ones(7), np.zeros(7))
    for k in range(4):
        for b in range(7):
            logits = 3 * m[k].copy()
            logits[b] *= -0.5
            assert model.decode(logits)[0] == k


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(random.Random(2).choices([w for v in WORDS.values() for w in v], k=3000))
    whole = np.bincount(np.concatenate(langid.buckets(text)), minlength=1 << langid.BITS)
    monkeypatch.setattr(langid, "PIECE", 1000)
    cut = np.bincount(np.concatenate(langid.buckets(text)), minlength=1 << langid.BITS)
    assert np.abs(whole - cut).sum() <= 0.02 * whole.sum()


def test_prediction_equals_a_plain_decoder(spark):
    """n-grams counted one by one, bits summed by loops, losses compared codeword by codeword."""
    data = rows(3, 200)
    df = spark.createDataFrame(data, SCHEMA)
    model = langid.fit(df.select("doc_id", "text", "lang"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(df.select("doc_id", "text"), model).collect()}
    for d, text, *_ in data[:60]:
        raw = b" " + b" ".join("".join(c if c.isalpha() and (c.isascii() or ord(c) > 127) else " " for c in text.lower()).encode().split()) + b" "
        total, n = np.zeros(model.code.shape[1]), 0
        for order in langid.ORDERS:
            padded = raw + b"\0" * 3
            for i in range(len(padded) - 3 - order + 1):
                gram = int.from_bytes(padded[i : i + order], "little") + order
                total += model.weights[((gram & 0xFFFFFFFF) * 2654435761 & 0xFFFFFFFF) >> (32 - langid.BITS)]
                n += 1
        logits = model.scale * total / np.sqrt(n) + model.bias
        loss = [sum(np.log1p(np.exp(-c * z)) for c, z in zip(word, logits)) for word in model.code]
        share = np.exp(min(loss) - np.array(loss))
        assert got[d][0] == model.langs[int(np.argmin(loss))] and abs(got[d][1] - 1 / share.sum()) < 1e-3
