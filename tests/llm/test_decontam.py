import random

from gridtrack.llm import decontam as D

SCHEMA = "doc_id long, text string, item_id long, item string, _regions int"


def distance(a, b):
    """Least edits of ``a`` to a stretch of ``b``, by bit vectors."""
    m, ones = len(a), (1 << len(a)) - 1
    at = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score, best = ones, 0, m, m
    for c in b:
        eq = at.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        h_up, h_down = down | (ones & ~(x | up)), up & x
        score += (h_up >> (m - 1) & 1) - (h_down >> (m - 1) & 1)
        h_up, h_down = (h_up << 1) & ones, (h_down << 1) & ones
        up, down = h_down | (ones & ~((eq | down) | h_up)), h_up & (eq | down)
        best = min(best, score)
    return best


def brute(text, items):
    """Items of which some passage lies in the text within its budget."""
    s, out = D.normalised(text or ""), set()
    for item, t in items:
        p = D.normalised(t or "")
        if len(p) < D.LEAST:
            if p and b" " + p + b" " in b" " + s + b" ":
                out.add(item)
        elif any(distance(p[a : a + n], s) <= D.budget(n) for a, n in D.windows(len(p))):
            out.add(item)
    return sorted(out)


def fixture():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 6, 20, 50])))) for k in range(25)] + [(90, None), (91, "")]
    rows = [(1, None), (2, ""), (3, "x" * 5000), (4, items[0][1].upper()), (4, items[0][1].upper())]
    for d in range(10, 90):
        t = items[rng.randrange(25)][1]
        a = rng.randrange(max(1, len(t) - 60))
        part = list(t[a : a + rng.choice([40, 90, 400])])
        for _ in range(rng.choice([0, 0, 1, 3, 5, 9])):
            k = rng.randrange(len(part))
            part[k] = rng.choice(["", "z", part[k] + "q"])
        rows.append((d if d % 9 else None, " ".join(word() for _ in range(rng.choice([0, 30]))) + ". " + "".join(part) + "\n" + " ".join(word() for _ in range(20))))
    return rows, items


def test_distance():
    assert [distance(a, b) for a, b in ((b"abc", b"xxabcx"), (b"abc", b"xaxbc"), (b"abcdef", b"zabdefz"), (b"abc", b""), (b"kitten", b"the sitting"))] == [0, 1, 1, 3, 2]


def test_against_brute_force(spark):
    rows, items = fixture()
    docs = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.judged(docs, bench).collect()
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.items) for r in got), key=key) == sorted(((d, brute(t, items)) for d, t in rows), key=key)
    assert all(r.contaminated == (r.n_regions > 0) for r in got)
    kept = D.cleaned(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not brute(t, items) for _, t in rows)


def test_passes_agree(spark):
    rows, items = fixture()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    pick = lambda df: sorted(str((r["doc_id"], sorted((x["item"], x["start"]) for x in r["_regions"]))) for r in df.collect())
    assert pick(D.regions(docs, bench)) == pick(D.regions(docs, bench, block_chars=700))


def test_empty(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.judged(docs, bench).count() == 0
    assert not D.judged(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), bench).first().contaminated


def test_items_without_an_id(spark):
    text = " ".join(f"word{k}" for k in range(40))
    other = " ".join(f"thing{k}" for k in range(40))
    docs = spark.createDataFrame([(1, f"before {text} and {other} after"), (2, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, text), (7, other), (7, text)], "item_id long, text string")
    got = {r.doc_id: r for r in D.judged(docs, bench).collect()}
    assert set(got[1]["items"]) == {None, 7} and got[1].n_regions == 2 and got[1].regions.count("null:") == 1
    assert not got[2].contaminated
    only = spark.createDataFrame([(None, text)], "item_id long, text string")
    assert [r.doc_id for r in D.cleaned(docs, only).collect()] == [2]


def test_short_items_and_changed_copies(spark):
    """An item of ten characters by its words, stretches of 71 characters at any place, one word in thirteen replaced, a long item in parts."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(1, "What is it"), (2, text(60)), (3, text(5)), (4, text(30))]
    rows, want = [(0, text(300)), (1, "so, what IS it?"), (2, "somewhat is items")], {1: [1]}
    for a in range(0, 200, 7):
        rows.append((100 + a, text(20) + "." + items[1][1][a : a + 71] + ". " + text(20)))
        want[100 + a] = [2]
    for k in range(10):
        words = items[1][1].split()
        for at in range(k, 60, 13):
            words[at] = "replaced"
        rows.append((400 + k, text(9) + " " + " ".join(words)))
        want[400 + k] = [2]
    rows.append((500, text(9) + " " + items[2][1].upper() + "! " + text(9)))
    want[500] = [3]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: r["items"] for r in D.judged(docs, bench).collect() if r.contaminated} == want


def test_parts_and_many_hits(monkeypatch):
    """An item in parts, and a text whose hits are counted in halves, give the same regions' items."""
    rng = random.Random(13)
    text = lambda n: " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(n))
    items = [(k, text(40)) for k in range(8)] + [(9, text(900))]
    texts = [text(50) + " " + t[a : a + 100] + " " + text(200) for _, t in items for a in (0, 9)] + [items[8][1][1500:1580]]
    whole = [sorted({x[0] for x in D.Index(items).found(t)}) for t in texts]
    assert all(k in w for k, w in zip([k for k, _ in items for _ in (0, 9)] + [9], whole))
    monkeypatch.setattr(D, "PART", 300)
    monkeypatch.setattr(D, "HITS", 50)
    assert [sorted({x[0] for x in D.Index(items).found(t)}) for t in texts] == whole
