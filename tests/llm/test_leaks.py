import random

from legflow.llm import leaks as L

D = "doc_id long, text string, item_id int, h string"
I = "item_id long, text string, h string"
WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def corpus():
    r = random.Random(6)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    common = say(18)
    items = [(i, say(30) + ". " + (common + ". " if i % 2 else "") + say(20)) for i in range(6)]
    docs = [(i, say(60) + ". " + (common if i % 3 == 0 else say(18)) + ". " + say(60)) for i in range(300)]
    w = items[0][1].split()
    v = items[1][1].split()
    cut_ = say(20) + " " + " ".join(w[: int(len(w) * 0.7)]) + " " + say(20)
    shout = " ".join(x.upper() + ("!" if i % 5 == 0 else "\n") for i, x in enumerate(w))
    broken = " ".join(w[:20]) + " " + say(30) + " " + " ".join(w[20:])
    changed = " ".join(r.choice(WORDS) if i % 9 == 4 else x for i, x in enumerate(w))
    swapped = " ".join(w[30:] + w[:12])
    quote = say(40) + " " + " ".join(v[:12]) + " " + common + " " + say(30)
    docs += [(1000, cut_), (1001, shout), (1002, broken), (1003, changed), (1004, quote), (1005, " ".join(w[:20])), (1006, swapped), (1007, items[1][1]), (1008, None), (1009, ""), (1010, "a b"), (1007, items[1][1]), (1011, "x " * 30_000 + items[2][1])]
    return docs, items


def test_altered_passages_and_decoys(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(*x, 1, "z") for x in docs], D)
    i = spark.createDataFrame([(*x, "q") for x in [*items, items[0], (50, None), (51, ""), (52, "one two")]], I)
    got = {(x.doc_id, x.item_id) for x in L.leaks(d, i).collect()}
    assert got == {(1000, 0), (1001, 0), (1002, 0), (1003, 0), (1007, 1), (1011, 2)}
    assert L.leaks(d.filter("false"), i).count() == 0
    assert L.leaks(d, i.filter("false")).count() == 0


def test_other_names_and_numbers_in_the_same_slots():
    known = frozenset(f"v{i}" for i in range(30))
    q = "v1 v2 v3 Adam v4 v5 17 km v6 v7 v8 Adam v9 v10 v11 v12 v13 v14".lower().split()
    same = [{"adam": "eve", "17": "250"}.get(w, w) for w in q]
    mixed = [w if w != "adam" else x for w, x in zip(q, [*["a1"] * 8, *["b2"] * 20])]
    form = lambda w: (*L.codes(w, known), L.windows(*L.codes(w, known)))
    import numpy as np

    none = np.zeros(len(q), dtype=bool)
    assert L.ordered_share(form(q), form(same), none).share == 1.0
    f = L.ordered_share(form(q), form(mixed), none)
    assert f.share < 1.0 and f.slots < 1.0


def test_frequent_leaks_are_no_corpus_text(spark):
    r = random.Random(4)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    common = say(18)
    items = [(0, say(50)), (1, say(25) + " " + common + " " + say(25)), (2, say(50)), (3, say(8) + " " + common + " " + say(6))]
    docs = [(i, say(60) + (" " + common if i % 4 == 0 else "") + " " + say(60)) for i in range(300)]
    leaked = {i: k for i, k in [*((i, 0) for i in range(1000, 1060)), *((i, 1) for i in range(1100, 1140))]}
    docs += [(i, say(20) + " " + items[k][1] + " " + say(20)) for i, k in leaked.items()]
    copy = say(30) + " " + items[2][1]
    docs += [(i, copy) for i in range(1200, 1300)]
    leaked |= {i: 2 for i in range(1200, 1300)}
    d, i = spark.createDataFrame([(*x, 1, "z") for x in docs], D), spark.createDataFrame([(*x, "q") for x in items], I)
    assert {(x.doc_id, x.item_id) for x in L.leaks(d, i).collect()} == set(leaked.items())


def test_many_item_windows_go_by_a_join(spark, monkeypatch):
    docs, items = corpus()
    d, i = spark.createDataFrame([(*x, 1, "z") for x in docs], D), spark.createDataFrame([(*x, "q") for x in items], I)
    few = {tuple(x) for x in L.leaks(d, i).collect()}
    monkeypatch.setattr(L, "WINDOWS_BROADCAST", 1)
    assert {tuple(x) for x in L.leaks(d, i).collect()} == few and few


def test_rare_and_frequent_leaks_alike(spark):
    r = random.Random(12)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    common = say(16)
    items = [(0, say(45)), (1, say(45)), (2, say(20) + " " + common + " " + say(20))]
    docs = [(i, say(50) + (" " + common if i % 5 == 0 else "")) for i in range(650)]
    leaked = {2000: 0} | {2100 + i: 1 for i in range(50)} | {2200 + i: 2 for i in range(300)}  # 0.1 %, 5 % and 30 % of the documents
    docs += [(i, say(15) + " " + items[k][1] + " " + say(15)) for i, k in leaked.items()]
    d, i = spark.createDataFrame([(*x, 1, "z") for x in docs], D), spark.createDataFrame([(*x, "q") for x in items], I)
    assert {(x.doc_id, x.item_id) for x in L.leaks(d, i).collect()} == set(leaked.items())
