import random

from legflow.llm import garble as G

S = "doc_id long, text string, word string, _row int"
CITIES = ["Zürich", "Grünöfeld", "Müllheim", "Écully", "Genève", "Köln", "Görlitz", "Nîmes", "Besançon", "Łódź", "Århus", "Málaga", "Überlingen"]
RARE = ["Верхний Листок", "Νέα Σταθμός", "├── gleis └── weiche", "MÂCON-LÈS-ÎLETS", "SÃO ALVARÃO", "東の駅", "µs ± 3", "½ Stunde"]


def corpus():
    r = random.Random(8)
    sentence = lambda: f"Der Zug von {r.choice(CITIES)} nach {r.choice(CITIES)} fährt über {r.choice(CITIES)} um {r.randint(0, 23)} Uhr – 20 € für Schüler, où est arrêté près"
    docs = [(i, " ".join(sentence() for _ in range(4)) + (" " + r.choice(RARE) if i % 6 == 0 else "")) for i in range(600)]
    bad = {}
    chains = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "cp437")]
    for k, (w, rd) in enumerate(chains * 3):
        clean = sentence()
        keep = clean.replace("Łódź", "Köln")
        if k % 3 == 2:  # only a part of the text
            keep, head = sentence().replace("Łódź", "Köln"), sentence() + " "
        else:
            head = ""
        try:
            bad[2000 + k] = (head + keep.encode(w).decode(rd), head + keep)
        except UnicodeDecodeError:
            bad[2000 + k] = (head + keep.encode(w).decode(rd, "replace"), None)
    bad[2100] = ("Fahrt nach Köln".encode("latin-1").decode("utf-8", "replace"), None)
    x = "Gebühr für Müllheim"
    bad[2101] = (x.encode().decode("cp1252").encode().decode("cp1252"), x)
    return docs, bad


def test_found_and_restored(spark):
    docs, bad = corpus()
    rows = docs + [(k, v[0]) for k, v in bad.items()] + [(3000, None), (3001, ""), (3002, "plain"), (None, "plain")]
    df = spark.createDataFrame([(*x, "z", 5) for x in rows], S)
    got = {x.doc_id for x in G.affected(df, "doc_id", "text").collect()}
    assert got == set(bad)
    fixed = {x.doc_id: (x.restored, x.complete) for x in G.restored(df, "doc_id", "text").collect()}
    whole = [k for k, v in bad.items() if v[1] is not None]
    right = [k for k in whole if fixed[k][0] == bad[k][1]]
    assert len(right) >= 0.9 * len(whole)
    assert fixed[2100][1] is False


def test_without_text(spark):
    df = spark.createDataFrame([], S)
    assert G.affected(df, "doc_id", "text").count() == 0
    assert G.restored(df, "doc_id", "text").count() == 0
    few = spark.createDataFrame([(1, None, "", 0), (2, "ü" * 5000, "", 0)], S)
    assert G.affected(few, "doc_id", "text").count() == 0


def test_stretches_make_up_the_word_and_part_no_character():
    garbled = lambda t: t.encode().decode("cp1252").encode().decode("cp1252")
    for w in ("x" * 1000, "é" + "a" * 399 + "Ã¼" + "b" * 900, "Ã¼" * 3000, garbled("ü" * 1500), "aÃ¼" * 700, "東" * 5000, "x" * 400):
        parts = G.stretches(w)
        assert "".join(parts) == w and max(map(len, parts)) <= G.LONGEST
    assert all(set(p.encode("cp1252").decode()) == {"ü"} for p in G.stretches("Ã¼" * 3000))
    assert all(set(p.encode("cp1252").decode().encode("cp1252").decode()) == {"ü"} for p in G.stretches(garbled("ü" * 1500)))


def test_garbled_far_into_a_word_without_blanks(spark):
    docs, _ = corpus()
    clean = "_".join(["Besançon", *["Bahnhof"] * 120, "Müllheim", *["Bahnhof"] * 90, "Zürich"])
    bad = clean.replace("Müllheim", "MÃ¼llheim").replace("Zürich", "ZÃ¼rich")
    df = spark.createDataFrame([(*x, "z", 5) for x in [*docs, (5000, bad), (5001, clean)]], S)
    assert {x.doc_id: x.restored for x in G.restored(df, "doc_id", "text").collect()} == {5000: clean}
