"""Text decoded with the wrong character encoding: found and restored by character n-gram models.

A garbled word is one that some encode-decode chain turns into a much likelier word. Words are scored once each, however
often they occur; the models are hash tables of fixed size, so what is sent to the workers is bounded whatever the corpus.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legflow.runtime import broadcast_checked, cut

BITS = (16, 18, 20)  # of the tables of one, two and three characters: together 11 MB
WEIGHTS = (0.05, 0.25, 0.7)
UNSEEN = 1e-7
LONGEST = 400  # a longer word is taken as several, its stretches of at most so many characters
UNTRIED = 4.0  # margin where there is nothing to validate one on: no clean record held out, or no word to garble
STEPS = [t / 4 for t in range(1, 121)]  # margins tried
CLEANING = (4.0, 3.0)  # margins of the passes that only clean the training set: too many records left out do no harm
PLAUSIBLE = -5.2  # least mean log-likelihood a character of a restored word
HELD_OUT = 20  # one in so many clean records validates the margin instead of training
WORDS_BROADCAST = 200_000

# Encodings a text's UTF-8 bytes are often read as, and (read as, written as) pairs of one-byte encodings.
UTF8_READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "iso8859-15", "cp852", "cp866", "cp1253", "cp1254")
ONE_BYTE = tuple(
    (wrong, right)
    for right in ("cp1252", "cp1250", "mac_roman", "cp850", "cp437", "cp1251")
    for wrong in ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac_roman", "iso8859-2", "iso8859-5", "iso8859-7", "cp1253", "cp1254", "iso8859-15")
    if wrong != right
)
# two encodings that differ in a few places explain nothing the others do not
ONE_BYTE = tuple(p for p in ONE_BYTE if set(p) not in ({"cp1252", "cp1254"}, {"cp1252", "iso8859-15"}, {"cp437", "cp850"}, {"cp850", "cp852"}, {"cp1250", "iso8859-2"}))
ODD = re.compile(r"[^\x00-\x7f]+")
LOST = "�"
BLANK = "\u00a0"
CONTROL = re.compile("[\x80-\x84\x86-\x9f]")


_tables: dict[object, dict] = {}  # filled in each process as needed


def _to_byte(encoding: str) -> dict[str, int]:
    """Character -> byte; bytes an encoding leaves open stand for the control characters of the same number."""
    if encoding in _tables:
        return _tables[encoding]
    table: dict[str, int] = {}
    for b in range(128, 256):
        try:
            table[codecs.decode(bytes([b]), encoding)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    for b in range(128, 160):
        table.setdefault(chr(b), b)
    _tables[encoding] = table
    return table


def _one_byte(wrong: str, right: str) -> dict[int, str]:
    """Translation of text read as `wrong` that was written as `right`."""
    if (wrong, right) in _tables:
        return _tables[wrong, right]
    out = {}
    for ch, b in _to_byte(wrong).items():
        try:
            out[ord(ch)] = codecs.decode(bytes([b]), right)
        except UnicodeDecodeError:
            out[ord(ch)] = LOST
    _tables[wrong, right] = out
    return out


def utf8_of(run: str, encoding: str) -> str | None:
    """A run of non-ASCII characters whose bytes in `encoding` are UTF-8, as what they say; where only part of it is, that
    part. None if nothing is."""
    table = _to_byte(encoding)
    raw = [table.get(c) for c in run]
    if None not in raw:
        try:
            return bytes(raw).decode("utf-8")
        except UnicodeDecodeError:
            pass
    out, i, hit = [], 0, False
    while i < len(run):
        for n in (2, 3, 4):
            if i + n <= len(run) and None not in raw[i : i + n]:
                try:
                    out.append(bytes(raw[i : i + n]).decode("utf-8"))
                    i, hit = i + n, True
                    break
                except UnicodeDecodeError:
                    continue
        else:
            out.append(run[i])
            i += 1
    return "".join(out) if hit else None


def _utf8_once(word: str) -> list[str]:
    found = []
    runs = ODD.findall(word)
    for e in UTF8_READ_AS:
        fixed = [utf8_of(r, e) for r in runs]
        if any(f is not None for f in fixed):
            it = iter([f if f is not None else r for f, r in zip(fixed, runs)])
            found.append(ODD.sub(lambda _: next(it), word))
    return list(dict.fromkeys(found))


def candidates(word: str) -> list[tuple[str, bool]]:
    """(text, strict) that encode-decode chains make of a word; strict: at least one step read UTF-8 back.

    All chains of up to three UTF-8 steps, each also followed by a one-byte step, and the one-byte steps alone. Where the
    word's end was a no-break space, text tools may have taken it off: each step is also tried with it put back.
    """
    found: dict[str, bool] = {}

    def one_byte(w: str, strict: bool) -> None:
        codes = {ord(c) for c in w if ord(c) > 127}
        for wrong, right in ONE_BYTE:
            table = _one_byte(wrong, right)
            if codes and codes <= table.keys():
                x = w.translate(table)
                if x != word and LOST not in x and not CONTROL.search(x):
                    found.setdefault(x, strict)

    layer = [word]
    for _ in range(3):
        longer = [(c, True) for w in layer for c in _utf8_once(w)] + [(c, False) for w in layer for c in _utf8_once(w + BLANK) if not c.endswith(BLANK)]
        fresh = {c: strict for c, strict in reversed(longer) if c != word and c not in found}
        found.update(fresh)
        layer = list(fresh)
        if not layer:
            break
    for w, strict in [(word, False), *found.items()]:
        one_byte(w, strict)
    return list(found.items())


def garbled_by(word: str, chain: int) -> str | None:
    """The word as the chain-th of all single steps garbles it: its bytes in one encoding read as another; None if it cannot."""
    if chain < len(UTF8_READ_AS):
        raw, wrong = word.encode("utf-8"), UTF8_READ_AS[chain]
    else:
        wrong, right = ONE_BYTE[chain - len(UTF8_READ_AS)]
        try:
            raw = word.encode(right)
        except UnicodeEncodeError:
            return None
    back = {b: c for c, b in _to_byte(wrong).items()}
    out = "".join(chr(b) if b < 128 else back.get(b, LOST) for b in raw)
    return out if out != word and LOST not in out and not CONTROL.search(out) and not re.search(r"\s", out) else None


def is_strict(word: str) -> bool:
    """A word whose odd characters are UTF-8 read as something else, or that holds a character no text is written with."""
    return LOST in word or bool(CONTROL.search(word)) or any(CONTROL.search(c) is None and LOST not in c for c in _utf8_once(word))


def _units(chars: list[str], starts: list[int], encoding: str) -> tuple[list[str], list[int]]:
    """The characters, and where each starts, after UTF-8 read as `encoding` is read back wherever it is some."""
    raw, i, out, at = [_to_byte(encoding).get(c) for c in chars], 0, [], []
    while i < len(chars):
        for n in (2, 3, 4):
            try:
                c = bytes(raw[i : i + n]).decode("utf-8") if i + n <= len(raw) and None not in raw[i : i + n] else ""
            except UnicodeDecodeError:
                continue
            if len(c) == 1:
                break
        else:
            n, c = 1, chars[i]
        out.append(c)
        at.append(starts[i])
        i += n
    return out, at


def _between(run: str) -> int:
    """The last place in the second half of a run of odd characters where a cut parts no character that was garbled into
    several, however often; its end if there is none."""
    ok, layer = set(range(len(run))), {run: list(range(len(run)))}
    for _ in range(3):
        nxt: dict[str, list[int]] = {}
        for text, starts in layer.items():
            for e in UTF8_READ_AS:
                c, at = _units(list(text), starts, e)
                if len(c) < len(text):
                    nxt.setdefault("".join(c), at)
                    ok &= set(at)
        layer = nxt
    return max((c for c in ok if c >= len(run) // 2), default=len(run))


def stretches(word: str) -> list[str]:
    """A word in parts of at most LONGEST characters that make it up; cut in the longest ASCII part near the limit, so that
    runs of odd characters stay whole, and inside a run only if it is longer than half of LONGEST."""
    out, half = [], LONGEST // 2
    while len(word) > LONGEST:
        near = word[half:LONGEST]
        plain = max(re.finditer(r"[\x00-\x7f]+", near), key=lambda m: m.end() - m.start(), default=None)
        c = half + ((plain.start() + plain.end()) // 2 if plain else _between(near))
        out.append(word[:c])
        word = word[c:]
    return [*out, word]


def _stretched(rows: DataFrame, column: str) -> DataFrame:
    """The rows with the words of an array column in stretches. Only rows with a longer word than LONGEST go to Python."""
    long = F.coalesce(F.exists(column, lambda w: F.length(w) > LONGEST), F.lit(False))
    if rows.filter(long).isEmpty():
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{column: [[s for w in ws for s in stretches(w)] for ws in b[column]]})

    return cut(rows.filter(~long).unionByName(rows.filter(long).mapInPandas(run, rows.schema)))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash slots of one, two and three characters at each place of the texts (an end mark included), and their text."""
    marked = ["\x02" + t + "\x03" for t in texts]
    flat = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(m) for m in marked])
    first = np.ones(len(flat), dtype=bool)
    first[1:] = owner[1:] != owner[:-1]
    p1 = np.where(first, np.uint64(2), np.roll(flat, 1))
    second = np.zeros(len(flat), dtype=bool)
    second[1:] = first[:-1]
    p2 = np.where(first | second, np.uint64(2), np.roll(flat, 2))
    mix = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) ^ ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29))
    with np.errstate(over="ignore"):
        h1 = mix(flat + np.uint64(1))
        h2 = mix(h1 + mix(p1 + np.uint64(7)))
        h3 = mix(h2 + mix(p2 + np.uint64(13)))
    slot = lambda h, b: (h >> np.uint64(64 - b)).astype(np.int64)
    keep = ~first
    return slot(h1, BITS[0])[keep], slot(h2, BITS[1])[keep], slot(h3, BITS[2])[keep], owner[keep]


@dataclass
class Model:
    """Counts of one, two and three characters in hash slots; interpolated, so every text has a likelihood."""

    n1: np.ndarray
    n2: np.ndarray
    n3: np.ndarray

    def __sub__(self, other: Model) -> Model:
        return Model(self.n1 - other.n1, self.n2 - other.n2, self.n3 - other.n3)

    def loglik(self, texts: list[str]) -> np.ndarray:
        """Natural log-likelihood of each text as a word."""
        if not texts:
            return np.zeros(0)
        g1, g2, g3, owner = _grams(texts)
        total = max(1.0, float(self.n1.sum()))
        # the contexts' counts are the counts of what precedes: the slot of the place before
        c1 = np.where(np.r_[True, owner[1:] != owner[:-1]], float(self.n1[_END]), np.r_[0.0, self.n1[g1[:-1]]])
        c2 = np.where(np.r_[True, owner[1:] != owner[:-1]], float(self.n1[_END]), np.r_[0.0, self.n2[g2[:-1]]])
        p = WEIGHTS[0] * self.n1[g1] / total + WEIGHTS[1] * self.n2[g2] / np.maximum(1.0, c1) + WEIGHTS[2] * self.n3[g3] / np.maximum(1.0, c2)
        p = np.minimum(1.0, p) + UNSEEN
        return np.bincount(owner, weights=np.log(p), minlength=len(texts))


_END = int(_grams([""])[0][0])  # slot of the end mark: one a word, so it also counts the beginnings


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """word, n -> k, slot, n: a partition's counts, at most as many rows as the tables have slots."""
    sums = [np.zeros(1 << b) for b in BITS]
    for b in batches:
        for at in range(0, len(b), 20_000):
            x = b.iloc[at : at + 20_000]
            texts = list(x["word"])
            n = x["n"].to_numpy(dtype=float)
            *g, owner = _grams(texts)
            for k in range(3):
                sums[k] += np.bincount(g[k], weights=n[owner], minlength=len(sums[k]))
    for k, s in enumerate(sums):
        at = np.flatnonzero(s)
        yield pd.DataFrame({"k": np.full(len(at), k), "slot": at, "n": s[at].astype("int64")})


def train(word_counts: DataFrame) -> Model:
    """The model of (word, n); only the slots' sums, of bounded number, reach the driver."""
    rows = word_counts.select("word", "n").mapInPandas(_count, "k int, slot long, n long").groupBy("k", "slot").agg(F.sum("n").alias("n")).toPandas()
    tables = [np.zeros(1 << b, dtype=np.float64) for b in BITS]  # sums of whole numbers stay exact
    for k in range(3):
        x = rows[rows["k"] == k]
        tables[k][x["slot"].to_numpy()] = x["n"].to_numpy()
    return Model(*tables)


def proposed(words: DataFrame) -> DataFrame:
    """word -> word, texts (what the chains make of it), strict."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [[c for c, _ in candidates(w)] for w in b["word"]]
            yield pd.DataFrame({"word": b["word"], "texts": texts, "strict": [is_strict(w) for w in b["word"]]})

    return words.select("word").mapInPandas(run, "word string, texts array<string>, strict boolean")


def score(proposals: DataFrame, model: Model) -> DataFrame:
    """proposed() -> word, gain, fixed, lost: by how much the likeliest chain's text beats the word, and that text.

    gain is null without a plausible candidate. lost: the word holds a character that stands for one that is gone.
    """
    shared = proposals.sparkSession.sparkContext.broadcast((model.n1, model.n2, model.n3))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value)
        for b in batches:
            for at in range(0, max(1, len(b)), 5_000):
                x = b.iloc[at : at + 5_000]
                flat = [c for cs in x["texts"] for c in cs]
                own, each = m.loglik(list(x["word"])), m.loglik(flat)
                gain, fixed, lost, j = [], [], [], 0
                for w, cs, mine in zip(x["word"], x["texts"], own):
                    best, text = None, None
                    for c, ll in zip(cs, each[j : j + len(cs)]):
                        if ll / (len(c) + 1) >= PLAUSIBLE and (best is None or ll - mine > best):
                            best, text = float(ll - mine), c
                    j += len(cs)
                    gain.append(best)
                    fixed.append(text)
                    lost.append(LOST in w or bool(CONTROL.search(w)))
                yield pd.DataFrame({"word": list(x["word"]), "gain": gain, "fixed": fixed, "lost": lost})

    return proposals.select("word", "texts").mapInPandas(run, "word string, gain double, fixed string, lost boolean")


def _rows_with(occ: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct _row of the occurrences of `words`."""
    small = broadcast_checked(words.select("word"), WORDS_BROADCAST)
    return occ.join(small if small is not None else words.select("word"), "word", "left_semi").select("_row").distinct()


@dataclass
class Garbled:
    """documents: _row, _key, _w (words by position); words: accepted (word, fixed, gain, lost); rows: affected _row.

    margin, miss, wrong: the margin, and on the held-out records the share of garbled words below it and of clean records
    with a word above it (nan where nothing could be held out).
    """

    documents: DataFrame
    words: DataFrame
    rows: DataFrame
    margin: float
    miss: float
    wrong: float


def validated_margin(clean: DataFrame, scored: DataFrame, model: Model) -> tuple[float, float, float]:
    """(margin, miss, wrong) from held-out records: the margin at which the share of garbled words missed and the share of
    clean records that would be changed are least together; of all margins within a standard error of that the middle.

    clean: _row, word of held-out records that no structural sign of garbling excludes; scored: word, gain of their words.
    Each of their words is garbled by one chain, told by its hash, so the words to be missed are known.
    """
    rows = clean.join(scored.select("word", F.coalesce("gain", F.lit(-99.0)).alias("gain")), "word").groupBy("_row").agg(F.max("gain").alias("gain"))
    chains = len(UTF8_READ_AS) + len(ONE_BYTE)

    def garble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [garbled_by(w, int(k)) for w, k in zip(b["word"], b["k"])]
            yield pd.DataFrame({"word": [w for w in x if w]})

    words = clean.select("word").distinct().select("word", F.pmod(F.xxhash64("word"), F.lit(chains)).alias("k"))
    bad = score(proposed(words.mapInPandas(garble, "word string").distinct()), model).select(F.coalesce("gain", F.lit(-99.0)).alias("gain"))

    def above(d: DataFrame) -> tuple[int, np.ndarray]:
        """How many there are, and how many lie above each of the margins tried."""
        r = d.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("gain") > t).alias(f"t{i}") for i, t in enumerate(STEPS)]).first()
        return r["n"], np.array(r[1:], dtype=float)

    (n, wrong), (m, hit) = above(rows), above(bad)
    if not n or not m:
        return UNTRIED, float("nan"), float("nan")
    wrong, miss = wrong / n, 1 - hit / m
    both = wrong + miss
    k = int(both.argmin())
    error = float(np.sqrt(wrong[k] * (1 - wrong[k]) / n + miss[k] * (1 - miss[k]) / m))
    near = np.flatnonzero(both <= both[k] + error)
    at = int(near[np.abs(near - (near[0] + near[-1]) / 2).argmin()])
    return STEPS[at], float(miss[at]), float(wrong[at])


def find(documents: DataFrame, key: str, text: str) -> Garbled:
    """Affected documents and words.

    1. Distinct words with characters beyond ASCII; those that are UTF-8 read as something else are known by structure.
    2. A model of the words of records without them scores every chain of every such word; records with a word that gains
       more than a margin of CLEANING leave the training set, and a model of the rest does the same with the next margin:
       garbled words that were learnt as words lose their support.
    3. A model of the remaining (clean) records, less one in HELD_OUT; on the held-out ones, which no score has chosen, the
       margin is validated, see validated_margin().
    4. A word is accepted if it gains more than the margin, or holds a replacement or control character (lost: what stood
       there is gone, so no model is asked).
    Models are sums over words, so the corpus is counted once and what leaves it is subtracted. A word over LONGEST
    characters counts as several, its stretches: each is learnt, scored and restored by itself.
    Null and empty texts, and texts in ASCII, are never affected. Every count runs over the whole corpus and whole texts.
    """
    split = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+"), F.lit(0))
    docs = cut(documents.select(F.col(key).alias("_key"), split.alias("_w")).withColumn("_row", F.monotonically_increasing_id()))
    docs = _stretched(docs, "_w")
    odd = F.array_distinct(F.filter("_w", lambda w: w.rlike(r"[^\x00-\x7F]")))
    occ = cut(docs.select("_row", F.explode(odd).alias("word")))
    words = cut(occ.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    # a word costs far more to score than to read: spread them by number of words, not by bytes
    words = words.select("word").repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")

    proposals = cut(proposed(words))
    suspects = cut(_rows_with(occ, proposals.filter("strict")))
    held = F.pmod(F.xxhash64("_row"), F.lit(HELD_OUT)) == 0

    def counted(rows: DataFrame) -> Model:
        return train(rows.filter(~held).select(F.explode("_w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))

    whole = counted(docs)
    bad = suspects
    for least in CLEANING:
        scored = cut(score(proposals, whole - counted(docs.join(bad, "_row", "left_semi"))))
        bad = cut(_rows_with(occ, scored.filter((F.col("gain") > least) | F.col("lost"))).union(suspects).distinct())
    model = whole - counted(docs.join(bad, "_row", "left_semi"))
    scored = cut(score(proposals, model))
    margin, miss, wrong = validated_margin(occ.filter(held).join(suspects, "_row", "left_anti"), scored, model)
    accepted = cut(scored.filter((F.col("gain") > margin) | F.col("lost")))
    return Garbled(docs, accepted, cut(_rows_with(occ, accepted)), margin, miss, wrong)


def affected(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct keys of the documents that hold garbled characters, restorable or not."""
    g = find(documents, key, text)
    return g.documents.join(g.rows, "_row", "left_semi").select(F.col("_key").alias(key)).distinct()


def restored(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, restored, complete, by_model of the affected documents: the text with accepted words replaced.

    complete is false where a character is gone for good; such words stay as they are unless a chain explains the rest.
    by_model is false where the document holds nothing but such words, so that no model was asked.
    """
    g = find(documents, key, text)
    rows = documents.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(g.documents.join(g.rows, "_row", "left_semi").select("_key").distinct(), F.col("_k").eqNullSafe(F.col("_key")), "left_semi")
    rows = cut(rows.withColumn("_id", F.monotonically_increasing_id()))
    split = cut(rows.select("_id", F.regexp_extract_all("_t", F.lit(r"\S+|\s+"), F.lit(0)).alias("_w")))
    parts = _stretched(split, "_w").select("_id", F.posexplode("_w").alias("pos", "word"))
    fix = g.words.select("word", F.when(F.col("gain") > g.margin, F.col("fixed")).alias("fixed"), (F.col("lost") & ~F.coalesce(F.col("gain") > g.margin, F.lit(False))).alias("gone"))
    # words in ASCII, blanks above all, are never replaced: they go round the join, whose keys are so without a hot one
    odd = F.col("word").rlike(r"[^\x00-\x7F]")
    joined = parts.filter(odd).join(fix, "word", "left").unionByName(parts.filter(~odd), True).select("_id", "pos", F.coalesce("fixed", "word").alias("w"), F.coalesce("gone", F.lit(False)).alias("gone"), F.col("fixed").isNotNull().alias("modelled"))
    out = joined.groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda p: p["w"]), "").alias("restored"), (~F.max("gone")).alias("complete"), F.max("modelled").alias("by_model"))
    return rows.join(out, "_id").select(F.col("_k").alias(key), F.col("_t").alias(text), "restored", "complete", "by_model").distinct()
