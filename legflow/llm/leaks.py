"""Evaluation passages in a corpus: template windows joined by hash, then checked for slots and order.

Words become templates: numbers, units and names are typed placeholders. An item's windows of WINDOW templates are joined by
hash with those of every document; what matches often enough is read again, and the item's words found in the item's
order are counted.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legflow.runtime import broadcast_checked, cut, join_null_safe

WINDOW = 5  # words
LITERAL = 3  # of a window's words that are no placeholder; windows with fewer match by their own words only
NAME_SHARE = 0.002  # a word of fewer documents than that is taken for a name: the others number at most words-per-document / share
COMMON_SHARE = 0.02  # windows that stand apart from their item in more distinct texts than that belong to the corpus
MISSING = 3  # words of an item in a row that a text lacks if it does not hold the item whole
CANDIDATE = 0.3  # share of an item's words covered by matching windows from which a pair is read again
LEAST = 0.5  # share of an item's words that must be there in order
NEAR = 12  # words of a gap that are compared one by one
WINDOWS_BROADCAST = 2_000_000

# Units that follow a number.
UNITS = frozenset("m km cm mm ft mi kg t g h min s sec ms kmh mph kw kwh mw v kv hz bar l pct percent prozent meter metres meters mètres metri minuten minutes minute minuti minut uhr stunden hours heures ore godzin eur euro chf usd gbp pln".split())
NUMBER, NAME, UNIT = 1, 2, 3  # word codes of placeholders
WORD = re.compile(r"\w+")
MARKS, BEYOND = re.compile("[\u0300-\u034e\u0350-\u036f]+"), re.compile("[^\x00-\u036f]")  # the common combining marks; what may be others
TEXTS = 1_000  # texts a worker hashes at a time
REMEMBERED = 1_000_000  # words whose codes a worker keeps


def words_of(text: str | None) -> list[str]:
    """Words in lower case, compatibility forms and accents folded, whatever stands between them."""
    if not text:
        return []
    if text.isascii():
        return WORD.findall(text.lower())
    t = MARKS.sub("", unicodedata.normalize("NFKD", text))
    if BEYOND.search(t):
        t = "".join(c for c in t if c < "\u0370" or not unicodedata.combining(c))
    return WORD.findall(t.casefold().replace("ß", "ss"))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _own(word: str) -> int:
    """A word's own 64-bit code, the same in every process."""
    import xxhash

    return xxhash.xxh64_intdigest(word) | 16


class _Remembered(dict):
    """Own codes by word, worked out once."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = code = _own(word)
        return code


_own_codes = _Remembered()


def codes(words: list[str], known: frozenset[str], starts: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """(template code, own code) of each word. Known words stand for themselves, others are names; digits are numbers.
    starts: where another text begins, so that its first word is no unit of the last one's number."""
    own = np.fromiter(map(_own_codes.__getitem__, words), dtype=np.uint64, count=len(words))
    kind = np.fromiter((0 if w in known and not w[0].isdigit() else NUMBER if w[0].isdigit() else NAME for w in words), dtype=np.int8, count=len(words))
    for i in np.flatnonzero(kind[:-1] == NUMBER):
        if words[i + 1] in UNITS and i + 1 not in starts:
            kind[i + 1] = UNIT
    return np.where(kind == 0, own, kind.astype(np.uint64)), own


def windows(template: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Hash of every window; where fewer than LITERAL of its words stand for themselves, of the words as they are."""
    n = len(template) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    literal = (template > 15).astype(np.int16)
    enough = np.convolve(literal, np.ones(WINDOW, dtype=np.int16), mode="valid") >= LITERAL
    def rolled(c: np.ndarray) -> np.ndarray:
        h = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(WINDOW):
                h = _mixed(h + _mixed(c[k : k + n] + np.uint64(k + 1)))
        return h
    return np.where(enough, rolled(template), rolled(own) ^ np.uint64(0x5555555555555555)).astype(np.int64)


def known_words(documents: DataFrame, text: str) -> tuple[frozenset[str], int]:
    """Words of at least NAME_SHARE of the documents (and two), and the number of documents with words.

    Counted over all documents. Their number is at most (mean distinct words a document) / NAME_SHARE whatever the corpus.
    """

    def per_document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter[str] = Counter({"": 0})
            for t in b["t"]:
                w = set(words_of(t))
                n[""] += bool(w)
                n.update(w)
            yield pd.DataFrame({"word": list(n), "n": list(n.values())})

    counts = documents.select(F.col(text).alias("t")).mapInPandas(per_document, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    total = counts.filter("word = ''").agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(f"word <> '' AND n >= {max(2.0, NAME_SHARE * total)}").select("word").collect()
    return frozenset(r.word for r in rows), total


def _hashes(table: DataFrame, key: str, text: str, known: frozenset[str], wanted: np.ndarray | None = None) -> DataFrame:
    """_key, _text (the text's own hash), n (words), h: array of window hashes by position; with `wanted` (sorted) only those
    among them, once each."""
    shared = table.sparkSession.sparkContext.broadcast((known, wanted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, only = shared.value
        for whole in batches:
            for first in range(0, len(whole), TEXTS):
                b = whole.iloc[first : first + TEXTS]
                ws = [words_of(t) for t in b["t"]]
                n = np.array([len(w) for w in ws])
                doc = np.repeat(np.arange(len(b)), n)
                x = windows(*codes([w for v in ws for w in v], k, frozenset(np.cumsum(n).tolist())))
                ok = doc[: len(x)] == doc[len(doc) - len(x) :]  # a window lies within one text
                if only is not None and len(x):
                    at = np.minimum(np.searchsorted(only, x), max(0, len(only) - 1))
                    ok &= only[at] == x if len(only) else False
                x, doc = x[ok], doc[: len(x)][ok]
                h = np.split(x, np.searchsorted(doc, np.arange(1, len(b))))
                yield pd.DataFrame({"_key": b["_key"], "_text": b["_text"], "n": n, "h": h if only is None else [np.unique(y) for y in h]})

    kind = dict(table.dtypes)[key]
    return table.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_text"), F.col(text).alias("t")).mapInPandas(run, f"_key {kind}, _text long, n int, h array<long>")


def _covered(positions: Column, n: Column) -> Column:
    """Words covered by windows that start at the (sorted, distinct) positions."""
    w = WINDOW
    return F.aggregate(positions, F.struct(F.lit(0).alias("c"), F.lit(-w).alias("last")), lambda a, p: F.struct((a["c"] + F.least(F.lit(w), p - a["last"])).cast("int").alias("c"), p.cast("int").alias("last")), lambda a: a["c"]) / n


def _gap(positions: Column, n: Column) -> Column:
    """Most words in a row, of n, that no window at the (sorted, distinct) positions covers."""
    least = F.struct(F.lit(0).alias("gap"), F.lit(0).alias("end"))
    return F.aggregate(positions, least, lambda a, p: F.struct(F.greatest(a["gap"], (p - a["end"]).cast("int")).alias("gap"), (p + WINDOW).cast("int").alias("end")), lambda a: F.greatest(a["gap"], n - a["end"]))


def _common(hit: DataFrame, place: DataFrame, least: float) -> DataFrame:
    """item, k of the windows that belong to the corpus.

    hit: _text, h, distinct; place: item, words, k, h. A window is the corpus's if more than `least` distinct texts hold it
    apart from its item: they hold under LEAST of the item, or, where a recurring sentence makes up more of it, exactly the
    same windows as more than `least` texts do and lack words in a row. Texts with the whole item, or with parts of it
    cut and altered in different ways, never make its windows common, however many they are.
    """
    seen = hit.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") > least)
    some = place.join(seen.select("h"), "h", "left_semi").select("item").distinct()
    here = join_null_safe(place, some, ["item"])
    small = broadcast_checked(here, WINDOWS_BROADCAST)
    held = hit.join(small if small is not None else here, "h").groupBy("_text", "item", "words").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    alike = held.groupBy("item", "words", "ks").agg(F.count(F.lit(1)).alias("n"))
    apart = alike.filter((_covered(F.col("ks"), F.col("words")) < LEAST) | ((F.col("n") > least) & (_gap(F.col("ks"), F.col("words")) >= MISSING)))
    return apart.select("item", "n", F.explode("ks").alias("k")).groupBy("item", "k").agg(F.sum("n").alias("n")).filter(F.col("n") > least).select("item", "k")


@dataclass(frozen=True)
class Found:
    share: float
    distinctive: float
    slots: float


def ordered_share(item: tuple[np.ndarray, np.ndarray, np.ndarray], doc: tuple[np.ndarray, np.ndarray, np.ndarray], common: np.ndarray) -> Found:
    """How much of the item the document holds in the item's order.

    item, doc: (template codes, own codes, window hashes). Matching windows on one diagonal are a piece; pieces are chained
    in the order of both by the greatest number of item words, and short equal-length gaps between them (single changed
    words) are compared word by word. Names and numbers count as held where they are equal or where the same value stands
    for the same one throughout the chain; slots is the share of slots so explained. common marks item words that belong to
    the corpus; distinctive is the share of the others.
    """
    (it, io, ih), (dt, do, dh) = item, doc
    n = len(io)
    where: dict[int, list[int]] = {}
    for k, h in enumerate(ih):
        where.setdefault(int(h), []).append(k)
    hits = np.flatnonzero(np.isin(dh, ih))
    open_: dict[int, list[int]] = {}
    pieces: list[list[int]] = []  # diagonal, first and last window of the item
    for p in hits.tolist():
        for k in where[int(dh[p])]:
            d = p - k
            x = open_.get(d)
            if x is not None and k <= x[2] + WINDOW:
                x[2] = k
            else:
                open_[d] = x = [d, k, k]
                pieces.append(x)
    if not pieces:
        return Found(0.0, 0.0, 1.0)
    pieces.sort(key=lambda x: (x[1] + x[0], x[1]))
    a = np.array(pieces)
    start, end, d = a[:, 1], a[:, 2] + WINDOW, a[:, 0]
    best, prev = np.zeros(len(a), dtype=np.int64), np.full(len(a), -1)
    for j in range(len(a)):
        best[j] = end[j] - start[j]
        if j:
            # a piece before: it ends before this one does, in the item and in the document; overlaps count once
            ok = (end[:j] < end[j]) & (start[:j] <= start[j]) & (end[:j] + d[:j] < end[j] + d[j])
            if ok.any():
                lost = np.maximum(0, np.maximum(end[:j] - start[j], end[:j] + d[:j] - start[j] - d[j]))
                v = np.where(ok, best[:j] + (end[j] - start[j]) - lost, -1)
                m = int(v.argmax())
                if v[m] > best[j]:
                    best[j], prev[j] = v[m], m
    j, chain = int(best.argmax()), []
    while j >= 0:
        chain.append(j)
        j = prev[j]
    chain.reverse()
    match = np.full(n, -1, dtype=np.int64)
    last_k, last_p = None, None
    for j in chain:
        lo = max(start[j], 0 if last_k is None else max(last_k, last_p - d[j]))
        k = np.arange(lo, end[j])
        match[k] = k + d[j]
        if last_k is not None and 0 < lo - last_k <= NEAR and lo - last_k == lo + d[j] - last_p:
            g = np.arange(last_k, lo)
            match[g] = g + d[j]
        if len(k):
            last_k, last_p = int(end[j]), int(end[j] + d[j])
    k = np.flatnonzero(match >= 0)
    p = match[k]
    same = io[k] == do[p]
    slot = (it[k] == dt[p]) & (it[k] < 16)
    stands: dict[int, dict[int, int]] = {}
    for x, y in zip(io[k[slot]].tolist(), do[p[slot]].tolist()):
        stands.setdefault(x, {})[y] = stands.setdefault(x, {}).get(y, 0) + 1
    whole = sum(sum(v.values()) for v in stands.values())
    agree = sum(max(v.values()) for v in stands.values())
    settled = {x: max(v, key=v.get) for x, v in stands.items()}
    ok = same | (slot & np.array([settled.get(x) == y for x, y in zip(io[k].tolist(), do[p].tolist())], dtype=bool))
    held = np.zeros(n, dtype=bool)
    held[k[ok]] = True
    own = ~common
    return Found(held.sum() / n, held[own].sum() / max(1, own.sum()), agree / whole if whole else 1.0)


def leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """doc_key, item_key, share of every document that holds at least half of an item's words in the item's order.

    Words the corpus has in common (windows that stand apart from their item in more than COMMON_SHARE of all distinct
    texts, see _common) do not count, neither among the held nor among those to be held. Null, empty and short texts (under WINDOW words) hold nothing and are held by nothing.
    Documents with equal keys count as one if they are equal. Item windows, up to
    WINDOWS_BROADCAST of them, are looked up while documents are read, beyond that by a shuffle of both sides on the hash.
    """
    known, _ = known_words(documents, text)
    it = cut(_hashes(items.filter(F.col(text).isNotNull()).select(item_key, text).distinct(), item_key, text, known))
    place = it.select(F.col("_key").alias("item"), F.col("n").alias("words"), F.posexplode("h").alias("k", "h"))
    wanted = place.select("h").distinct()
    # the items' windows, not the corpus's: up to WINDOWS_BROADCAST of them go to the workers, which keep hits only
    few = wanted.limit(WINDOWS_BROADCAST + 1).toPandas()["h"].to_numpy(dtype=np.int64)
    few = np.sort(few) if len(few) <= WINDOWS_BROADCAST else None
    docs = cut(_hashes(documents.filter(F.col(text).isNotNull()), doc_key, text, known, few).withColumn("_row", F.monotonically_increasing_id()))
    each = docs.select("_row", "_key", "_text", F.explode(F.array_distinct("h")).alias("h"))
    hit = each if few is not None else cut(each.join(wanted, "h"))
    # distinct texts per item window, over all documents: a window counts once a text, however often that is copied
    texts = docs.filter("n > 0").select("_text").distinct().count()
    corpus = _common(hit.select("_text", "h").distinct(), place, max(3.0, COMMON_SHARE * texts)).withColumn("common", F.lit(True))
    often = cut(join_null_safe(place, corpus, ["item", "k"], "left").withColumn("common", F.coalesce("common", F.lit(False))))
    rare = often.filter("NOT common").select("item", "words", "k", "h")
    small = broadcast_checked(rare, WINDOWS_BROADCAST)
    pair = hit.join(small if small is not None else rare, "h").groupBy("_row", "_key", "item", "words").agg(F.array_sort(F.collect_set("k")).alias("k"))
    both = often.filter("common").groupBy("item").agg(F.array_sort(F.collect_set("k")).alias("common"))
    pair = join_null_safe(pair, both, ["item"], "left")
    own = F.col("words") * (1 - F.coalesce(_covered(F.col("common"), F.col("words")), F.lit(0.0)))
    cand = pair.filter(_covered(F.col("k"), F.greatest(F.lit(1.0), own)) >= CANDIDATE).select("_key", "item", "common").distinct()
    d = documents.filter(F.col(text).isNotNull()).select(F.col(doc_key).alias("_key"), F.col(text).alias("doc_text"))
    i = items.filter(F.col(text).isNotNull()).select(F.col(item_key).alias("item"), F.col(text).alias("item_text")).distinct()
    read = join_null_safe(join_null_safe(cut(cand), i, ["item"]), d, ["_key"])
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = shared.value
        cache: dict[str, tuple] = {}
        for b in batches:
            share = []
            for x, y, common in zip(b["item_text"], b["doc_text"], b["common"]):
                if x not in cache:
                    c = codes(words_of(x), names)
                    cache[x] = (*c, windows(*c))
                c = codes(words_of(y), names)
                mark = np.zeros(len(cache[x][0]), dtype=bool)
                for k in () if common is None else common:
                    mark[k : k + WINDOW] = True
                f = ordered_share(cache[x], (*c, windows(*c)), mark)
                share.append(min(f.share, f.distinctive) if mark.any() else f.share)
            yield pd.DataFrame({"_key": b["_key"], "item": b["item"], "share": share})

    kinds = dict(cand.dtypes)
    out = read.select("_key", "item", "common", "item_text", "doc_text").mapInPandas(check, f"_key {kinds['_key']}, item {kinds['item']}, share double")
    out = out.filter(F.col("share") >= LEAST).groupBy("_key", "item").agg(F.max("share").alias("share"))
    return out.select(F.col("_key").alias(doc_key), F.col("item").alias(item_key), "share")
