"""Records of several tables that are one thing, without a common key: soft rules solved by alternating directions.

Every candidate pair has a truth value in [0, 1]. Weighted rules pull at it: a similar name nearby means the same; nothing is
the same without evidence; a record has at most one partner in each other table; a partner's partner is a partner. Each
rule is a hinge, their weighted sum is convex, and its minimum is found by consensus ADMM over DataFrames: a shuffle by rule
and one by pair a round, until the values settle. The values are the confidences.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legflow.operators.spatial import M_PER_DEG, great_circle_m, has_position
from legflow.runtime import cut

# Words that only say that the place is a station, and ways to write words that belong to names.
STATION_WORDS = frozenset("bahnhof bahnhst bahnhofst bhf bf hbf hb hauptbahnhof gare station stazione".split())
ALIASES = {"gr": "gross", "st": "sankt", "saint": "sankt", "kl": "klein", "sued": "sud"}


@dataclass(frozen=True)
class Rules:
    """Parameters of the model; distances in metres.

    reach: a pair further apart is no candidate. floor: least similarity of a candidate. prior: cost of claiming a match
    without evidence. exclusive, transitive: weights of these rules. tolerance: how
    far truth values may still move, and their copies differ, at the end; not to get there in most_rounds is an error. accept: least truth value of a match.
    """

    reach: float = 1600.0
    floor: float = 0.5
    prior: float = 0.35
    exclusive: float = 4.0
    transitive: float = 0.5
    rho: float = 1.0
    tolerance: float = 0.01
    most_rounds: int = 500
    accept: float = 0.5


def folded(text: str) -> str:
    """Lower case without accents; ae, oe and ue as the letters they stand for."""
    t = unicodedata.normalize("NFKD", text.casefold().replace("ß", "ss").replace("ø", "o").replace("ł", "l"))
    t = "".join(c for c in t if not unicodedata.combining(c))
    return re.sub("([aou])e", r"\1", t)


def _near(x: str, y: str, most: int) -> int:
    """Edits (a swap of neighbours is one) between two words, most + 1 if more than `most`."""
    if abs(len(x) - len(y)) > most:
        return most + 1
    before, row = None, list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        older, before, row = before, row, [i]
        for j, b in enumerate(y, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (a != b))
            if older is not None and j > 1 and a == y[j - 2] and x[i - 2] == b:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


_STATION = {}


def _station_word(w: str) -> bool:
    """A word for station, also misspelt."""
    if w not in _STATION:
        # not the short ones, nor those that are one letter from a stadium
        _STATION[w] = w in STATION_WORDS or (len(w) >= 6 and any(_near(w, s, 1) <= 1 for s in ("bahnhof", "bahnhst", "hauptbahnhof")))
    return _STATION[w]


def name_words(name: str | None) -> list[str]:
    """The words that make a name: folded, without brackets and station words; a cut word keeps its full stop.

    Of two names with a slash between them the second is dropped where it repeats words of the first.
    """
    if not name:
        return []
    plain = re.sub(r"\([^)]*\)", " ", name)
    kept: list[str] = []
    for k, part in enumerate(plain.split("/")):
        words = re.findall(r"[^\W_]+\.?", folded(part))
        words = [ALIASES.get(w.rstrip("."), w) for w in words]
        words = [w for w in words if not _station_word(w.rstrip("."))] or words
        if k == 0 or not kept:
            kept = words
        elif not all(any(word_similarity(w, v) >= 0.8 for v in kept) for w in words):
            kept = kept + words
    return kept


def word_similarity(x: str, y: str) -> float:
    if x == y:
        return 1.0
    a, b = x.rstrip("."), y.rstrip(".")
    if a == b:
        return 1.0
    if (x.endswith(".") and len(a) >= 3 and b.startswith(a)) or (y.endswith(".") and len(b) >= 3 and a.startswith(b)):
        return 0.95
    if a.isdigit() or b.isdigit():
        return 0.0
    n = min(len(a), len(b))
    if max(len(a), len(b)) < 4:  # a lost letter or a swap, but no other letter: Ost is not Ort
        return 0.85 if n >= 2 and _near(a, b, 1) <= 1 and (len(a) != len(b) or sorted(a) == sorted(b)) else 0.0
    most = 1 if n < 8 else 2
    d = _near(a, b, most)
    return 0.0 if d > most else 0.9 if d == 1 else 0.8


ESTABLISHED = (8, 0.0005, 0.2)  # records a word is in, at least, and of all; share of the more frequent of two words


def name_similarity(x: list[str], y: list[str], seen: dict, often: dict | None = None) -> float:
    """0..1: words are paired in any order, best first; a word left alone on either side all but rules the match out.

    often: records of each established word. Two established words of like frequency are two words, however alike: neither
    is a misspelling of the other.
    """
    often = often or {}
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    scores = []
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            k = (a, b)
            if k not in seen:
                p, q = often.get(a), often.get(b)
                apart = a != b and p and q and min(p, q) >= ESTABLISHED[2] * max(p, q)
                seen[k] = 0.0 if apart else word_similarity(a, b)
            if seen[k] > 0:
                scores.append((seen[k], i, j))
    scores.sort(reverse=True)
    left, right, total = set(), set(), 0.0
    for s, i, j in scores:
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            total += s
    alone = len(x) + len(y) - 2 * len(left)
    return total / max(1, len(left)) * 0.3**alone if left else 0.0


def _named(records: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w = [name_words(n) for n in b["name"]]
            yield b.assign(words=w, squashed=["".join(sorted(x.rstrip(".") for x in v)) for v in w])

    kinds = dict(records.dtypes)
    return records.mapInPandas(run, f"src string, key {kinds['key']}, name string, lon double, lat double, words array<string>, squashed string")


LONG = 64  # letters from which a name is blocked by its ends


def _one_edit(word: Column) -> Column:
    """Keys two words an edit apart share: a word and all words with one letter less; of a long word its beginning and end,
    one of which an edit leaves as it is. Words about the limit have both kinds, so they meet those on either side of it."""
    n = F.length(word)
    shorter = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, n)))
    none = F.array().cast("array<string>")
    half = LONG // 2 - 1
    ends = F.array(F.concat(F.lit("<"), word.substr(1, half)), F.concat(F.lit(">"), F.substring(word, -half, half)))
    return F.array_distinct(F.concat(F.when(n <= LONG + 2, F.concat(F.array(word), shorter)).otherwise(none), F.when(n >= LONG, ends).otherwise(none)))


def candidates(records: DataFrame, rules: Rules) -> DataFrame:
    """a, b (src and key of each, a's src first in order), s: similar pairs of different tables.

    records: src, key, name, lon, lat, distinct. Pairs come by place: a grid of cells a reach wide, each record looks into
    the nine around it. A record without usable position comes by name: by words an edit apart, however
    many bear the name; where one coordinate is left, lat or lon, it must agree and is part of the blocking key. What stays
    ambiguous is left to the rules. Records that differ in their key only are one for the search (the least key); see members().
    """
    n = cut(_named(records))
    # at most (words a record) / ESTABLISHED[1] words, whatever the number of records
    least = max(ESTABLISHED[0], ESTABLISHED[1] * n.count())
    often = {r.w: r.n for r in n.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).collect()}
    lonely = ~has_position()
    cell = rules.reach / M_PER_DEG
    row = F.floor(F.col("lat") / cell).cast("long")
    wide = lambda r: cell / F.greatest(F.cos(F.radians(F.least(F.abs(r * cell), F.abs((r + 1) * cell)))), F.lit(0.01))
    p = n.filter(~lonely).select(F.struct("src", "key").alias("i"), "words", "lon", "lat", row.alias("r"))
    near = p.withColumn("r", F.explode(F.array(F.col("r") - 1, F.col("r"), F.col("r") + 1))).withColumn("c", F.floor(F.col("lon") / wide(F.col("r"))).cast("long")).withColumn("c", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)))
    own = p.withColumn("c", F.floor(F.col("lon") / wide(F.col("r"))).cast("long"))
    l, r = (d.select(*[F.col(k).alias(f"{k}_{x}") if k not in ("r", "c") else F.col(k) for k in d.columns]) for d, x in ((near, "a"), (own, "b")))
    dist = great_circle_m(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))
    by_place = l.join(r, ["r", "c"]).filter(F.col("i_a.src") < F.col("i_b.src")).withColumn("d", dist).filter(F.col("d") <= rules.reach).select("i_a", "i_b", "words_a", "words_b", "d")

    known = n.filter(F.size("words") > 0).select(F.struct("src", "key").alias("i"), "words", "lon", "lat", "squashed", lonely.alias("lonely"))
    blank = F.coalesce((F.col("lon") == 0) & (F.col("lat") == 0), F.lit(False))
    known = known.withColumn("la", F.when(~blank & F.col("lat").between(-90, 90), F.col("lat"))).withColumn("lo", F.when(~blank & F.col("lon").between(-180, 180), F.col("lon")))
    row = F.floor(F.col("la") / cell).cast("long")
    cells = max(1, int(360 / (cell / 0.01)))  # of longitude, a reach wide wherever wide() is
    col = F.floor((F.col("lo") + 180) / 360 * cells).cast("long")
    at = lambda mark, n: F.concat(F.lit(mark), n.cast("string"))
    # a record with lat only meets those of its rows, and those without lat; likewise with lon only
    three = F.when(F.col("la").isNotNull(), F.array(*[at("a", row + i) for i in (-1, 0, 1)], F.lit("a-"))).when(F.col("lo").isNotNull(), F.array_distinct(F.array(*[at("o", F.pmod(col + i, F.lit(cells))) for i in (-1, 0, 1)], F.lit("o-")))).otherwise(F.array(F.lit("n")))
    every = F.array(F.coalesce(at("a", row), F.lit("a-")), F.coalesce(at("o", F.pmod(col, F.lit(cells))), F.lit("o-")), F.lit("n"))
    keys = known.withColumn("k", F.explode(_one_edit(F.col("squashed"))))
    lone = keys.filter("lonely").select("k", F.explode(three).alias("t"), F.col("i").alias("i_x"), F.col("words").alias("words_x"), F.col("la").alias("la_x"), F.col("lo").alias("lo_x"))
    some = keys.join(lone.select("k").distinct(), "k", "left_semi").select("k", F.explode(every).alias("t"), F.col("i").alias("i_y"), F.col("words").alias("words_y"), F.col("la").alias("la_y"), F.col("lo").alias("lo_y"), "lonely")
    x = lone.join(some, ["k", "t"]).filter((F.col("i_x.src") != F.col("i_y.src")) & (~F.col("lonely") | (F.col("i_x.src") < F.col("i_y.src"))))
    apart = F.abs(F.col("lo_x") - F.col("lo_y"))
    narrow = F.greatest(F.cos(F.radians(F.coalesce("la_y", F.lit(90.0)))), F.lit(0.01))  # no lat on either side: as lenient as can be
    gap = F.coalesce(F.abs(F.col("la_x") - F.col("la_y")), F.least(apart, 360 - apart) * narrow, F.lit(0.0)) * M_PER_DEG
    x = x.filter(gap <= rules.reach).dropDuplicates(["i_x", "i_y"])
    first = F.col("i_x.src") < F.col("i_y.src")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    by_name = x.select(pick("i_x", "i_y").alias("i_a"), pick("i_y", "i_x").alias("i_b"), pick("words_x", "words_y").alias("words_a"), pick("words_y", "words_x").alias("words_b"), F.lit(None).cast("double").alias("d"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for b in batches:
            if len(seen) > 2_000_000:
                seen.clear()
            s = [name_similarity(list(u), list(v), seen, often) for u, v in zip(b["words_a"], b["words_b"])]
            out = b[["i_a", "i_b", "d"]].assign(s=s)
            yield out[out["s"] >= floor]

    floor = rules.floor
    kind = dict(n.dtypes)["key"]
    st = f"struct<src: string, key: {kind}>"
    # a pair of records is met once: either by place or by name
    scored = by_place.unionByName(by_name).mapInPandas(run, f"i_a {st}, i_b {st}, d double, s double")
    close = F.when(F.col("d").isNotNull(), 1 - 0.25 * F.col("d") / rules.reach).otherwise(0.9)
    return scored.select(F.col("i_a").alias("a"), F.col("i_b").alias("b"), (F.col("s") * close).alias("s"), "d").filter(F.col("s") >= rules.floor * 0.75)


def _solved(pairs: DataFrame, rules: Rules) -> DataFrame:
    """v, a, b, s, d, truth of pairs (v, a, b, s, d)."""
    ends = pairs.select("v", F.col("a").alias("i"), F.col("b").alias("j")).unionByName(pairs.select("v", F.col("b").alias("i"), F.col("a").alias("j")))
    # a record has at most one partner in a table
    group = ends.select("v", F.xxhash64(F.lit("e"), "i", "j.src").alias("f"))
    crowded = group.groupBy("f").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    one = group.join(crowded, "f").select("f", "v", F.lit(1.0).alias("c"), F.lit(rules.exclusive).alias("w"), F.col("k").cast("double").alias("norm"))
    # x_ij and x_jk say x_ik; a triple has this rule once for each of its three pairs
    l, r = ends.select(F.col("v").alias("v1"), F.col("i").alias("m"), F.col("j").alias("p")), ends.select(F.col("v").alias("v2"), F.col("i").alias("m2"), F.col("j").alias("q"))
    tri = l.join(r, F.col("m") == F.col("m2")).filter(F.col("p.src") < F.col("q.src"))
    third = pairs.select(F.col("v").alias("v3"), F.col("a").alias("p3"), F.col("b").alias("q3"))
    tri = tri.join(third, (F.col("p") == F.col("p3")) & (F.col("q") == F.col("q3")))
    sides = F.array(*(F.struct(F.col(v).alias("v"), F.lit(c).alias("c")) for v, c in (("v1", 1.0), ("v2", 1.0), ("v3", -1.0))))
    trans = tri.select(F.xxhash64(F.lit("t"), "v1", "v2", "v3").alias("f"), F.inline(sides), F.lit(rules.transitive).alias("w"), F.lit(3.0).alias("norm")).select("f", "v", "c", "w", "norm")
    state = one.unionByName(trans).join(pairs.select("v", "s"), "v")
    state = cut(state.withColumn("z", F.col("s")).withColumn("u", F.lit(0.0)))
    rho, prior = rules.rho, rules.prior
    by_rule, by_pair = Window.partitionBy("f"), Window.partitionBy("v")

    def truth(mean: Column, n: Column) -> Column:
        """Minimum over [0, 1] of s * max(0, s - z) + prior * (1 - s) * z, and the copies' pull towards their mean."""
        low = F.col("s") - prior * (1 - F.col("s"))
        up, down = mean + low / (n * rho), mean - prior * (1 - F.col("s")) / (n * rho)
        z = F.when(up < F.col("s"), up).when(down > F.col("s"), down).otherwise(F.col("s"))
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), z))

    # until no truth value moves by more than `tolerance` in a round, and copies agree with it that far
    k, moved = 0, None
    while moved is None or moved > rules.tolerance:
        if k >= rules.most_rounds:
            raise ArithmeticError(f"truth values still move by {moved} after {k} rounds: choose a larger rho")
        k += 1
        dot = F.sum(F.col("c") * (F.col("z") - F.col("u"))).over(by_rule)
        state = state.withColumn("_dot", dot)
        step = F.when(F.col("_dot") <= 1, F.lit(0.0)).when(F.col("_dot") - F.col("w") / rho * F.col("norm") >= 1, F.col("w") / rho).otherwise((F.col("_dot") - 1) / F.col("norm"))
        state = state.withColumn("_x", F.col("z") - F.col("u") - step * F.col("c"))
        state = state.withColumn("_m", F.avg(F.col("_x") + F.col("u")).over(by_pair)).withColumn("_n", F.count(F.lit(1)).over(by_pair))
        state = state.withColumn("_z", F.col("z")).withColumn("z", truth(F.col("_m"), F.col("_n")))
        off = F.greatest(F.abs(F.col("z") - F.col("_z")), F.abs(F.col("_x") - F.col("z"))).alias("off")
        state = state.withColumn("u", F.col("u") + F.col("_x") - F.col("z")).select("f", "v", "c", "w", "norm", "s", "z", "u", off)
        if k % 5 == 0:
            state = cut(state)
            moved = state.agg(F.max("off")).first()[0] or 0.0
        state = state.drop("off")
    bound = state.groupBy("v").agg(F.max("z").alias("z"))
    alone = F.when(F.col("s") > prior * (1 - F.col("s")), F.col("s")).otherwise(0.0)  # a pair no rule joins to another
    return pairs.join(bound, "v", "left").withColumn("truth", F.coalesce("z", alone)).drop("z")


def link(tables: list[tuple[str, DataFrame]], rules: Rules = Rules()) -> DataFrame:
    """src_a, key_a, src_b, key_b, confidence of matching records.

    tables: (name, DataFrame of key, name, lon, lat; other columns are ignored). Repeated rows count once; a key with several
    names or positions can match by any of them. Null keys and null or empty names match nothing. Of equal values the more
    similar, then the nearer, then the lesser key wins, so that a record keeps one partner in a table. Empty tables give
    an empty result. Ids of pairs are hashes of the pair, so a recomputed part gives the same ones.
    """
    rows = [d.select(F.lit(n).alias("src"), "key", "name", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")) for n, d in tables]
    records = reduce(DataFrame.unionByName, rows).filter("key IS NOT NULL").distinct()
    kept = cut(candidates(records, rules))
    kept = kept.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("d").alias("d"))
    pairs = cut(kept.withColumn("v", F.xxhash64("a.src", "a.key", "b.src", "b.key")))
    # pairs that only transitivity can claim: two candidates share a record, the third pair is none
    ends = pairs.select(F.col("a").alias("i"), F.col("b").alias("j")).unionByName(pairs.select(F.col("b").alias("i"), F.col("a").alias("j")))
    x = ends.select(F.col("i").alias("m"), F.col("j").alias("a")).join(ends.select(F.col("i").alias("m2"), F.col("j").alias("b")), F.col("m") == F.col("m2")).filter(F.col("a.src") < F.col("b.src"))
    extra = x.select("a", "b").distinct().join(pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b")), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")
    extra = extra.select("a", "b", F.lit(0.2).alias("s"), F.lit(None).cast("double").alias("d"), F.xxhash64("a.src", "a.key", "b.src", "b.key").alias("v"))
    solved = cut(_solved(cut(pairs.unionByName(extra)), rules))
    left = cut(solved.filter(F.col("truth") >= rules.accept).withColumn("_o", F.struct((-F.col("truth")).alias("t"), (-F.col("s")).alias("s"), F.coalesce("d", F.lit(float("inf"))).alias("d"), "a", "b")))
    one = None
    while not left.isEmpty():
        # a pair that comes first at both its ends is taken and its rivals go; whoever loses a partner so tries the next
        x = left.withColumn("_w", (F.col("_o") == F.min("_o").over(Window.partitionBy("a", "b.src"))) & (F.col("_o") == F.min("_o").over(Window.partitionBy("b", "a.src"))))
        won = cut(x.filter("_w").drop("_w"))
        one = won if one is None else one.unionByName(won)
        for i, other in (("a", "b"), ("b", "a")):
            left = left.join(won.select(F.col(i).alias("_i"), F.col(f"{other}.src").alias("_t")).distinct(), (F.col(i) == F.col("_i")) & (F.col(f"{other}.src") == F.col("_t")), "left_anti")
        left = cut(left)
    one = left if one is None else one
    return one.select(F.col("a.src").alias("src_a"), F.col("a.key").alias("key_a"), F.col("b.src").alias("src_b"), F.col("b.key").alias("key_b"), F.col("truth").alias("confidence"))
