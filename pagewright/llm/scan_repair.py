"""Noise in text from scanned pages: what each page holds, and the page as continuous paragraphs (problem 4).

Words are counted over the whole corpus. Rare words meet frequent ones through an inverted join of character q-grams; a boosted ranker, trained
here on words spoiled by the known confusions of recognition, says which rare word is which frequent one misread. Two further boosted
classifiers look at line pairs: the two sides of a line end (joins) and a head or foot line with the document's title (furniture).
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.boosting import Boosted
from pagewright.session import cut

# Hyphen marks at a line end, ligatures, and what recognition takes for what (read, meant).
MARKS = "-‐‑­¬⁃"
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("5", "s"), ("$", "s"), ("+", "t"), ("7", "t"), ("9", "g"), ("9", "q"), ("6", "b"), ("6", "g"), ("8", "b"), ("8", "g"), ("3", "e"), ("2", "z"), ("4", "a"), ("@", "a"), ("€", "e"), ("(", "c"),
    ("c", "e"),
    ("rn", "m"), ("m", "rn"), ("nn", "m"), ("m", "nn"), ("in", "m"), ("m", "in"), ("ni", "m"), ("cl", "d"), ("d", "cl"), ("ci", "a"), ("ii", "u"), ("u", "ii"), ("li", "h"), ("h", "li"), ("ll", "u"), ("u", "ll"), ("vv", "w"), ("w", "vv"), ("ri", "n"), ("n", "ri"), ("rt", "n"), ("tl", "d"), ("il", "u"), ("lo", "b"), ("ln", "m"), ("iii", "m"), ("cj", "g"), ("fi", "h"), ("k", "lc"), ("lc", "k"), ("lr", "h"), ("li", "b"), ("cc", "œ"),
)
SURE = frozenset([("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("5", "s"), ("+", "t"), ("9", "g"), ("6", "b"), ("8", "b"), ("c", "e"), ("rn", "m"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("vv", "w"), ("ri", "n"), ("h", "li"), ("|", "l"), ("3", "e"), ("7", "t")])
SUSPENDED = frozenset("and or und oder et ou y o e bis to".split())
SMALL = frozenset("the of and a an der die das und von le la les du de des et il lo i gli di del el los las".split())

#: Words on at least this share of pages are common: at most (words a page / share) of them, so their list is bounded whatever the corpus.
COMMON_SHARE = 0.02
#: Bound of every training sample, and of the words and titles collected for it.
SAMPLE = 3000
EDGE = 2
#: How much more frequent a word must be than what is taken for its misreading.
RATIO = 8
#: Buckets in which the frequencies of grams are kept, and page_ids that are sent to the tasks at most.
GRAM_BUCKETS, FEW_IDS = 1 << 16, 500_000
#: Pages on which a word must stand to be what others are misreadings of, whatever the size of the corpus.
TARGET = 5

STRIP_LEFT = ".,;:()[]{}\"'“”„«»‚‘’¿¡?*|—–-_/…"
STRIP_RIGHT = ".,;:()[]{}\"'“”„«»‚‘’¿¡?*|—–-_/…!"
BREAK = re.compile(rf"(?<=[^\W\d_])[{MARKS}][ \t\f]*\r?\n\s*(?=[^\W_])")
#: Stands for a line end within a word.
SEAM = "\ue000"
HAS_LETTER = re.compile(r"[^\W\d_]")
LIGATURE = re.compile("[ﬀ-ﬆ]")
ROMAN = re.compile(r"^m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
NUMBER_LINE = re.compile(r"^\W*(?:(?:page|seite|página|pagina|pág|pag|p|s)\b\.?)?\s*(\d{1,5}|[ivxlcdm]+)\W*(?:(?:of|von|de|sur|di)\s*\d+\W*)?$", re.I)
NUMBER_END = re.compile(r"^(?:\W*(?:(?:page|seite|p)\b\.?\s*)?(\d{1,5}|[ivxlc]+)\b[\s|·•.:—–-]+(\S.*?)|(\S.*?)[\s|·•.:—–-]+(?:(?:page|seite|p)\b\.?\s*)?(\d{1,5}|[ivxlc]+)\W*)$", re.I)


def plain(text: str) -> str:
    return LIGATURE.sub(lambda m: LIGATURES[m[0]], text) if not text.isascii() else text


def tokens_of(text: str, divided_too: bool = True) -> Counter[str]:
    """Words of a text after joining words divided over line ends, lower case, stripped of punctuation, with at least one letter; those divided can be left out."""
    out: Counter[str] = Counter()
    for token, n in Counter(BREAK.sub("" if divided_too else SEAM, plain(text)).split()).items():
        if SEAM in token and not divided_too:
            continue
        word = token.lstrip(STRIP_LEFT).rstrip(STRIP_RIGHT).lower()
        if word and len(word) <= 40 and (word.isalpha() or HAS_LETTER.search(word) and len(word) > 1):
            out[word] += n
    return out


def roman_value(text: str) -> int | None:
    t = text.lower()
    if not t or not ROMAN.match(t):
        return None
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    nums = [values[c] for c in t]
    return sum(-a if b > a else a for a, b in zip(nums, [*nums[1:], 0]))


def number_of(text: str) -> tuple[int, bool] | None:
    """(value, whether roman)."""
    if text.isdigit():
        return int(text), False
    value = roman_value(text)
    return None if value is None else (value, True)


@lru_cache(maxsize=100_000)
def reading(read: str, meant: str) -> tuple[float, int, int]:
    """(cost, confusions, other edits) of the cheapest way by which `meant` was read as `read`; a known confusion costs 0.2 or 0.4, another edit 1."""
    n, m = len(read), len(meant)
    best: list[list[tuple[float, int, int]]] = [[(99.0, 0, 0)] * (m + 1) for _ in range(n + 1)]
    best[0][0] = (0.0, 0, 0)
    for i in range(n + 1):
        for j in range(m + 1):
            c, k, e = best[i][j]
            if c > 4:
                continue
            if i < n and j < m:
                if read[i] == meant[j]:
                    best[i + 1][j + 1] = min(best[i + 1][j + 1], (c, k, e))
                best[i + 1][j + 1] = min(best[i + 1][j + 1], (c + 1, k, e + 1))
            if i < n:
                best[i + 1][j] = min(best[i + 1][j], (c + 1, k, e + 1))
            if j < m:
                best[i][j + 1] = min(best[i][j + 1], (c + 1, k, e + 1))
            for a, b in BY_FIRST.get(read[i : i + 1], ()):
                if read.startswith(a, i) and meant.startswith(b, j):
                    cost = 0.2 if (a, b) in SURE else 0.4
                    best[i + len(a)][j + len(b)] = min(best[i + len(a)][j + len(b)], (c + cost, k + 1, e))
    return best[n][m]


BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _a, _b in CONFUSIONS:
    BY_FIRST.setdefault(_a[0], []).append((_a, _b))


def ranking_features(read: str, meant: str, n_read: float, n_meant: float) -> list[float]:
    cost, known, other = reading(read, meant)
    return [cost, known, other, np.log((n_meant + 1) / (n_read + 1)), len(meant), sum(not c.isalpha() and c != "-" for c in read), abs(len(read) - len(meant)), cost / len(meant)]


def spoil(word: str, rng: random.Random, pairs: tuple[tuple[str, str], ...] = CONFUSIONS) -> str:
    """`word` misread at one place, by a confusion that applies; the word itself where none does."""
    places = [(i, a, b) for a, b in pairs for i in range(len(word)) if word.startswith(b, i)]
    if not places:
        return word
    sure = [p for p in places if (p[1], p[2]) in SURE]
    i, a, b = rng.choice(sure if sure and rng.random() < 0.8 else places)
    return word[:i] + a + word[i + len(b) :]


def train_ranker(words: list[tuple[str, int]]) -> Boosted:
    """From frequent words: misread forms against the word are right; misread forms against its neighbours, other words, inflected-like and invented ones are wrong."""
    rng = random.Random(5)
    words = [w for w in words if len(w[0]) >= 2][:SAMPLE] or [("sample", 9), ("simple", 9)]
    by_shape: dict[tuple[str, int], list[tuple[str, int]]] = {}
    for w, n in words:
        by_shape.setdefault((w[0], len(w) // 2), []).append((w, n))
    letters = "abcdefghijklmnopqrstuvwxyz"
    x, y = [], []
    for w, n in words:
        for _ in range(2):
            bad = spoil(w, rng)
            if rng.random() < 0.15 and len(w) > 6:
                bad = spoil(bad, rng)
            rare = rng.choice((1, 1, 1, 2, 3, 5))
            if bad != w:
                x.append(ranking_features(bad, w, min(rare, n / RATIO), n))
                y.append(1)
            near, m = rng.choice(by_shape[w[0], len(w) // 2])
            if near != w:
                x += [ranking_features(bad, near, rare, m), ranking_features(w, near, rare, m)]
                y += [0, 0]
            i = rng.randrange(len(w))
            other = rng.choice((w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w + rng.choice(("s", "ed", "er", "n", "e"))))
            if other != w and reading(other, w)[2] > 0:
                x.append(ranking_features(other, w, rare, n))
                y.append(0)
    return Boosted(40, 3).fit(np.array(x), np.array(y))


def join_features(left: str, right: str, mark: str, count) -> list[float]:
    """`count` gives the frequency of a word."""
    l, r = left.lower(), right.lower()
    return [np.log1p(count(l + r)), np.log1p(count(l)), np.log1p(count(r)), np.log1p(count(f"{l}-{r}")), MARKS.index(mark) if mark in MARKS else -1, float(right[:1].islower()), len(left), len(right), float(r in SUSPENDED)]


def train_joins(words: list[tuple[str, int]]) -> Boosted:
    rng = random.Random(6)
    words = words[:SAMPLE] or [("sample", 9), ("simple", 9)]
    known = dict(words)
    count = lambda w: known.get(w, 0)
    x, y = [], []
    for w, _ in words:
        mark = rng.choice(MARKS)
        if len(w) >= 4:
            i = rng.randrange(1, len(w) - 1)
            a, b = w[:i], w[i:]
            if rng.random() < 0.15:
                a = spoil(a, rng)
            if rng.random() < 0.15:
                b = spoil(b, rng)
            x.append(join_features(a, b.lstrip("-") or b, mark, count))
            y.append(1)
        a, b = rng.choice(words)[0], rng.choice(words)[0]
        x.append(join_features(a, b, rng.choice("-‐"), count))  # a compound nobody has counted
        y.append(1)
        x.append(join_features(a, rng.choice(sorted(SUSPENDED)), "-", count))
        y.append(0)
        x.append(join_features(a, b.title(), "-", count))
        y.append(0)
    return Boosted(25, 3).fit(np.array(x), np.array(y))


def title_features(line: str, title: str) -> list[float]:
    """Of a line paired with the document's title."""
    own = [w for w in re.findall(r"[^\W_]+(?:[!+][^\W_]+)*", plain(line).lower()) if not (w.isdigit() or w in ("p", "page", "seite") or roman_value(w))]
    words = re.findall(r"[^\W_]+", title.lower())
    content = [w for w in words if w not in SMALL]
    hit = [next((t for t in words if t == w or len(w) > 3 and abs(len(t) - len(w)) <= 2 and reading(w, t)[0] <= 0.9), None) for w in own]
    covered = {t for t in hit if t}
    meaningful = sum(1 for t in covered if t not in SMALL)
    return [sum(t is not None for t in hit) / max(1, len(own)), meaningful / max(1, len(content)), sum(t is None for t in hit), len(own), meaningful, len(line)]


def train_titles(titles: list[str], lines: list[str]) -> Boosted:
    """Headers are made from titles: whole, shortened, capitals, misread, numbered; body lines and other titles are none."""
    rng = random.Random(7)
    titles, lines = [t for t in titles if t and t.strip()][:SAMPLE] or ["A Sample Title", "Other Short Notes"], lines[:SAMPLE] or ["some line of text", "another line"]
    x, y = [], []
    for t in titles:
        content = [w for w in t.split() if w.lower() not in SMALL]
        forms = [t, t.upper(), " ".join(content), spoil(t.lower(), rng), f"{t} | 12", f"xii {t}"]
        if len(content) >= 2:
            two = rng.sample(content, 2)
            forms += [" ".join(two), " ".join(content[-2:]).upper(), f"{' '.join(content[:2])} 7"]
        for form in forms:
            x.append(title_features(form, t))
            y.append(1)
        for _ in range(5):
            line = rng.choice(lines)
            x.append(title_features(line, t))
            y.append(0)
            other = rng.choice(titles)
            if {w.lower() for w in other.split()} - {w.lower() for w in t.split()} - SMALL and not other.isdigit() and re.findall(r"[^\W\d_]+", other.lower()) != re.findall(r"[^\W\d_]+", t.lower()):
                x.append(title_features(other, t))
                y.append(0)
            w = rng.choice(content or ["x"])
            x.append(title_features(f"{line} {w}", t))
            y.append(0)
            x.append(title_features(w, t) if len(content) > 2 else title_features(line, t))
            y.append(0)
    return Boosted(30, 3).fit(np.array(x), np.array(y))


def body_lines(text: str) -> list[tuple[int, str]]:
    """(line number from 1, stripped line) of the lines that hold something."""
    return [(i, y) for i, x in enumerate(text.split("\n"), 1) if (y := x.replace("\f", " ").strip())]


def deliveries(pages: DataFrame) -> tuple[DataFrame, int]:
    """(pages with `weight`, number of pages): a page that was delivered n times has the weight 1 / n each time, so it counts once.

    Only page_ids are grouped. Those delivered repeatedly go to the tasks as long as they are few; beyond FEW_IDS they meet the pages by a join.
    """
    per_page = pages.groupBy("page_id").agg(F.count("*").alias("n_delivered"))
    again = cut(per_page.where("n_delivered > 1"))
    n_again, extra = again.agg(F.count("*"), F.coalesce(F.sum(F.col("n_delivered") - 1), F.lit(0))).first()
    met = pages.join(F.broadcast(again) if n_again <= FEW_IDS else again, "page_id", "left")
    return met.withColumn("weight", F.coalesce(1 / F.col("n_delivered"), F.lit(1.0))).drop("n_delivered"), pages.count() - extra


def vocabulary(pages: DataFrame) -> DataFrame:
    """(word, n, solid): on how many pages each word stands, and on how many of them undivided, by raw_text and weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        solid: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.float64()), pa.array([solid[w] for w in total], pa.float64())], names=["word", "n", "solid"])

        for batch in batches:
            for text, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = tokens_of(text or "").keys()
                whole = words & tokens_of(text, False).keys() if text and BREAK.search(text) else words
                if weight == 1:
                    total.update(words)
                    solid.update(whole)
                else:
                    total.update(dict.fromkeys(words, weight))
                    solid.update(dict.fromkeys(whole, weight))
            if len(total) > 200_000:  # combined before the shuffle, within a bound
                yield rows()
                total.clear()
                solid.clear()
        yield rows()

    counts = pages.select("raw_text", "weight").mapInArrow(run, "word string, n double, solid double")
    return counts.groupBy("word").agg(F.round(F.sum("n")).cast("long").alias("n"), F.round(F.sum("solid")).cast("long").alias("solid"))


def grams_of(word: Column) -> Column:
    """The distinct bigrams of a word with its ends marked."""
    marked = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(marked, i, F.lit(2))))


def least_shared(longer: int) -> int:
    """Grams that a word and its misreading have in common, by the longer of their lengths: one misreading breaks two or three, two break up to six."""
    return max(1, longer + 1 - (3 if longer <= 5 else 4 if longer <= 7 else 6))


def gram_keys(words: DataFrame, rarity: np.ndarray, asked: bool) -> DataFrame:
    """(word, n, gram, size): the grams under which a word is sought (`asked`, by the length of what is sought) or stands (by its own length).

    Both sides order grams by rarity. Of two words that share `least_shared` grams or more one is among the first of either, as many as
    may be missing and one more; so only these are joined, with the length in the key, and no pair is lost.
    """
    shared = words.sparkSession.sparkContext.broadcast(rarity)  # GRAM_BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            at, grams, sizes = [], [], []
            for k, word in enumerate(batch.column("word").to_pylist()):
                marked = f"^{word}$"
                own = sorted({marked[i : i + 2] for i in range(len(marked) - 1)}, key=lambda g: (order[crc32(g.encode()) % GRAM_BUCKETS], g))
                size = len(word)
                if asked:
                    for other in range(max(2, size - 2), size + 3):
                        first = own[: max(0, len(own) - least_shared(max(size, other)) + 1)]
                        grams += first
                        sizes += [other] * len(first)
                        at += [k] * len(first)
                else:
                    first = own[: max(0, len(own) - min(map(least_shared, range(size, size + 3))) + 1)]
                    grams += first
                    sizes += [size] * len(first)
                    at += [k] * len(first)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("word").take(rows), batch.column("n").take(rows), pa.array(grams, pa.string()), pa.array(sizes, pa.int32())], names=["word", "n", "gram", "size"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, gram string, size int")


def corrections(words: DataFrame, ranker: Boosted, n_pages: int) -> DataFrame:
    """(word, meant): rare words that are frequent ones misread. Both meet by their rarest q-grams and lengths through an inverted join."""
    sized = words.where(F.length("word").between(2, 30))
    letters = F.col("word").rlike(r"^[\p{L}-]+$")
    # a word of letters only is suspicious if it is rare, one with digits or symbols in it however frequent it is
    rare = sized.where((F.col("n") < n_pages * COMMON_SHARE + 2) | ~letters)
    known = sized.where((F.col("n") >= TARGET) & letters)
    rarity = np.zeros(GRAM_BUCKETS, np.int64)
    for r in known.select(F.explode(grams_of(F.col("word"))).alias("gram")).groupBy((F.crc32("gram") % GRAM_BUCKETS).cast("int").alias("b")).agg(F.count("*").alias("c")).collect():
        rarity[r.b] = r.c
    standing = gram_keys(known, rarity, False).select("gram", "size", F.col("word").alias("meant"), F.col("n").alias("m"))
    met = gram_keys(rare, rarity, True).join(standing, ["gram", "size"]).where((F.col("m") >= RATIO * F.col("n")) & (F.col("word") != F.col("meant"))).select("word", "meant", "n", "m").distinct()
    longer = F.greatest(F.length("word"), F.length("meant"))
    enough = F.greatest(F.lit(1), longer + 1 - F.when(longer <= 5, 3).when(longer <= 7, 4).otherwise(6))
    candidates = met.where(F.size(F.array_intersect(grams_of(F.col("word")), grams_of(F.col("meant")))) >= enough)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("word", "meant", "n", "m")]
            likely = [reading(w, t)[2] <= 1 for w, t in zip(cols[0], cols[1])]
            x = [ranking_features(w, t, n, m) for (w, t, n, m), ok in zip(zip(*cols), likely) if ok]
            p = np.zeros(len(likely))
            if x:
                p[np.array(likely)] = ranker.predict(np.array(x))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("meant"), batch.column("m"), pa.array(p)], names=["word", "meant", "m", "p"])

    ranked = candidates.select("word", "meant", "n", "m").mapInArrow(rank, "word string, meant string, m long, p double")
    best = cut(ranked.where("p >= 0.5").groupBy("word").agg(F.max_by("meant", F.struct("p", "m", "meant")).alias("meant")))
    # a frequent misreading may have been taken for the word itself: go on to what it means
    onward = best.select(F.col("word").alias("meant"), F.col("meant").alias("further"))
    return best.join(onward, "meant", "left").select("word", F.coalesce("further", "meant").alias("meant"))


ENDS = "array<struct<line_no:int,left:string,right:string,mark:string>>"
ENDS_ARROW = pa.list_(pa.struct([("line_no", pa.int32()), ("left", pa.string()), ("right", pa.string()), ("mark", pa.string())]))
OUTLINE = f"page_id long, doc_id string, page_number int, rare array<string>, ends {ENDS}, edges array<struct<line_no:int,place:int,line:string>>"


def outlines(pages: DataFrame, common: frozenset[str]) -> DataFrame:
    """One row a page: its words that are not common, its line ends with a hyphen, and its head and foot lines."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(common)  # bounded by COMMON_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            rare, ends, edges = [], [], []
            for text in batch.column("raw_text").to_pylist():
                text = text or ""
                rare.append([w for w in tokens_of(text) if w not in common])
                lines = body_lines(text)
                ends.append(line_ends(lines))
                n = len(lines)
                edges.append([{"line_no": i, "place": min(k, n - 1 - k), "line": line} for k, (i, line) in enumerate(lines) if min(k, n - 1 - k) < EDGE and len(line) <= 90])
            kind = pa.list_(pa.struct([("line_no", pa.int32()), ("place", pa.int32()), ("line", pa.string())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "doc_id", "page_number")), pa.array(rare, pa.list_(pa.string())), pa.array(ends, ENDS_ARROW), pa.array(edges, kind)], names=["page_id", "doc_id", "page_number", "rare", "ends", "edges"])

    return pages.select("page_id", "doc_id", "page_number", "raw_text").mapInArrow(run, OUTLINE)


def line_ends(lines: list[tuple[int, str]]) -> list[dict]:
    """Line number, last piece, next piece and mark of each line that ends with a hyphen behind a letter and is followed by another piece."""
    found = []
    for k, (i, line) in enumerate(lines):
        if line[-1] not in MARKS or len(line) < 2 or not line[-2].isalpha():
            continue
        left = line[:-1].split()[-1].lstrip(STRIP_LEFT)
        after = lines[k + 1][1] if k + 1 < len(lines) else ""
        right = re.split(r"[^\w!+-]", after)[0] if after[:1].isalnum() else ""
        if left and right:
            found.append({"line_no": i, "left": left, "right": right, "mark": line[-1]})
    return found


def divided_word(left: str, right: str, count) -> str:
    whole, hyphened = left + right, f"{left}-{right}"
    return hyphened if count(hyphened.lower()) > count(whole.lower()) else whole


def divided(lines: list[tuple[int, str]], joins: Boosted, count) -> list[tuple[int, str]]:
    """(line number, joined word) of each line whose last word goes on in the next line, by the join classifier; a hyphen behind the last letters of a page counts too."""
    found = line_ends(lines)
    if not found:
        return []
    p = joins.predict(np.array([join_features(e["left"], e["right"], e["mark"], count) for e in found]))
    return [(e["line_no"], divided_word(e["left"], e["right"], count)) for e, q in zip(found, p) if q >= 0.5]


def divided_words(ends: DataFrame, words: DataFrame, joins: Boosted) -> DataFrame:
    """(page_id, line_no, joined) of the line ends (page_id, ends) where a word is divided: `divided` with the frequencies of the whole vocabulary.

    Each distinct pair of pieces meets the vocabulary by its four forms. Only undivided occurrences count, or else every line end would be evidence for itself.
    """
    each = ends.select("page_id", F.explode("ends").alias("e")).select("page_id", "e.*")
    pairs = each.select("left", "right", "mark").distinct()

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("left", "right", "mark"))))
            keys = [form for a, b, _ in rows for form in (f"{a}{b}".lower(), a.lower(), b.lower(), f"{a}-{b}".lower())]
            at = pa.array(np.repeat(np.arange(len(rows)), 4))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("left", "right", "mark")), pa.array(keys, pa.string())], names=["left", "right", "mark", "word"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, out = [], []
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("left", "right", "mark", "counts"))))
            counts = [{k: n for k, n in c} for *_, c in rows]
            get = [lambda w, c=c: c.get(w, 0) for c in counts]
            x = [join_features(a, b, m, g) for (a, b, m, _), g in zip(rows, get)]
            for k, p in enumerate(joins.predict(np.array(x)) if x else ()):
                if p >= 0.5:
                    kept.append(k)
                    out.append(divided_word(rows[k][0], rows[k][1], get[k]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(kept, pa.int64())) for c in ("left", "right", "mark")), pa.array(out, pa.string())], names=["left", "right", "mark", "joined"])

    piece = "left string, right string, mark string"
    counted = pairs.mapInArrow(forms, f"{piece}, word string").join(words.where("solid > 0").select("word", "solid"), "word", "left")
    known = counted.groupBy("left", "right", "mark").agg(F.map_from_entries(F.collect_set(F.struct("word", F.coalesce("solid", F.lit(0)).alias("n")))).alias("counts"))
    return each.join(known.mapInArrow(judge, f"{piece}, joined string"), ["left", "right", "mark"]).select("page_id", "line_no", "joined")


def furniture(outline: DataFrame, catalog: DataFrame, titles: Boosted) -> DataFrame:
    """(page_id, doc_id, line_no, is_header, is_number) of the running headers and page numbers at the heads and feet.

    A header is like the title, by the classifier, on at least two pages of the document. A number is the page's own if it is as far from
    page_number on another page of the document; on a document's only numbered page, if it is set off by marks or stands on a header.
    """
    named = catalog.where("doc_id is not null").groupBy("doc_id").agg(F.min("title").alias("title"))
    lines = outline.select("page_id", "doc_id", "page_number", F.explode("edges").alias("e")).select("page_id", "doc_id", "page_number", "e.*").join(named, "doc_id", "left")
    kind = T.StructType([T.StructField("like", T.DoubleType()), T.StructField("value", T.IntegerType()), T.StructField("roman", T.BooleanType()), T.StructField("alone", T.BooleanType()), T.StructField("marked", T.BooleanType())])

    @F.pandas_udf(kind)
    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for own, title in batches:
            x = np.array([title_features(a, b) if b else [0.0, 0.0, 9.0, 9.0, 0.0, 90.0] for a, b in zip(own, title)])
            like = titles.predict(x) if len(x) else np.empty(0)
            rows = []
            for line, p in zip(own, like):
                m, number, alone = NUMBER_LINE.match(line), None, False
                if m:
                    number, alone = number_of(m[1]), True
                elif p >= 0.5 and (m := NUMBER_END.match(line)):
                    number = number_of(m[1] or m[4])
                rows.append((float(p) if not alone else 0.0, number[0] if number else None, bool(number and number[1]), alone, bool(m and alone and not line.isalnum())))
            out = pd.DataFrame(rows, columns=["like", "value", "roman", "alone", "marked"])
            out["value"] = out["value"].astype("Int32")
            yield out

    seen = cut(lines.withColumn("k", look.asNondeterministic()("line", "title")).select("page_id", "doc_id", "page_number", "line_no", "place", "k.*").where("like >= 0.5 or value is not null"))
    headed = seen.where("like >= 0.5").groupBy("doc_id").agg(F.count_distinct("page_id").alias("headed"))
    numbered = seen.where("value is not null").select("doc_id", "page_id", "roman", (F.col("value") - F.col("page_number")).alias("off")).distinct()
    agreeing = numbered.groupBy("doc_id", "roman", "off").agg(F.count("*").alias("agree"))
    pages_with = numbered.groupBy("doc_id").agg(F.count_distinct("page_id").alias("with_number"))
    joined = seen.withColumn("off", F.col("value") - F.col("page_number")).join(headed, "doc_id", "left").join(agreeing, ["doc_id", "roman", "off"], "left").join(pages_with, "doc_id", "left")
    header = (F.col("like") >= 0.5) & (F.col("headed") >= 2)
    sole = (F.col("with_number") == 1) & (F.col("marked") & ~F.col("roman") | ~F.col("alone") & header)
    number = F.col("value").isNotNull() & ((F.col("agree") >= 2) | sole)
    return joined.select("page_id", "doc_id", "line_no", F.coalesce(header, F.lit(False)).alias("is_header"), F.coalesce(number, F.lit(False)).alias("is_number")).where("is_header or is_number")


class Reader:
    """What is learned from a corpus of pages, and the tables drawn from it."""

    def __init__(self, pages: DataFrame, catalog: DataFrame):
        spark: SparkSession = pages.sparkSession
        self.pages = pages.where("page_id is not null")
        weighted, n_pages = deliveries(self.pages)
        words = cut(vocabulary(weighted))
        sample = [(r.word, r.n) for r in words.where((F.col("n") >= 5) & F.col("word").rlike(r"^[\p{L}-]+$")).orderBy(F.desc("n"), "word").limit(SAMPLE).collect()]
        common = [r.word for r in words.where((F.col("n") >= n_pages * COMMON_SHARE + 2) & F.col("word").rlike(r"^[\p{L}-]+$")).select("word").collect()]
        titles = [r.title for r in catalog.where("title is not null").select("title").distinct().orderBy(F.xxhash64("title"), "title").limit(SAMPLE // 15).collect()]
        texts = self.pages.where("raw_text is not null").select("raw_text").orderBy(F.xxhash64("page_id")).limit(SAMPLE // 10).collect()
        body = [line for r in texts for _, line in body_lines(r.raw_text)[EDGE:-EDGE]][:SAMPLE]
        self.joins, self.words = train_joins(sample), words
        self.corrections = cut(corrections(words, train_ranker(sample), n_pages))
        outline = outlines(self.pages, frozenset(common))
        self.outline = cut(outline.dropDuplicates(["page_id"]))
        self.furniture = cut(furniture(self.outline, catalog, train_titles(titles, body)))
        self.spark = spark

    def misread(self) -> DataFrame:
        """(page_id, word, meant)."""
        return self.outline.select("page_id", F.explode("rare").alias("word")).join(self.corrections, "word").select("page_id", "word", "meant")


def page_noise(pages: DataFrame, catalog: DataFrame) -> DataFrame:
    """(page_id, noise_kind): hyphen_break, misread, running_header, page_number, each once per page that holds it.

    Null and empty texts hold no noise; pages of unknown documents have no headers; a page delivered twice counts once; null page_ids are dropped.
    A document may hold any share of the pages: nothing is gathered by document but counts. Empty tables give an empty result.
    """
    r = Reader(pages, catalog)
    kinds = [
        divided_words(r.outline, r.words, r.joins).select("page_id", F.lit("hyphen_break").alias("noise_kind")).distinct(),
        r.misread().select("page_id", F.lit("misread").alias("noise_kind")).distinct(),
        r.furniture.where("is_header").select("page_id", F.lit("running_header").alias("noise_kind")).distinct(),
        r.furniture.where("is_number").select("page_id", F.lit("page_number").alias("noise_kind")).distinct(),
    ]
    out = kinds[0]
    for more in kinds[1:]:
        out = out.union(more)
    return out


def kept_lines(text: str, dropped: set[int]) -> list[tuple[int, str]]:
    return [(i, x.replace("\f", " ").strip()) for i, x in enumerate(text.split("\n"), 1) if i not in dropped]


ITEM = re.compile(r"(?:[-*•–]|\d+[.)])\s")
#: Stands for the line number of the last line where its word goes on on the next page.
PAGE_END = -1


def paragraphs_of(text: str, dropped: set[int], meant: dict[str, str], whole: dict[int, str], behead: bool = False) -> list[str]:
    """The repaired paragraphs of a page: furniture dropped, divided words joined, misread words replaced; `whole` gives the joined word by line,
    under PAGE_END that of the page's last line with what follows it on the next page, where `behead` leaves out the page's first word. A
    blank line ends a paragraph, as do items and headings."""
    kept = kept_lines(text, dropped)
    out: list[str] = []
    current, pending = "", None
    last = max((i for i, line in kept if line), default=None)

    def repair(token: str) -> str:
        token = plain(token)
        core = token.lstrip(STRIP_LEFT).rstrip(STRIP_RIGHT)
        new = meant.get(core.lower())
        if not core or new is None:
            return token
        new = new.upper() if core.isupper() and len(core) > 1 else new.capitalize() if core[0].isupper() else new
        return token.replace(core, new, 1)

    for i, line in kept:
        if not line:
            if current and pending is None:
                out.append(current)
                current = ""
            continue
        tokens = line.split()
        if behead:
            tokens, behead = tokens[1:], False
            if not tokens and i not in whole:
                continue
        if pending is not None:
            first = tokens.pop(0)
            left, joined = pending
            tail = first[len(joined) - len(left) :] if joined == left + first[: len(joined) - len(left)] else first[len(joined) - len(left) - 1 :]
            tokens.insert(0, joined + tail)
            pending = None
        elif current and ITEM.match(line):
            out.append(current)
            current = ""
        if i in whole and tokens:
            stem = tokens.pop()[:-1]
            left = stem.lstrip(STRIP_LEFT)
            pending = (stem, stem[: len(stem) - len(left)] + whole[i])
        elif i == last and PAGE_END in whole and tokens:
            stem = tokens.pop()[:-1]
            tokens.append(stem[: len(stem) - len(stem.lstrip(STRIP_LEFT))] + whole[PAGE_END])
        piece = " ".join(map(repair, tokens))
        current = f"{current} {piece}".strip() if current else piece
    if pending is not None:
        current = f"{current} {pending[0]}".strip()
    return [*out, current] if current else out


def in_document(rows: DataFrame, value: Column, forward: bool, width: int = 256) -> DataFrame:
    """`rows` (doc_id, page_number, page_id, ...) with `beside`: `value` of the next (`forward`) or of the nearest earlier row of the document whose value is not null.

    Rows are ordered within ranges of `width` page numbers, and only one row a range within a document; so a document may hold any share of the pages.
    """
    place = F.struct("page_number", "page_id")
    ranged = rows.withColumn("_r", F.floor(F.col("page_number") / width)).withColumn("_v", value).withColumn("_at", place)
    there = F.col("_v").isNotNull()
    nearest = (F.min_by if forward else F.max_by)(F.when(there, F.col("_v")), F.when(there, F.col("_at")))
    ends = ranged.groupBy("doc_id", "_r").agg(nearest.alias("_e"))
    direction = F.desc if forward else F.asc
    # always the last value so far, in one order or the other: a running frame, which costs a row no more the longer it is
    over = lambda keys, order: F.last(keys[-1], ignorenulls=True).over(Window.partitionBy(*keys[:-1]).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, -1))
    far = ends.select("doc_id", "_r", over(["doc_id", "_e"], "_r").alias("_far"))
    near = ranged.withColumn("_near", over(["doc_id", "_r", "_v"], "_at"))
    return near.join(far, ["doc_id", "_r"]).withColumn("beside", F.coalesce("_near", "_far")).drop("_r", "_v", "_at", "_near", "_far")


def repaired_pages(pages: DataFrame, catalog: DataFrame) -> DataFrame:
    """(page_id, doc_id, page_number, paragraph_no, paragraph, start_page_id, start_no): every page once as repaired paragraphs.

    A paragraph that goes on from the document's page before bears the page and number of the paragraph it began with, else its own; a word
    divided over the page end stands whole on the first of the two pages. See document_paragraphs for the joined text. Pages without text give
    no row and do not part a paragraph; pages without a document or number continue none.
    """
    r = Reader(pages, catalog)
    fixes = r.misread().groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "meant"))).alias("meant"))
    cuts = r.furniture.groupBy("page_id").agg(F.collect_set("line_no").alias("cuts"))
    edges = T.StructType.fromDDL(f"ends {ENDS}, left string, mark string, head string")

    @F.pandas_udf(edges)
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, dropped in batches:
            rows = []
            for t, d in zip(text, dropped):
                lines = [(i, x) for i, x in kept_lines(t or "", set(d) if d is not None else set()) if x]
                end = lines[-1][1] if lines else ""
                open_ = len(end) > 1 and end[-1] in MARKS and end[-2].isalpha()
                rows.append((line_ends(lines), end[:-1].split()[-1].lstrip(STRIP_LEFT) if open_ else None, end[-1] if open_ else None, lines[0][1].split()[0] if lines else None))
            yield pd.DataFrame(rows, columns=["ends", "left", "mark", "head"])

    @F.pandas_udf(T.StructType.fromDDL("parts array<string>, item boolean"))
    def build(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for text, dropped, meant, whole, behead in batches:
            rows = []
            for t, d, m, w, b in zip(text, dropped, meant, whole, behead):
                drop = set(d) if d is not None else set()
                lead = next((x for _, x in kept_lines(t or "", drop) if x), "")
                rows.append((paragraphs_of(t or "", drop, dict(m) if m is not None else {}, dict(w) if w is not None else {}, bool(b)), bool(ITEM.match(lead))))
            yield pd.DataFrame(rows, columns=["parts", "item"])

    # which pieces meet at a line end depends on the furniture between them, and at a page end on the next page with text
    pages_cut = r.pages.dropDuplicates(["page_id"]).join(cuts, "page_id", "left")
    outer = cut(pages_cut.select("page_id", "doc_id", "page_number", find.asNondeterministic()("raw_text", "cuts").alias("e")).select("page_id", "doc_id", "page_number", "e.*"))
    placed = outer.where("head is not null and doc_id is not null and page_number is not null").select("doc_id", "page_number", "page_id", "left", "mark", "head")
    following = in_document(placed, F.struct(F.col("head").alias("word"), F.col("page_id").alias("page")), True).where("left is not null and beside is not null")
    right = F.regexp_extract("beside.word", r"^([\p{L}\p{N}][\p{L}\p{N}_!+-]*)", 1)
    over = cut(following.select("page_id", "left", right.alias("right"), "mark", F.substring(F.col("beside.word"), F.length(right) + 1, F.length("beside.word")).alias("tail"), F.col("beside.page").alias("next_page")).where("right <> ''"))
    at_end = over.select("page_id", F.array(F.struct(F.lit(PAGE_END).alias("line_no"), "left", "right", "mark")).alias("ends"))
    divided_at = cut(divided_words(outer.select("page_id", "ends").union(at_end), r.words, r.joins))
    crossing = divided_at.where(F.col("line_no") == PAGE_END).join(over.select("page_id", "tail", "next_page"), "page_id")
    words = divided_at.where(F.col("line_no") != PAGE_END).union(crossing.select("page_id", "line_no", F.concat("joined", "tail")))
    wholes = words.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("line_no", "joined"))).alias("wholes"))
    beheaded = crossing.select(F.col("next_page").alias("page_id"), F.lit(True).alias("behead")).distinct()
    joined = pages_cut.join(fixes, "page_id", "left").join(wholes, "page_id", "left").join(beheaded, "page_id", "left")
    built = cut(joined.select("page_id", "doc_id", "page_number", build.asNondeterministic()("raw_text", "cuts", "meant", "wholes", "behead").alias("b")).select("page_id", "doc_id", "page_number", "b.parts", "b.item").where("size(parts) > 0"))

    # where each page's first paragraph began: behind a page whose last one is open, at the last paragraph that began anew
    ended = F.element_at("parts", -1).rlike(r"[.!?:…][\"'”’»)\]]*$")
    flow = built.where("doc_id is not null and page_number is not null").select("doc_id", "page_number", "page_id", F.size("parts").alias("n"), "item", ended.alias("ended"))
    before = in_document(flow, F.col("ended"), False).withColumn("joined", ~F.col("item") & ~F.coalesce("beside", F.lit(True))).drop("beside")
    anchor = F.when((F.col("n") > 1) | ~F.col("joined"), F.struct(F.col("page_id").alias("page"), F.col("n").alias("no")))
    began = in_document(before, anchor, False).where("joined").select("page_id", "beside")
    rows = built.join(began, "page_id", "left").select("page_id", "doc_id", "page_number", "beside", F.posexplode("parts").alias("pos", "paragraph"))
    first = (F.col("pos") == 0) & F.col("beside").isNotNull()
    return rows.select("page_id", "doc_id", "page_number", (F.col("pos") + 1).alias("paragraph_no"), "paragraph", F.when(first, F.col("beside.page")).otherwise(F.col("page_id")).alias("start_page_id"), F.when(first, F.col("beside.no")).otherwise(F.col("pos") + 1).alias("start_no"))


def document_paragraphs(repaired: DataFrame) -> DataFrame:
    """(doc_id, start_page_id, start_no, page_start, page_end, text): the continuous paragraphs of each document, by (page_start, start_page_id, start_no) in its order. A task holds one paragraph at a time."""
    piece = F.struct("page_number", "page_id", "paragraph_no", "paragraph")
    return repaired.groupBy("doc_id", "start_page_id", "start_no").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda s: s["paragraph"]), " ").alias("text"))
