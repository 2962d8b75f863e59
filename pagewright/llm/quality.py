"""Per-document text quality statistics and a rule-based verdict with its reason (problem 9)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks that open a list item.
BULLET = re.compile(r"\s*(?:[-*+•–—·▪◦‣●○■□☐☑✓➢→»]|\(?\d{1,4}(?:\.\d{1,3})*[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)]|\[[ xX]?\])\s+\S")
LEADER = re.compile(r"(?:\.\s?){4,}\s*[\divxlc]+\s*$|…+\s*\d+\s*$|_{4,}\s*\d+\s*$")
INDEX_ENTRY = re.compile(r"^[^.!?]{1,60}?,\s*\d{1,4}(?:\s*[-–]\s*\d{1,4})?(?:,\s*\d{1,4}(?:\s*[-–]\s*\d{1,4})?)*\s*$")
CRUMB = re.compile(r"\s[>»›|/·•]\s")
RULE = re.compile(r"^[\s|+:=\-─━═┼│┌┐└┘├┤_]{3,}$")
WIDE_GAP = re.compile(r"\S(?:\s{2,}|\t)(?=\S)")
CELL_NUMBER = re.compile(r'^["\']?[-+]?[$€£]?\d[\d.,]*\s?%?["\']?$')
CODE = re.compile(
    r"[;{}]\s*$|^\s*(?:var|let|const|function|def|class|import|from|return|public|private|static|#include|if\s*\(|for\s*\(|while\s*\(|@media|<\?php|SELECT\b)"
    r"|=>|\)\s*\{|\w\(\w*\)\s*[;{.]|</?[a-zA-Z][^>]*>|&[a-z]+;|^\s*[.#][\w-]+\s*\{|^\s*[\w-]+\s*:\s*[^;]+;\s*$|[=!]==|\w+\[\d+\]"
)
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
VOWEL = re.compile(r"[aeiouyàâäáãåæèéêëìíîïòóôöõøœùúûüýÿ]", re.I)
CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxz]{6}", re.I)
STOP = re.compile(r"[.!?][\"'”’»)]*$")
CAPTION = re.compile(r"^(?:table|tabelle|tableau|tabla|tabella)\s+\d+\b", re.I)

#: Thresholds of the verdict, chosen here.
THRESHOLDS = {
    "min_common_share": 0.12,
    "max_symbol_share": 0.28,
    "max_damage_share": 0.02,
    "max_long_token_share": 0.5,
    "max_top_word_share": 0.34,
    "min_pronounceable_share": 0.7,
    "min_case_regular_share": 0.75,
    "larger_part": 0.5,
    "lead_in_part": 0.25,
    "lead_in_rows": 0.8,
}

# Published rules for text to train language models on, with their thresholds. gopher: Rae et al. 2021, Scaling Language Models, appendix A.1.1;
# fineweb: Penedo et al. 2024, The FineWeb Datasets, section 3.6.
STOP_WORDS = frozenset("the be to of and that have with".split())
PUBLISHED = {
    "gopher_words_50_to_100000": "n_words < 50 or n_words > 100000",
    "gopher_mean_word_length_3_to_10": "mean_word_length < 3 or mean_word_length > 10",
    "gopher_symbols_to_words_0.1": "mark_word_ratio > 0.1",
    "gopher_bullet_lines_0.9": "bullet_share > 0.9",
    "gopher_ellipsis_lines_0.3": "ellipsis_line_share > 0.3",
    "gopher_alphabetic_tokens_0.8": "alphabetic_share < 0.8",
    "gopher_two_stop_words": "n_stop_words < 2",
    "fineweb_punctuated_lines_0.12": "punct_line_share <= 0.12",
    "fineweb_short_lines_0.67": "short_line_share >= 0.67",
    "fineweb_duplicate_line_chars_0.01": "duplicate_line_share >= 0.01",
}

STATS = T.StructType([
    T.StructField(name, T.LongType() if name.startswith("n_") else T.DoubleType())
    for name in (
        "n_chars", "n_words", "n_lines", "n_stop_words", "mean_word_length", "symbol_share", "punct_line_share", "common_share", "bullet_share", "digit_share", "damage_share",
        "long_token_share", "top_word_share", "distinct_word_share", "pronounceable_share", "case_regular_share", "list_part", "table_part", "code_part", "prose_part", "row_share",
        "mark_word_ratio", "ellipsis_line_share", "alphabetic_share", "short_line_share", "duplicate_line_share",
    )
])
#: Characters that are worked on at once; a longer text makes a step of its own.
STEP_CHARS = 4_000_000


def split_cells(line: str) -> list[str]:
    """Cells of a table row under the delimiter that parts it best; one cell where nothing parts it."""
    if line.count("|") >= 2 and " | " in line or line.strip().startswith("|"):
        return [c.strip() for c in line.strip().strip("|").split("|")]
    if "\t" in line:
        return [c.strip() for c in line.split("\t")]
    for mark in (";", ","):
        n = line.count(mark)
        if n >= 2:
            cells = line.split(mark)
            # a comma or semicolon of running text is followed by a space and stands between long stretches
            if sum(1 for c in cells[1:] if c[:1] != " ") >= 0.8 * n and max(map(len, cells)) <= 40:
                return [c.strip() for c in cells]
    if len(WIDE_GAP.findall(line)) >= 1 and len(line.strip()) > 4:
        cells = re.split(r"\s{2,}|\t", line.strip())
        if len(cells) >= 3 or len(cells) == 2 and any(CELL_NUMBER.match(c) for c in cells):
            return cells
    return [line]


def line_kind(line: str, common: frozenset[str]) -> str:
    """item, table, code or prose for one stripped, non-empty line."""
    if RULE.match(line):
        return "table"
    if BULLET.match(line):
        return "item"
    if LEADER.search(line):
        return "item"
    tokens = line.split()
    if 3 <= len(tokens) <= 40 and sum(1 for t in tokens if CELL_NUMBER.match(t)) >= 0.75 * len(tokens) or CAPTION.match(line):
        return "table"
    cells = split_cells(line)
    own = WORD.findall(line)
    if len(cells) >= 3 and max(map(len, cells)) <= 60:
        crumbs = CRUMB.search(line) and not line.startswith("|") and not any(ch.isdigit() for ch in line)
        return "item" if crumbs else "table"
    if len(cells) == 2 and any(CELL_NUMBER.match(c) for c in cells):
        return "table"
    share = sum(1 for w in own if w.lower() in common) / len(own) if own else 0.0
    if CODE.search(line) and (share < 0.2 or line.endswith(("{", "}", ";", ">"))):
        return "code"
    if CRUMB.search(line) and len(own) <= 12 or INDEX_ENTRY.match(line):
        return "item"
    if len(own) <= 5 and len(line) <= 48 and not STOP.search(line) and not (share >= 0.5 and len(own) >= 4):
        return "item"
    return "prose"


KNOWN: dict[str, tuple] = {}


def token_words(token: str, common: frozenset[str]) -> tuple:
    """(lower-case word, three letters or more, pronounceable, regular case, common) of each word in a token; remembered, for texts share most tokens."""
    found = KNOWN.get(token)
    if found is None:
        found = tuple(
            (
                w.lower(),
                len(w) >= 3,
                len(w) >= 3 and VOWEL.search(w) is not None and CLUSTER.search(w) is None,
                w.islower() or w.isupper() or w[1:].islower() or "-" in w or "'" in w or "’" in w,
                w.lower() in common,
            )
            for w in WORD.findall(token)
        )
        if len(KNOWN) >= 200_000:  # bounds the memory, not the result
            KNOWN.clear()
        if len(token) <= 60:
            KNOWN[token] = found
    return found


# The expressions of the line rules once more for Arrow's string kernels, where \s, \d and \w know ASCII only.
SPACE, LETTER = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]", r"[\p{L}\p{Nl}\p{No}]"
ARROW = {
    "rule": r"^[\s|+:=\-─━═┼│┌┐└┘├┤_]{3,}$",
    "bullet": rf"^(?:[-*+•–—·▪◦‣●○■□☐☑✓➢→»]|\(?\p{{Nd}}{{1,4}}(?:\.\p{{Nd}}{{1,3}})*[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{{1,5}}[.)]|\[[ xX]?\]){SPACE}+\S",
    "leader": rf"(?:\.{SPACE}?){{4,}}{SPACE}*[\p{{Nd}}ivxlc]+{SPACE}*$|…+{SPACE}*\p{{Nd}}+{SPACE}*$|_{{4,}}{SPACE}*\p{{Nd}}+{SPACE}*$",
    "caption": r"(?i)^(?:table|tabelle|tableau|tabla|tabella)\s+\p{Nd}+(?:[^\p{L}\p{N}_]|$)",
    "crumb": rf"{SPACE}[>»›|/·•]{SPACE}",
    "index": r"^[^.!?]{1,60}?,\s*\p{Nd}{1,4}(?:\s*[-–]\s*\p{Nd}{1,4})?(?:,\s*\p{Nd}{1,4}(?:\s*[-–]\s*\p{Nd}{1,4})?)*\s*$",
    "code": r"[;{}]\s*$|^\s*(?:var|let|const|function|def|class|import|from|return|public|private|static|#include|if\s*\(|for\s*\(|while\s*\(|@media|<\?php|SELECT\b)"
    r"|=>|\)\s*\{|\w\(\w*\)\s*[;{.]|</?[a-zA-Z][^>]*>|&[a-z]+;|^\s*[.#][\w-]+\s*\{|^\s*[\w-]+\s*:\s*[^;]+;\s*$|[=!]==|\w+\[\d+\]",
    "stop": r"""[.!?]["'”’»)]*$""",
    "end": rf"""[.!?…:;]["'”’»)\]]*{SPACE}*$""",
    "ellipsis": r"(?:…|\.\.\.)$",
    "gap": rf"\S(?:{SPACE}{{2,}}|\t)\S",
}


def holds(lines: pa.Array, name: str) -> np.ndarray:
    return pc.match_substring_regex(lines, ARROW[name]).to_numpy(zero_copy_only=False).astype(bool)


def counts_of(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def line_kinds(lines: pa.Array, common: frozenset[str]) -> np.ndarray:
    """The line_kind of each line: lines that may hold cells one by one, all others by masks over the whole array, with the same result."""
    n = len(lines)
    size = pc.utf8_length(lines).to_numpy(zero_copy_only=False)
    commas, semicolons, bars = (counts_of(lines, x) for x in (",", ";", r"\|"))
    cells = (bars >= 2) | holds(lines, "gap") | pc.match_substring(lines, "\t").to_numpy(zero_copy_only=False).astype(bool) | pc.starts_with(lines, "|").to_numpy(zero_copy_only=False).astype(bool)
    for count, apart in ((commas, ", "), (semicolons, "; ")):
        cells |= (count >= 2) & (count - counts_of(lines, apart) >= 0.8 * count)
    digits = counts_of(lines, r"\p{Nd}") > 0
    numbers = np.zeros(n, bool)
    some = np.flatnonzero(digits & ~cells)
    if len(some):
        spread = pc.replace_substring_regex(lines.take(pa.array(some)), rf"{SPACE}+", "  ")
        tokens = counts_of(spread, r"[^ ]+")
        numeric = counts_of(spread, r"""(?:^| )["']?[-+]?[$€£]?\p{Nd}[\p{Nd}.,]*%?["']?(?: |$)""")
        numbers[some] = (tokens >= 3) & (tokens <= 40) & (numeric >= 0.75 * tokens)
    words = counts_of(lines, rf"{LETTER}+(?:['’-]{LETTER}+)*")
    code, short, stop = holds(lines, "code"), (words <= 5) & (size <= 48), holds(lines, "stop")
    share = np.zeros(n)
    for i in np.flatnonzero(code | short & (words >= 4) & ~stop):
        own = WORD.findall(lines[i].as_py())
        share[i] = sum(1 for w in own if w.lower() in common) / len(own) if own else 0.0
    ended = pc.match_substring_regex(lines, r"[{};>]$").to_numpy(zero_copy_only=False).astype(bool)
    kind = np.select(
        [holds(lines, "rule"), holds(lines, "bullet") | holds(lines, "leader"), numbers | holds(lines, "caption"), code & ((share < 0.2) | ended), holds(lines, "crumb") & (words <= 12) | holds(lines, "index"), short & ~stop & ~((share >= 0.5) & (words >= 4))],
        ["table", "item", "table", "code", "item", "item"], "prose",
    )
    for i in np.flatnonzero(cells):
        kind[i] = line_kind(lines[i].as_py(), common)
    return kind


def shares(a: np.ndarray, b: np.ndarray, empty: float = 0.0) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), empty), where=b > 0)


def profiles(texts: pa.Array, common: frozenset[str]) -> pd.DataFrame:
    """The statistics of each text, over the whole of it, in the order of STATS: tokens and lines of all texts are looked at together, every distinct token once."""
    n = len(texts)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    total = lambda at, weight=None: np.bincount(at, weight, n).astype(float)

    lists = pc.utf8_split_whitespace(texts)
    parent, tokens = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
    full = pc.greater(pc.binary_length(tokens), 0)
    parent, tokens = parent[full.to_numpy(zero_copy_only=False)], tokens.filter(full)
    coded = tokens.dictionary_encode()
    codes, distinct = coded.indices.to_numpy(), coded.dictionary
    sizes = pc.utf8_length(distinct).to_numpy()
    found = [token_words(t, common) for t in distinct.to_pylist()]
    spans = np.array([len(f) for f in found], np.int64)
    flat = [w for f in found for w in f]
    at = np.repeat(np.arange(len(found)), spans)
    traits = np.array([(len(w), *flags) for w, *flags in flat], float).reshape(-1, 5)
    by_token = [np.bincount(at, x, len(found)) for x in traits.T]
    n_words = total(parent, spans[codes])
    letters, long_words, pronounced, regular, n_common = (total(parent, x[codes]) for x in by_token)
    dense, unbroken = total(parent, sizes[codes]), total(parent, np.where(sizes > 40, sizes, 0)[codes])
    alphabetic = total(parent, (spans > 0)[codes])
    n_tokens = total(parent)

    # how often each word stands in each text: tokens by text first, then their words
    ids: dict[str, int] = {}
    word_ids = np.array([ids.setdefault(w[0], len(ids)) for w in flat], np.int64)
    pair, times = np.unique(parent.astype(np.int64) * max(1, len(found)) + codes, return_counts=True)
    doc, token = pair // max(1, len(found)), pair % max(1, len(found))
    begin = np.concatenate([[0], np.cumsum(spans)])
    reach = spans[token]
    which = np.repeat(begin[token] - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum()) if len(token) else np.empty(0, np.int64)
    key, slot = np.unique(np.repeat(doc, reach) * max(1, len(ids)) + word_ids[which], return_inverse=True) if len(which) else (np.empty(0, np.int64), np.empty(0, np.int64))
    often = np.bincount(slot, np.repeat(times, reach), len(key)) if len(key) else np.empty(0)
    owner = key // max(1, len(ids))
    most = np.zeros(n)
    np.maximum.at(most, owner, often)
    stops = np.array([w in STOP_WORDS for w in ids], bool)
    n_stops = total(owner[stops[key % max(1, len(ids))]]) if len(key) else np.zeros(n)

    broken = pc.split_pattern(pc.replace_substring_regex(texts, r"\r\n|[\r\f\v\x{2028}\x{2029}]", "\n"), "\n")
    line_of, lines = pc.list_parent_indices(broken).to_numpy(), pc.utf8_trim_whitespace(broken.flatten())
    full = pc.greater(pc.binary_length(lines), 0)
    line_of, lines = line_of[full.to_numpy(zero_copy_only=False)], lines.filter(full)
    length = pc.utf8_length(lines).to_numpy().astype(float)
    kind = line_kinds(lines, common)
    n_lines, solid = total(line_of), total(line_of, length)
    part = {k: total(line_of, length * (kind == k)) for k in ("item", "table", "code", "prose")}
    rows = total(line_of, ((kind == "item") | (kind == "table")).astype(float))
    line_code = lines.dictionary_encode()
    _, first = np.unique(line_of.astype(np.int64) * max(1, len(line_code.dictionary)) + line_code.indices.to_numpy(), return_index=True) if len(lines) else (None, np.empty(0, np.int64))
    again = np.ones(len(lines))
    again[first] = 0

    digits, plain = counts_of(texts, "[0-9]"), counts_of(texts, r"""[.,;:!?'"()\-’“”–—«»¿¡]""")
    damage = counts_of(texts, "�|[ÃÂ][\\x{80}-¿ÂÃ€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œ©¨´§ª®¯°±²³¶·¸¹º»¼½¾]|â€.|[\\x{80}-\\x{9f}]")
    marks = counts_of(texts, r"#|…|\.\.\.")
    out = {
        "n_chars": pc.utf8_length(texts).to_numpy(), "n_words": n_words, "n_lines": n_lines, "n_stop_words": n_stops, "mean_word_length": shares(letters, n_words), "symbol_share": shares(np.maximum(0, dense - letters - digits - plain), dense),
        "punct_line_share": shares(total(line_of, holds(lines, "end").astype(float)), n_lines), "common_share": shares(n_common, n_words), "bullet_share": shares(total(line_of, holds(lines, "bullet").astype(float)), n_lines),
        "digit_share": shares(digits, dense), "damage_share": shares(damage, dense), "long_token_share": shares(unbroken, dense), "top_word_share": shares(most, n_words), "distinct_word_share": shares(total(owner), n_words),
        "pronounceable_share": shares(pronounced, long_words, 1.0), "case_regular_share": shares(regular, n_words, 1.0), "list_part": shares(part["item"], solid), "table_part": shares(part["table"], solid), "code_part": shares(part["code"], solid),
        "prose_part": shares(part["prose"], solid), "row_share": shares(rows, n_lines), "mark_word_ratio": shares(marks, n_words), "ellipsis_line_share": shares(total(line_of, holds(lines, "ellipsis").astype(float)), n_lines),
        "alphabetic_share": shares(alphabetic, n_tokens), "short_line_share": shares(total(line_of, (length < 30).astype(float)), n_lines), "duplicate_line_share": shares(total(line_of, again * length), solid),
    }
    blank = n_lines == 0
    for name in ("pronounceable_share", "case_regular_share"):
        out[name][blank] = 0.0
    return pd.DataFrame({k: v.astype(np.int64) if k.startswith("n_") else v for k, v in out.items()})


def steps(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about STEP_CHARS characters."""
    start, used = 0, 0
    for i, size in enumerate(sizes):
        if used and used + size > STEP_CHARS:
            yield start, i
            start, used = i, 0
        used += size
    if start < len(sizes):
        yield start, len(sizes)


def verdict(s: Column) -> Column:
    """kind and reason of a statistics struct: the first rule that holds, in this order."""
    t = {k: F.lit(v) for k, v in THRESHOLDS.items()}
    built = s.list_part + s.table_part
    structured = (built > t["larger_part"]) | ((built > t["lead_in_part"]) & (s.row_share > t["lead_in_rows"]))
    shape = F.when(s.table_part >= s.list_part, F.lit("table")).otherwise(F.lit("list"))
    rules = [
        (s.mean_word_length + s.digit_share == 0, F.lit("junk"), "no_letters_or_digits"),
        (s.damage_share > t["max_damage_share"], F.lit("junk"), "damaged_encoding"),
        ((s.symbol_share > t["max_symbol_share"]) & (built <= t["larger_part"]), F.lit("junk"), "symbols"),
        # rows of a table may be numbers and rules alone, items of a list hold words
        ((s.n_words == 0) & (s.table_part <= t["larger_part"]), F.lit("junk"), "no_words"),
        ((s.long_token_share > t["max_long_token_share"]) & (s.table_part <= t["larger_part"]), F.lit("junk"), "unbroken_characters"),
        (structured, shape, "larger_part_in_rows"),
        (s.code_part > t["larger_part"], F.lit("junk"), "code"),
        (s.pronounceable_share < t["min_pronounceable_share"], F.lit("junk"), "unpronounceable"),
        (s.case_regular_share < t["min_case_regular_share"], F.lit("junk"), "mixed_case_inside_words"),
        ((s.top_word_share > t["max_top_word_share"]) & (s.n_words >= 8), F.lit("junk"), "repeated_word"),
        (s.common_share < t["min_common_share"], F.lit("junk"), "no_common_words"),
    ]
    out = F.struct(F.lit("prose").alias("kind"), F.lit(None).cast("string").alias("reason"))
    for test, kind, reason in reversed(rules):
        out = F.when(test, F.struct(kind.alias("kind"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def published(s: Column) -> Column:
    """The names of the published rules that a statistics struct fails."""
    named = {f.name: s[f.name] for f in STATS}
    tests = []
    for name, rule in PUBLISHED.items():
        either = None
        for clause in rule.split(" or "):
            left, how, right = clause.split()
            x, y = named[left], F.lit(float(right))
            one = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[how]
            either = one if either is None else either | one
        tests.append(F.when(either, F.lit(name)))
    return F.array_compact(F.array(*tests))


def quality_statistics(documents: DataFrame, common_words: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics of `text`, `kind` (prose, list, table, junk), `reason` (the rule that made the kind, null for prose) and `failed` (the published rules that fail, all of them) to every row.

    Rows are treated one by one: there is no shuffle, and a repeated row gives a repeated result. A null text counts as empty and is junk
    with reason no_letters_or_digits; an empty table gives an empty result. Columns of `documents` that bear a name of a result column are
    replaced. `common_words` is a fixed word list (a few hundred rows, sent to the driver; over 100,000 words it is refused); null words are ignored.
    """
    rows = common_words.select(F.lower("word").alias("word")).where("word is not null").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("common_words is not a word list")
    common = frozenset(r.word for r in rows)

    @F.pandas_udf(STATS)
    def statistics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        KNOWN.clear()
        names = [f.name for f in STATS]
        for batch in batches:
            texts = pa.array(batch, pa.large_string(), from_pandas=True)
            parts = [profiles(texts.slice(a, b - a), common) for a, b in steps(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))]
            yield (pd.concat(parts) if parts else pd.DataFrame(columns=names))[names]

    statistics = statistics.asNondeterministic()  # else each use of a result column runs the function again

    own = {f.name for f in STATS} | {"kind", "reason", "failed", "_s", "_v"}
    kept = [c for c in documents.columns if c not in own or c == text]
    base = documents.select(*[documents[c] for c in kept], statistics(documents[text]).alias("_s"))
    judged = base.withColumn("_v", verdict(F.col("_s"))).withColumn("_f", published(F.col("_s")))
    return judged.select(*kept, *[f"_s.{f.name}" for f in STATS if f.name != text], "_v.kind", "_v.reason", F.col("_f").alias("failed"))
