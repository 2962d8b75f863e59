"""Text expressions: normalisation, lines, headings, sentences, tokens, questions. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.vectors import let

# Explicit classes, for the engines differ in what \s and \w mean outside ASCII.
WS = r"[\s\x0B\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
# Ligatures and dashes with what replaces them.
REPLACED = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("–", "-"), ("—", "-"))
QUOTES = (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"))
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "e.g.", "i.e.", "etc.", "vs.", "Fig.", "Eq.", "Eqs.", "No.", "Vol.", "pp.", "et al.", "Inc.", "Ltd.", "Corp.")
#: Stands for a protected full stop; control characters of this range do not survive normalisation.
STOP = "\x01"
# Capitalised words that are no terms, and openings of questions that ask for nothing in particular.
STOP_TERMS = ("The", "This", "That", "These", "Those", "A", "An")
GENERIC = r"^(?:what is the|what are the|can you|please|tell me)"
# Question forms by place; the fifth takes two terms.
QUESTION_FORMS = ("What is %s?", "How does %s work?", "What are the characteristics of %s?", "Why is %s important?", "What is the relationship between %s and %s?", "How is %s used?")


def strip_ws(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def normalize_text(text: Column, fix_quotes: bool = False) -> Column:
    """The ordered clean-up of a page's text; null gives ''. Newlines are collapsed before spaces around them go, so blank lines holding spaces survive."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    t = F.regexp_replace(t, r"\r\n|\r", "\n")
    t = F.regexp_replace(t, rf"({WORD}+)-\n({WORD}+)", "$1$2")
    for a, b in REPLACED + (QUOTES if fix_quotes else ()):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(F.regexp_replace(t, r" +\n", "\n"), r"\n +", "\n")
    return strip_ws(t)


def split_lines(text: Column) -> Column:
    """The stripped, non-empty lines."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip_ws), lambda x: x != "")


def words_of(text: Column) -> Column:
    return F.filter(F.split(strip_ws(text), rf"{WS}+"), lambda x: x != "")


def heading_score(line: Column, trailing_dot: bool = False) -> Column:
    """0 to 1, by numbering, capitals, title case, missing full stop and length. `trailing_dot` also takes '1. Title' for numbered."""
    dot = r"\.?" if trailing_dot else ""

    def of(s: Column) -> Column:
        n = F.char_length(s)
        titled = let(words_of(s), lambda words: F.size(F.filter(words, lambda w: F.substring(w, 1, 1).rlike(r"^\p{Lu}"))) * 2 > F.size(words))
        score = (
            F.when(s.rlike(rf"^[0-9]+(\.[0-9]+)*{dot}{WS}+[^\s]+"), F.lit(0.4)).otherwise(F.lit(0.0))
            + F.when(n.between(5, 120) & (F.upper(s) == s) & (F.lower(s) != s), F.lit(0.3)).otherwise(F.lit(0.0))
            + F.when((n < 100) & titled, F.lit(0.2)).otherwise(F.lit(0.0))
            + F.when(~s.endswith("."), F.lit(0.1)).otherwise(F.lit(0.0))
        )
        return F.when(n < 3, F.lit(0.0)).otherwise(let(score, lambda x: F.least(F.when(n > 150, x * 0.5).otherwise(x), F.lit(1.0))))

    return F.when(line.isNull(), F.lit(0.0)).otherwise(let(strip_ws(line), of))


def section_level(title: Column, deepest_first: bool = False) -> Column:
    """2 for titles numbered d.d, else 1; with `deepest_first`, 3 for d.d.d."""
    two = F.when(title.rlike(r"^[0-9]+\.[0-9]+"), 2).otherwise(1)
    return F.when(title.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+"), 3).otherwise(two) if deepest_first else two


def split_sentences(text: Column) -> Column:
    """Sentences without their closing marks; abbreviations do not end one, pieces of three characters or less are dropped."""
    t = F.coalesce(text, F.lit(""))
    for a in ABBREVIATIONS:
        t = F.regexp_replace(t, r"\b" + a.replace(".", r"\."), a.replace(".", STOP))
    pieces = F.split(t, rf"[.!?]+(?:{WS}+|\z)")
    return F.filter(F.transform(pieces, lambda x: F.replace(strip_ws(x), F.lit(STOP), F.lit("."))), lambda x: F.char_length(x) > 3)


def token_count(text: Column) -> Column:
    """Offline default: words between white space."""
    return F.size(words_of(F.coalesce(text, F.lit("")))).cast("int")


def alnum_ratio(text: Column) -> Column:
    """Letters and digits by characters, 0 for empty text."""
    n = F.char_length(text)
    return F.when(n > 0, F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) / n).otherwise(F.lit(0.0))


def file_stem(path: Column) -> Column:
    """The file name without folders and without its last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def prompt(template: str, text: Column, limit: int = 2000) -> Column:
    """`template` with one %s for the first `limit` characters, the model's own bound."""
    return F.format_string(template, F.substring(text, 1, limit))


def capitalized_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[A-Z][a-z]+$"))


def statement_to_question(statement: Column) -> Column:
    """What/How question about a statement's subject; null for short ones."""
    s = strip_ws(statement)
    subject_is = F.regexp_extract(s, rf"^([A-Z][^.!?]+?){WS}+is{WS}+[^.!?]+", 1)
    subject_does = F.regexp_extract(s, rf"^([A-Z][^.!?]+?){WS}+(?:does|do|did){WS}+[^.!?]+", 1)
    words = words_of(s)
    return (
        F.when(s.isNull() | (F.char_length(s) < 10), F.lit(None).cast("string"))
        .when(subject_is != "", F.concat(F.lit("What is "), strip_ws(subject_is), F.lit("?")))
        .when(subject_does != "", F.concat(F.lit("How does "), strip_ws(subject_does), F.lit(" work?")))
        .when(F.size(words) > 3, F.concat(F.lit("What is "), F.array_join(F.slice(words, 1, 3), " "), F.lit("?")))
    )


def long_sentences(text: Column) -> Column:
    """Rough sentences of more than 20 characters."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), rf"[.!?]+{WS}+"), strip_ws), lambda x: F.char_length(x) > 20)


def phrases(text: Column) -> Column:
    """Quoted, then parenthetical phrases of 6 to 49 characters, then subjects of definitions."""
    quoted = F.regexp_extract_all(text, F.lit("[\"']([^\"']+)[\"']"), F.lit(1))
    bracketed = F.regexp_extract_all(text, F.lit(r"\(([^)]+)\)"), F.lit(1))
    sized = F.filter(F.concat(quoted, bracketed), lambda x: (F.char_length(x) > 5) & (F.char_length(x) < 50))
    defined = F.regexp_extract_all(text, F.lit(rf"([A-Z][a-z]+(?:{WS}+[A-Z][a-z]+)*){WS}+(?:is|are){WS}+[^.,;]+"), F.lit(1))
    return F.concat(F.transform(sized, strip_ws), defined)


def key_terms(text: Column) -> Column:
    """Up to 20: of the ten most frequent capitalised words (ties by first occurrence) those that are terms, then phrases and definitions."""
    def terms(caps: Column) -> Column:
        counted = F.transform(F.array_distinct(caps), lambda w, i: F.struct((-F.size(F.filter(caps, lambda x: x == w))).alias("n"), i.alias("i"), w.alias("w")))
        top = F.transform(F.slice(F.array_sort(counted), 1, 10), lambda s: s["w"])
        return F.filter(top, lambda w: ~w.isin(*STOP_TERMS) & (F.char_length(w) > 3))

    safe = F.coalesce(text, F.lit(""))
    return F.slice(F.array_distinct(F.concat(let(capitalized_words(safe), terms), phrases(safe))), 1, 20)


def heuristic_questions(text: Column, n: int = 3) -> Column:
    """n questions: term i takes form i modulo 6 (the two-term form the next term as well, or the first form at the end), then long sentences turned into questions."""

    def ask(terms: Column) -> Column:
        def fill(t: Column, i: Column) -> Column:
            following = F.try_element_at(terms, i + 2)
            out = F.format_string(QUESTION_FORMS[0], t)
            for k, form in enumerate(QUESTION_FORMS):
                if form.count("%s") == 2:
                    out = F.when((i % 6 == k) & following.isNotNull(), F.format_string(form, t, following)).otherwise(out)
                else:
                    out = F.when(i % 6 == k, F.format_string(form, t)).otherwise(out)
            return out

        return F.transform(F.slice(terms, 1, n), fill)

    def complete(asked: Column) -> Column:
        missing = F.greatest(F.lit(n) - F.size(asked), F.lit(0))
        made = F.filter(F.transform(F.slice(long_sentences(text), F.lit(1), missing), statement_to_question), lambda q: q.isNotNull())
        return F.slice(F.concat(asked, F.when(missing > 0, made).otherwise(F.array().cast("array<string>"))), 1, n)

    return let(let(key_terms(text), ask), complete)


def json_questions(text: Column) -> Column:
    """Strings of the first [...] if it is a JSON list; empty if not."""
    found = F.from_json(F.regexp_extract(text, r"(?s)\[.*?\]", 0), "array<string>")
    return F.coalesce(F.filter(F.transform(found, strip_ws), lambda x: x != ""), F.array().cast("array<string>"))


def numbered_questions(text: Column) -> Column:
    item = r"(?m)(?:^|\n)\s*(?:\d+[.)]|-|\*)\s*(.+?)(?=\n\s*(?:\d+[.)]|-|\*)|\n\n|$)"
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(item), F.lit(1)), strip_ws), lambda x: x != "")


def marked_questions(text: Column) -> Column:
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(r"([^.!?]*\?)"), F.lit(1)), lambda x: (F.char_length(x) > 10) & (strip_ws(x) != "")), strip_ws)


def line_questions(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), strip_ws), lambda x: x.contains("?") | x.rlike("^(?:What|How|Why|When|Where)"))
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^[\d.)\-*]\s*", "")), lambda x: F.char_length(x) > 10)


def first_or(rest: Column):
    return lambda found: F.when(F.size(found) > 0, found).otherwise(rest)


def post_process_questions(questions: Column, n: int) -> Column:
    """First of equal ones (whatever the case), longer than 10 characters, not generic, at most n."""
    keys = F.transform(questions, lambda q: F.struct(q.alias("q"), F.lower(strip_ws(q)).alias("k")))

    def firsts(all_: Column) -> Column:
        names = F.transform(all_, lambda s: s["k"])
        kept = F.filter(F.transform(all_, lambda s, i: F.struct(s["q"].alias("q"), s["k"].alias("k"), (F.array_position(names, s["k"]) == i + 1).alias("first"))), lambda s: s["first"] & (F.char_length(s["k"]) > 10) & ~s["k"].rlike(GENERIC))
        return F.slice(F.transform(kept, lambda s: s["q"]), 1, n)

    return let(keys, firsts)


def parse_questions(text: Column, n: int = 3, asked: Column | None = None) -> Column:
    """Questions of a model's answer: JSON list, else numbered items, else sentences with a question mark, else lines that look like questions. `asked` is a prompt to cut off first."""
    t = F.coalesce(text, F.lit(""))
    if asked is not None:
        t = F.when(F.startswith(t, asked), F.substring(t, F.char_length(asked) + 1, F.char_length(t))).otherwise(t)

    def cascade(x: Column) -> Column:
        out = line_questions(x)
        for stage in (marked_questions, numbered_questions, json_questions):
            out = let(stage(x), first_or(out))
        return out

    return post_process_questions(let(t, cascade), n)
