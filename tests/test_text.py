import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as tx


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "line, score",
    [("INTRODUCTION", 0.6), ("1. Introduction", 0.1), ("1 Introduction", 0.5), ("1.1 Data Model", 0.7), ("Chapter Two", 0.3), ("THE END.", 0.5), ("12 monkeys escaped.", 0.4), ("Final content.", 0.0), ("AB", 0.0), ("A" * 200, 0.05), ("", 0.0), (None, 0.0)],
)
def test_heading_score(spark, line, score):
    assert one(spark, tx.heading_score, line) == pytest.approx(score)


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("exam-\nple", "example"), ("a\r\nb\rc", "a\nb\nc"), ("\x00x\x0c", "x"), ("ﬁn—al", "fin-al"), ("x \n \n \ny", "x\n\n\ny"), ("“q”", "“q”"),
        ("a-\nb-\nc", "ab-\nc"), ("a\t  b", "a b"), (None, ""), ("", ""), ("  x  ", "x"), ("a\n\n\n\nb", "a\n\nb"),
    ],
)
def test_normalize(spark, raw, clean):
    assert one(spark, tx.normalize_text, raw) == clean


def test_normalize_quotes(spark):
    assert one(spark, lambda c: tx.normalize_text(c, fix_quotes=True), "“q” ‘r’") == "\"q\" 'r'"


def test_lines(spark):
    assert one(spark, tx.split_lines, " a \n\n b\n \nc") == ["a", "b", "c"]
    assert one(spark, tx.split_lines, None) == []


def test_sentences(spark):
    assert one(spark, tx.split_sentences, "Dr. Smith came. It rained! Really? Yes. See Fig. 3 and so on.") == ["Dr. Smith came", "It rained", "Really", "See Fig. 3 and so on"]
    assert one(spark, tx.split_sentences, None) == []


def test_long_text(spark):
    assert len(one(spark, tx.split_sentences, "Some words stand here. " * 20_000)) == 20_000


def test_statement_to_question(spark):
    ask = lambda x: one(spark, tx.statement_to_question, x)
    assert ask("Machine Learning is a subset of AI.") == "What is Machine Learning?"
    assert ask("The engine does run well") == "How does The engine work?"
    assert ask("Three words only here") == "What is Three words only?"
    assert ask("short") is None and ask(None) is None


def test_questions(spark):
    text = "Quarry Stone is hard. Quarry work needs care. The 'crushed gravel' (river bed) lies here."
    terms = one(spark, tx.key_terms, text)
    assert terms[:2] == ["Quarry", "Stone"] and "crushed gravel" in terms and "river bed" in terms and "Quarry Stone" in terms
    five = one(spark, lambda c: tx.heuristic_questions(c, 5), text)
    assert five[0] == "What is Quarry?" and five[4] == "What is the relationship between Quarry Stone and" + five[4].split("and", 1)[1] if terms[4:] and len(terms) > 5 else len(five) == 5
    assert one(spark, lambda c: tx.heuristic_questions(c, 3), None) == []


@pytest.mark.parametrize(
    "answer, expected",
    [
        ('Sure: ["Who built the old mill?", "who built the old mill?", "What is the age?"]', ["Who built the old mill?"]),
        ("1. Who built the old mill?\n2) Where does it stand now?", ["Who built the old mill?", "Where does it stand now?"]),
        ("Some text. Who built the old mill? More.", ["Who built the old mill?"]),
        ("How the mill turns in wind\nnothing", ["How the mill turns in wind"]),
        ("", []), (None, []),
    ],
)
def test_parse_questions(spark, answer, expected):
    assert one(spark, lambda c: tx.parse_questions(c, 3), answer) == expected


def test_file_stem(spark):
    assert one(spark, tx.file_stem, "a/b/c.d.pdf") == "c.d"
