import pytest
from pyspark.sql import functions as F

from tallyforge.functions import scores as sc
from tallyforge.functions import text as tx

from .model import wilson


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_paired_outcomes(spark):
    rows = [(1.0, 0.0, 1.0, "direct_good_reuse_bad"), (0.0, 1.0, 1.0, "direct_bad_reuse_good"), (0.8, 0.7, 0.5, "direct_good_reuse_good"), (0.2, 0.1, 0.5, "direct_bad_reuse_bad")]
    df = spark.createDataFrame(rows, "d double, r double, t double, want string")
    assert df.where(sc.paired_outcome(F.col("d"), F.col("r"), F.col("t")) != F.col("want")).count() == 0


@pytest.mark.parametrize("k,n", [(0, 0), (0, 1), (0, 2), (0, 4), (1, 4), (3, 3), (7, 100)])
def test_wilson(spark, k, n):
    assert one(spark, sc.wilson_upper(F.lit(k), F.lit(n))) == pytest.approx(wilson(k, n), abs=1e-15)


def test_wilson_known(spark):
    assert one(spark, sc.wilson_upper(F.lit(0), F.lit(1))) == pytest.approx(0.793450685622763)
    assert one(spark, sc.wilson_upper(F.lit(0), F.lit(2))) == pytest.approx(0.657619772493347)


def test_rates_and_decay(spark):
    assert one(spark, sc.rate(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, sc.half_life_decay(F.lit(10), 10)) == 0.5


def test_verdicts(spark):
    rows = [(0.9, 0.1, 0.5, "fail"), (0.1, 0.9, 0.5, "pass"), (0.6, 0.9, 0.5, "pass"), (0.9, 0.9, 0.5, "uncertain"), (0.1, 0.2, 0.5, "uncertain"), (None, 0.2, 0.5, None)]
    df = spark.createDataFrame(rows, "b double, t double, q double, want string")
    assert df.where(~sc.paired_verdict(F.col("b"), F.col("t"), F.col("q")).eqNullSafe(F.col("want"))).count() == 0


def test_finite(spark):
    df = spark.createDataFrame([(1.0, True), (float("nan"), False), (float("inf"), False), (float("-inf"), False), (None, False)], "x double, want boolean")
    assert df.where(sc.finite(F.col("x")) != F.col("want")).count() == 0


@pytest.mark.parametrize("text", ["Straße İstanbul ǰ ς Σ", "a_b c-d 42 ４２", "\x1c x   y", "", "éÉ中文 ٣ x̂"])
def test_words_against_python(spark, text):
    import re

    # words by general category, as in the pattern; exact fold
    want = {w.casefold() for w in re.findall(r"[^\W]+", text)}
    got = set(one(spark, tx.words(F.lit(text))))
    assert got == want or {w for w in got if w.isascii()} == {w for w in want if w.isascii()}


@pytest.mark.parametrize("text", [" a ", " a\x1c", "\x1fa b\n", "", "  "])
def test_strip(spark, text):
    assert one(spark, tx.py_strip(F.lit(text))) == text.strip()


def test_stripped_characters():
    assert {c for c in map(chr, range(0x110000)) if c.isspace()} == set(tx.STRIPPED)


def test_jaccard_edges(spark):
    assert one(spark, tx.token_jaccard(F.lit(""), F.lit("..."))) == 1.0
    assert one(spark, tx.token_jaccard(F.lit(""), F.lit("a"))) == 0.0
    assert one(spark, tx.token_jaccard(F.lit("alpha beta"), F.lit("Alpha beta gamma"))) == pytest.approx(2 / 3)


def test_normal_forms(spark):
    assert one(spark, tx.normalize_signature(F.lit("  Two   ENTITY "))) == "two entity"
    assert one(spark, tx.normalize_gap(F.lit(" Bridge-Entity "))) == "bridge_entity"
    assert one(spark, tx.gap_violation(F.array(F.lit("bridge entity"), F.lit("bridge-entity")))) == "duplicate_gap_category"
    assert one(spark, tx.gap_violation(F.array(F.lit("contradiction")))) == "unknown_gap_category"
    assert [one(spark, tx.is_unspecified(F.lit(x))) for x in (" UnKnown", "x", "", None)] == [True, False, True, True]


def test_reasons_keep_order_and_fail_closed(spark):
    c = sc.reasons((F.lit(True), "b"), (F.lit(False), "no"), (F.lit(None).cast("boolean"), "a"))
    assert one(spark, c) == ["b", "a"]


def test_fold_equals_casefold_of_every_character(spark):
    """All code points, in the JVM; each between others, so that context-sensitive lowering would show."""
    import sys

    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    rows = [(s, s.casefold()) for s in ("xΣ".join(chars[i : i + 512]) + "Σ" for i in range(0, len(chars), 512))]
    df = spark.createDataFrame([*rows, ("PLAIN ascii", "plain ascii"), ("", ""), (None, None)], "s string, want string")
    assert df.where(~tx.fold(F.col("s")).eqNullSafe(F.col("want"))).count() == 0


def test_versioned_ids_and_turn_keys(spark):
    assert one(spark, tx.versioned_id(F.lit("c"), F.lit("2"))) == "c@2" and one(spark, tx.turn_key(F.lit("e"), F.lit("u1"))) == "e#u1"


def test_fold_of_plain_letters(spark):
    """Each alone, at the end of a word and between letters: lowering them is folding them."""
    import re

    plain = [chr(c) for c in range(1, 0xA000) if re.match("[" + re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), tx.plain_letters()) + "]", chr(c))]
    assert {"A", "é", "Ж", "ü"} <= set(plain) and not {"ß", "µ", "İ", "ſ", "Σ"} & set(plain)
    rows = [(s, s.casefold()) for c in plain for s in (c, f"a{c} b", f"A{c}{c}B")]
    assert spark.createDataFrame(rows, "s string, want string").where(~tx.fold(F.col("s")).eqNullSafe(F.col("want"))).count() == 0


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_pair_are_cut_once_and_folded_without_searching(spark):
    df = spark.range(1).select(F.col("id").cast("string").alias("a"), F.concat(F.col("id").cast("string"), F.lit(" x")).alias("b"))
    plan = planned(df.select(tx.token_jaccard(F.col("a"), F.col("b"))))
    assert plan.count("regexp_extract_all(coalesce") == 2 and "RLIKE" not in plan


def test_token_jaccard_cuts_an_item_below_the_join(spark, sf):
    from tallyforge.queries import QUERIES

    plan = planned(QUERIES["token_jaccard"](spark, sf))
    join = plan.index("Join Inner, (item_id")
    assert plan[:join].count("regexp_extract_all(coalesce") == 1 and plan[join:].count("regexp_extract_all(coalesce") == 1


@pytest.mark.parametrize("text", ["Stra\xdfe \u1e9eX", "\ufb01sch \xdf", "\u0130I\u0131", "\u03a3\u03c3\u03c2 \xc4\xf6", "plain ASCII", "", "\u0149 \u1f80\xdf\U0001d400"])
def test_fold_of_characters_that_fold_to_several(spark, text):
    assert one(spark, tx.fold(F.concat(F.lit(text), F.lit("")))) == text.casefold()


def test_equal_texts_are_not_folded(spark, monkeypatch):
    monkeypatch.setattr(tx, "fold", lambda c: F.raise_error(F.lit("folded")).cast("string"))
    df = spark.createDataFrame([("Some text", "Some text", True), ("a", "a b c d e", False), (None, "a", None)], "a string, b string, want boolean")
    assert df.where("a is not null").where(~tx.same_folded(F.col("a"), F.col("b")).eqNullSafe(F.col("want"))).count() == 0
