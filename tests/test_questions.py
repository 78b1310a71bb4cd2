"""Wording to intent, stated values, abstentions and hostile input."""

from __future__ import annotations

import inspect
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from groundtally.functions import dims
from groundtally.functions import questions as Q
from groundtally.operators import classify
from groundtally.plans import answers, questions

SF = "/root/testdata/sf0.001"

GOLDEN = [
    ("Is there any arable land in the image?", "presence"),
    ("Are coniferous forests visible here?", "presence"),
    ("Does pastures cover at least 30% of the image?", "area"),
    ("Is there some part of the image not covered by mixed forest?", "area"),
    ("How much of the scene is occupied by inland waters?", "area"),
    ("Are there exactly three connected regions of urban fabric?", "count"),
    ("Is there only a single continuous region of pastures?", "count"),
    ("Do arable land and pastures share a common boundary?", "adjacency"),
    ("Is any urban fabric next to marine waters?", "adjacency"),
    ("What is the relative position of the lake with respect to the city?", "relative_position"),
    ("In which season was this taken? a) Spring, b) Summer, c) Autumn, d) Winter", "metadata_mcq"),
    ("Describe the land cover of this scene.", "caption"),
    ("Give the box of <ref>largest patch of pastures</ref>.", "referring_expr"),
    ("Which region lies at <point>(0.25 0.75)</point>?", "referring_point"),
    ("Identify the land cover type: a) Pastures, b) Mixed forest, c) Arable land, d) Urban fabric.", "presence"),
    ("Which classes meet? a) Pastures and Arable land, b) Mixed forest and Pastures, c) Inland waters and Pastures, d) Urban fabric and Pastures", "adjacency"),
]


def read(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, input string")
    return {r.id: r for r in Q.parse(df).collect()}


def test_golden_intents(spark):
    got = read(spark, *[q for q, _ in GOLDEN])
    assert {i: (got[i].intent, got[i].reason) for i in got} == {i: (w, None) for i, (_, w) in enumerate(GOLDEN)}


def test_option_classes_supply_a_missing_subject(spark):
    r = read(spark, GOLDEN[-1][0])[0]
    assert (r.class_a, r.class_b, r.matched_rule) == ("Pastures", "Arable land", "adjacency_synonym+option_classes")


def test_short_forms_do_not_match_inside_words(spark):
    r = read(spark, "In which season is the research town? a) Spring, b) Summer, c) Autumn, d) Winter")[0]
    assert r.intent == "metadata_mcq" and r.class_a is None
    df = spark.createDataFrame([("which season",)], "t string").select(Q.mentions(F.col("t")).alias("w"), Q.mentions(F.col("t"), "substring").alias("s")).first()
    assert df.w == [] and df.s == ["Marine waters"]


@pytest.mark.parametrize("text,unit,percent", [
    ("Does pastures cover at least 30% of the image?", "percent", 30.0), ("Is over 144,000 m2 pastures?", "m2", 10.0),
    ("Is over 144000 m^2 of it pastures?", "m2", 10.0), ("Are 288000 sq m of the area pastures?", "m2", 20.0), ("Does pastures fill 25 percent of the area?", "percent", 25.0)])
def test_stated_areas(spark, text, unit, percent):
    v = read(spark, text)[0].stated_value
    assert v.unit == unit and v.as_percent == pytest.approx(percent)


def test_between_with_units(spark):
    r = read(spark, "Does pastures take up between 144000 m^2 and 288000 m^2 of the area?")[0]
    assert r.comparator == "between" and (r.stated_value.as_percent, r.stated_upper.as_percent) == (10.0, 20.0)


def test_number_words_follow_list_order_not_text_order(spark):
    df = spark.createDataFrame([("at least three or two patches",)], "t string").select(Q.stated_count(F.col("t")).alias("v")).first()
    assert df.v.value == 2.0


def test_malformed_number_abstains_instead_of_failing(spark):
    assert read(spark, "Does pastures cover 1.2.3% of the area?")[0].stated_value.value is None


def test_abstentions(spark):
    got = read(spark, "", "   ", None, "Hello there", "Is there any lava in the image?", "Is pastures next to something?", "x" * 4001, "<ref>something</ref>", "'; DROP TABLE x; -- \u0000 \ufffd (((")
    assert [got[i].reason for i in range(9)] == [
        "empty question", "empty question", "empty question", "no intent cue matched", "no class name resolved in the stem",
        "adjacency needs two classes, found 1", "question exceeds 4000 chars", "<ref> tag resolved to no class", "no intent cue matched"]
    assert all(got[i].intent is None for i in range(9))


def test_repeated_letter_keeps_last_text(spark):
    r = spark.createDataFrame([("a) one, b) two, a) three",)], "t string").select(Q.options_of(F.col("t")).alias("o")).first()
    assert [(x.letter, x.text) for x in r.o] == [("a", "three"), ("b", "two")]


@pytest.mark.parametrize("text,way", [("to the bottom-left", "SW"), ("top right", "NE"), ("above it", "N"), ("on the left", "W"), ("south-east corner", "SE"), ("nowhere", None)])
def test_option_directions(spark, text, way):
    assert spark.createDataFrame([(text,)], "t string").select(Q.option_direction(F.col("t")).alias("d")).first().d == way


def test_inverted_subject(spark):
    rows = [("Relative to the lake, where is the city?", True), ("Using the lake as the reference, where is the city?", True),
            ("What is the direction from the lake to the city?", True), ("Where is the city? a) relative to", False)]
    df = spark.createDataFrame(rows, "t string, want boolean").withColumn("got", Q.subject_is_second(F.col("t")))
    assert all(r.got == r.want for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_registered_classifiers_leave_the_stop_to_the_tolerance(spark, monkeypatch):
    asked, least = [], inspect.signature(classify.fit).parameters["iterations"].default

    def note(*args, iterations=least, **kwargs):
        asked.append(iterations)
        raise InterruptedError

    monkeypatch.setattr(classify, "fit", note)
    for query in (questions.e18, questions.e18_combined, answers.f14):
        with pytest.raises(InterruptedError):
            query(spark, SF)
    assert asked == [least] * 3 and least >= 5000  # the reference's limit


def test_masking_takes_the_first_free_occurrence_of_each_form(spark):
    """Against plain Python on random strings of forms, parts of forms and fillers."""
    rng = random.Random(11)
    forms = [f for f, *_ in dims.surface_forms()]
    parts = sorted({w for f in forms for w in f.split()})
    patterns = [re.compile(r"(?<![\w])" + r"[,\s]+".join(re.escape(w) for w in f.split()) + r"(?![\w])", re.I) for f in forms]

    def plain(text):
        taken, spans = [False] * len(text), []
        for pattern in patterns:
            for m in pattern.finditer(text):
                if not any(taken[m.start():m.end()]):
                    taken[m.start():m.end()] = [True] * (m.end() - m.start())
                    spans.append(m.span())
                    break
        out, end = [], 0
        for a, b in sorted(spans):
            out += [text[end:a], " _CLASS_ "]
            end = b
        return "".join(out) + text[end:]

    def one():
        pool = rng.sample(forms, 3)
        words = [rng.choice([rng.choice(pool), rng.choice(pool), rng.choice(parts), rng.choice(["is", "covered", "season", "(x)", "9%"])]) for _ in range(rng.randint(0, 9))]
        text = "".join(w + rng.choice([" ", ", ", "/", "  "]) for w in words)
        return "".join(c.upper() if rng.random() < 0.1 else c for c in text)

    texts = [one() for _ in range(20_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8).select("id", Q.mask_classes(F.col("text")).alias("cue")).collect()
    assert len(rows) == len(texts)
    wrong = [(texts[r.id], r.cue, plain(texts[r.id])) for r in rows if r.cue != plain(texts[r.id])]
    assert not wrong, wrong[:3]
    assert sum(t.count(" _CLASS_ ") > 1 for t in map(plain, texts)) > 1000
