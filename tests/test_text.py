import random

import pytest
from pyspark.sql import functions as F

from poolcraft.functions import text as T
from poolcraft.operators import contact, facts, passages

CV = """# Ada Byron
ada@mail.example | +1 415 555 0100 | 12 Long Street, Springfield, IL 62704

## Experience
- **Spearheaded** a rewrite of the billing pipeline, cutting cost by 20%
- Led a team of 5 engineers to build the reporting service in Java
- Led a team of 50 engineers to build the reporting service in Java
1) Grew revenue 12.5% and 40 % in one year with [your product]
### Acme (Jan 2019 - 2020-12)
Engineer, 2021/03 to present. {{company}}

## Skills
C, C++, Java; java | SQL / R, C#

## Education
M.S. in Computer Science, Lovelace College, 2012
"""


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, markdown string").withColumn("pos", F.lit("clash"))


def test_primitives(spark):
    row = spark.createDataFrame([("  Café — C++ 4M  ", "a\x0bb\r\nc d", "x")], "a string, b string, c string").select(
        T.normalize(F.col("a")).alias("n"), T.lines(F.col("b")).alias("l"), T.heading_level(F.lit("## C# and F#")).alias("h"), T.contains_quote(F.lit("A  b\nc"), F.lit("a B c")).alias("q"),
        T.contains_quote(F.lit("x"), F.lit("  ")).alias("blank"), T.jaccard(T.words(F.lit("led 5 teams 4m")), T.words(F.lit("led 50 teams 4m"))).alias("j"),
        T.jaccard(T.words(F.lit("5 6")), T.words(F.lit("x"))).alias("zero"), T.contains_quote(F.lit(None).cast("string"), F.lit("a")).alias("null"),
    ).first()
    assert row.n == "caf c 4m" and row.l == ["a", "b", "c", "d"] and row.h == 2
    assert row.q is True and row.blank is False and row.j == 1.0 and row.zero == 0.0 and row.null is False


def test_facts(spark):
    df = docs(spark, CV, None, "", "plain text without anything " * 5000)
    assert [r.match for r in facts.placeholders(df).orderBy("seq").collect()] == ["[your product]", "{{company}}"]
    style = {r.id: r for r in facts.bullet_style(df).collect()}
    assert set(style) == {0} and style[0].bullet_count == 4 and style[0].power_verb_density == 0.25 and style[0].metric_count == 2 and style[0].round_metric_ratio == 0.5
    assert {r.id: r.skills_count for r in facts.skills(df).collect()} == {0: 2, 1: 0, 2: 0, 3: 0}
    degree = {r.id: (r.present, r.level, r.field) for r in facts.degrees(df).collect()}
    assert degree[0] == (True, "MSc", "Computer Science") and degree[1] == (False, None, None)
    ranges = [(r.first, r.last, r.precise) for r in facts.date_ranges(df).orderBy("pos").collect()]
    assert ranges == [(2019 * 12, 2020 * 12 + 11, True), (2021 * 12 + 2, None, True)]


def test_passages(spark):
    long = "- Built the ingestion service for three partner banks\n- one two"
    items = passages.bullets(docs(spark, CV, long, long, None))
    assert {r.id: (r.passages, r.partners) for r in passages.shared_counts(items).collect()} == {1: (1, 1), 2: (1, 1)}
    near = passages.near_within(items).collect()
    assert [(r.id, r.similarity) for r in near] == [(0, 1.0)]
    assert passages.shared_passages(items).first().owners == 2


def test_hidden_kind(spark):
    rows = spark.createDataFrame([(0xFFFFFF, 10.0, 0), (0xF0F0F0, 10.0, 0), (0, 2.0, 0), (0, 10.0, 3), (0, 10.0, 0)], "c int, s double, m int")
    assert [r.k for r in rows.select(facts.span_kind(F.col("c"), F.col("s"), F.col("m")).alias("k")).collect()] == ["white_on_white", "white_on_white", "micro_font", "invisible_render_mode", None]


def test_slug_and_fields(spark):
    rows = spark.createDataFrame([("alexmorgan", "Alex Morgan"), ("morgan-alex-12", "Alex Morgan"), ("completely-other", "Alex Morgan"), ("u1", "Alex Morgan"), ("abc", "")], "s string, n string")
    assert [r.m for r in rows.select(facts.slug_matches_name(F.col("s"), F.col("n")).alias("m")).collect()] == [True, True, False, None, None]
    fields = spark.createDataFrame([([("Ethnicity", "x"), (" Current City ", "Hanoi, Vietnam")],), (None,)], "f array<struct<name:string,value:string>>")
    got = [r.v for r in fields.select(T.labelled_value(F.col("f"), ["current city"]).alias("v")).collect()]
    assert got == ["Hanoi, Vietnam", None]
    values = ["Hanoi, Vietnam", "Interested in work across Singapore and Vietnam", "vietnam.com", None, "Austin, TX"]
    assert [r.r for r in spark.createDataFrame([(v,) for v in values], "v string").select(facts.is_residence(F.col("v")).alias("r")).collect()] == [True, False, False, False, False]


def test_redact(spark):
    people = spark.createDataFrame([(0, "ada@mail.example", "+1 415 555 0100", "Ada", "Byron"), (2, None, None, None, None)], "id bigint, email string, phone string, first_name string, last_name string")
    text = CV + "\nByron wrote it. Worked at Byron Labs. See 2019-03 and +44 20 7946 0958.\n"
    df = docs(spark, text, None, "no person here, call 415-555-2671")
    out = {r.id: r for r in contact.redact(df, people).collect()}
    assert out[0].text.startswith("# [NAME] [NAME]\n[EMAIL] | [PHONE] | ") or out[0].text.startswith("# [NAME]\n[EMAIL] | [PHONE] | ")
    assert "Byron Labs" in out[0].text and "[NAME] wrote it" in out[0].text and "2019-03" in out[0].text and "7946" not in out[0].text and "62704" not in out[0].text
    assert out[1].text == "" and out[1].kinds == {} and out[2].kinds == {"phone": 1}
    again = {r.id: r.text for r in contact.redact(spark.createDataFrame([(0, out[0].text)], "id bigint, markdown string"), people).collect()}
    assert again[0] == out[0].text
    assert {r.id: r.leaks for r in contact.leaks(spark.createDataFrame([(0, out[0].text), (1, "a@b.cc 4155552671999"), (2, None)], "id bigint, text string")).collect()} == {0: [], 1: ["email", "phone"], 2: []}


def test_near_within_equals_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{'x' * rng.randrange(6)}{i}y" for i in range(30)]
    rows = []
    for k in range(6):
        base = [rng.sample(words, rng.randrange(5, 14)) for _ in range(4)]
        for pos in range(40):
            one = list(rng.choice(base))
            if rng.random() < 0.6:
                one[rng.randrange(len(one))] = rng.choice(words)
            rng.shuffle(one)
            rows.append((k, pos, " ".join(one)))
    rows += [(9, 0, "1 2 3 4 5 6"), (9, 1, "1 2 3 4 5 6"), (9, 2, None)]
    for t in (0.85, 0.6):
        want = {}
        for k, p, x in rows:
            for k2, q, y in rows:
                if k == k2 and p < q and k < 9 and min(len(x.split()), len(y.split())) >= 6:
                    u, v = set(x.split()), set(y.split())
                    if len(u & v) / len(u | v) >= t:
                        want[k, p, q] = round(len(u & v) / len(u | v), 3)
        got = {(r.id, r.pos_a, r.pos_b): r.similarity for r in passages.near_within(spark.createDataFrame(rows, "id bigint, pos int, bullet string"), threshold=t).collect()}
        assert got == pytest.approx(want, abs=0.0011) and want


def test_separated_team_claims(spark):
    text = "- Ran an offshore unit.\n- Partnered with a team in Poland and India. Lived in Spain.\n\nOur engineers in Germany shipped it.\n- ran an OFFSHORE unit!\nA team in Texas."
    rows = {(r.sentence, tuple(r.places)) for r in facts.separated_team_claims(docs(spark, text, None, "")).collect()}
    assert rows == {("Ran an offshore unit.", ()), ("Partnered with a team in Poland and India.", ("india", "poland")), ("Our engineers in Germany shipped it.", ("germany",))}


def test_residence_zone(spark):
    told = {"FL": "ET", "ny": "ET", "Friendswood texas": "CT", "Boise, ID": "MT", "i live in oregon": "PT", "West Virginia": "ET", "or maybe": None, "Georgia": None, "zz": None, "": None, None: None}
    rows = spark.createDataFrame([(k,) for k in told], "v string").select("v", facts.residence_zone(F.col("v")).alias("z")).collect()
    assert {r.v: r.z for r in rows} == told


def test_short_names_are_redacted(spark):
    people = spark.createDataFrame([(0, None, None, "Bo", "Li"), (1, None, None, "Al", None)], "id bigint, email string, phone string, first_name string, last_name string")
    texts = docs(spark, "CV\n\n- one\n- two\n\nWritten by BO LI, not by Bo. Bo Lindt too.", "- x\nAl ran it, Ali did not.")
    rows = {r.id: (r.text, r.kinds) for r in contact.redact(texts, people).collect()}
    assert rows[0] == ("CV\n\n- one\n- two\n\nWritten by [NAME], not by Bo. Bo Lindt too.", {"name": 1})
    assert rows[1][1] == {}


def test_value_that_is_no_place_is_passed_over(spark):
    rows = spark.createDataFrame([([("City", "www.me.com"), ("Location ", " Oslo ")],), ([("city", "a@b.de")],)], "p array<struct<name:string,value:string>>")
    assert [r.v for r in rows.select(T.labelled_value(F.col("p"), ["city", "location"], facts.NOT_A_PLACE).alias("v")).collect()] == ["Oslo", None]


def test_members_of_shared_passages(spark):
    from poolcraft.operators import passages

    a, b = "Cut the cost of every batch run by half", "Led a team of nine people across two sites"
    docs = spark.createDataFrame([(1, f"- {a}\n- {b}\n"), (2, f"- {a.upper()}\n"), (3, f"- {b}\n- {a}\n- Only here and in no other text at all\n"), (4, "- Only this one has this other line here\n")], "id bigint, markdown string")
    rows = passages.members(passages.bullets(docs)).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.h, {})[r.id] = r.bullet
    assert sorted(groups.values(), key=len) == [{1: b, 3: b}, {1: a, 2: a.upper(), 3: a}]
    assert {r.h: r.owners for r in passages.shared_passages(passages.bullets(docs)).collect()} == {h: len(g) for h, g in groups.items()}
