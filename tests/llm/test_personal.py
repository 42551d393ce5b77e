import numpy as np
import pytest

from poolcraft.llm import personal as P

FINDER = P.Finder(frozenset(map(P.fold, ["Ada", "Zoë", "Tomas"])), frozenset(map(P.fold, ["Byron", "Quigstad", "Núñez-Balta", "O'Lannan"])))

CASES = [
    ("# Ada B. Byron\r\nada.byron+jobs@mail.example | x", {("name", "adabbyron"), ("email", "adabyronjobsmailexample")}),
    ("ada (at) web dot example dot com\n", {("email", "adaatwebdotexampledotcom")}), ("<ada@mail.example>\n", {("email", "adamailexample")}), ("mailto:ada @ mail.example\n", {("email", "adamailexample")}),
    ("Byron, Ada\n+49 (0) 30 / 23125-698\n", {("name", "byronada"), ("phone", "4903023125698")}), ("**ZOË NÚÑEZ-BALTA**\nTel. 671 555 0158 ext. 346 | UT\n", {("name", "zoënúñezbalta"), ("phone", "6715550158ext346")}),
    ("# T O M A S   Q U I G S T A D\n☎ 01 99 00 70 97\n", {("name", "tomasquigstad"), ("phone", "0199007097")}), ("- Reported to Dr. Zoë O'Lannan at head office.\n", {("name", "zoëolannan")}),
    ("Documents: Driving licence no. F684-2837-4009\nTax ID 00 158 809 359\nNI number QQ 76 66 47 C\n", {("id_number", "f68428374009"), ("id_number", "00158809359"), ("id_number", "qq766647c")}),
    ("Documents: DNI 21920970-F\nDNI 75901163-B\n", {("id_number", "21920970f"), ("id_number", "75901163b")}), ("Request 00246328\n", set()), ("9084 West Copperfield Drive, Apt 4B, Saltcreek, UT 64964\n", {("address", "9084westcopperfielddrive")}),
    ("23 bis avenue du Moulin, 28203 Millford\n", {("address", "23bisavenuedumoulin")}), ("Weidenstr. 102b, 93185 Valmeyrac\n", {("address", "weidenstr102b")}), ("Post Office Box 390, Bay\n", {("address", "postofficebox390")}),
    ("Am Alten Speicher 134, 39757 Bay\n", {("address", "amaltenspeicher134")}),
    ("Ticket reference 20395919, build 4.15.9272.\nProcessed 79 000 000 events over 2019-03 to 2021-06.\nSpeaker on 12 ways to place an order.\nSenior Engineer, Byron Labs (2019 - 2021)\n", set()),
]


def test_finder():
    for text, wanted in CASES:
        spans = FINDER.spans(text)
        sure = {(P.KINDS[k], P.plain(text[a:b])) for a, b, k, votes, _ in spans if votes.count(P.YES) > votes.count(P.NO)}
        assert sure == wanted, text


def test_unknown_names_reach_the_vote():
    """Names that no list has: who is dealt with like a person gets a vote for it, a place and an organisation don't."""
    for text, name, vote in [
        ("Spoke to Priyanka Raghunathan about the audit.", "Priyanka Raghunathan", P.YES), ("I met Oluwaseun Adeyemi in Lagos.", "Oluwaseun Adeyemi", P.YES), ("My supervisor, Kwame Nkrumah Osei, approved it.", "Kwame Nkrumah Osei", P.YES),
        ("We came to know Lars Thorvaldsen, who led it.", "Lars Thorvaldsen", P.YES), ("Housed in Quarry Bendt for years.", "Quarry Bendt", P.NO), ("We read Ardent Valem daily.", "Ardent Valem", P.ABSTAIN),
    ]:
        (found,) = FINDER.spans(text)
        assert text[found[0] : found[1]] == name and found[2] == 4 and found[3][4] == vote
    assert not any(P.YES in span[3] for span in FINDER.spans("Manager, Ardent Valem Foods.\nPAIRED DAILY WITH MANY COLLEAGUES."))


def test_unknown_names_are_found_and_redacted(spark):
    known = ["# Ada Byron\nada@mail.example\n\n- Worked with Ada Byron in Quarry Bendt and read Ardent Valem.\n"] * 40
    told = ["# Ada Byron\n\nSpoke to Priyanka Raghunathan about the audit in Lower Saxonia.", "# Ada Byron\n\n" + "word " * 300 + "I met Oluwaseun Adeyemi and went home.", "# Ada Byron\n\nMy supervisor, Kwame Nkrumah Osei, approved it."]
    texts = spark.createDataFrame([("parsed", i, t) for i, t in enumerate([*known, *told])], "src string, id bigint, text string")
    found = {(r.id, r.value) for r in P.personal_data(texts, people(spark)).collect() if r.kind == "name" and r.value != "adabyron"}
    assert found == {(40, "priyankaraghunathan"), (41, "oluwaseunadeyemi"), (42, "kwamenkrumahosei")}
    done = {r.id: r.text for r in P.redact(texts, people(spark)).collect()}
    assert done[40] == "# [NAME]\n\nSpoke to [NAME] about the audit in Lower Saxonia." and done[42] == "# [NAME]\n\nMy supervisor, [NAME], approved it."


def test_streets_with_the_word_first():
    for text, street in [("Calle Mayor 5\n", "Calle Mayor 5"), ("ul. Marszałkowska 12, Warszawa\n", "ul. Marszałkowska 12"), ("Lived at Via Giuseppe Garibaldi 22. Left.", "Via Giuseppe Garibaldi 22"), ("lives " + "very " * 60 + "far, Rua das Flores 7\n", "Rua das Flores 7")]:
        spans = [text[a:b] for a, b, kind, _, _ in FINDER.spans(text) if kind == 3]
        assert spans == [street], text


def test_many_spans_in_one_line():
    text = "ada@mail.example, " * 4000
    spans = FINDER.spans(text)
    assert len(spans) == 4000 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_reliabilities_recover():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    good = np.array([0.95, 0.9, 0.8, 0.75])
    right = rng.random((4000, 4)) < good
    votes = np.where(right == truth[:, None], P.YES, P.NO)
    votes[rng.random((4000, 4)) < 0.2] = P.ABSTAIN
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, share, theta = P.reliabilities(patterns, counts.astype(float))
    assert abs(share - 0.3) < 0.04 and np.abs(theta[:, 1, P.YES] - good).max() < 0.06
    assert ((posterior[which.ravel()] > 0.5) == truth).mean() > 0.93


def people(spark):
    return spark.createDataFrame([("Ada", "Byron")] * 3 + [(None, ""), ("x1", None)], "first_name string, last_name string")


def test_found_and_redacted(spark):
    lines = ["# Ada Byron\nada@mail.example | Tel. 671 555 0158\n\n- Ran 12 jobs (2019 - 2020)\n"] * 30
    rows = [("parsed", i, t) for i, t in enumerate(lines)] + [("parsed", 0, lines[0]), ("parsed", 97, None), ("parsed", 98, ""), ("parsed", None, lines[0]), ("redacted", 99, "word " * 60_000 + "\nada@mail.example\n")]
    texts = spark.createDataFrame(rows, "src string, id bigint, text string")
    held = texts.filter("id IS NOT NULL AND text <> ''")
    found = [tuple(r) for r in P.personal_data(held, people(spark)).collect()]
    assert len(found) == len(set(found)) == 91
    assert {r[2:] for r in found if r[1] == 3} == {("name", "adabyron"), ("email", "adamailexample"), ("phone", "6715550158")} and ("redacted", 99, "email", "adamailexample") in found
    done = {(r.src, r.id): r for r in P.redact(texts, people(spark)).collect()}
    assert done["parsed", 3].text == "# [NAME]\n[EMAIL] | Tel. [PHONE]\n\n- Ran 12 jobs (2019 - 2020)\n" and done["parsed", 3].kinds == {"name": 1, "email": 1, "phone": 1}
    assert done["parsed", 97].text is None and done["parsed", 98].text == "" and done["parsed", 98].kinds == {}


RARE = [("Xaviera", "Zubrowska"), ("Ödön", "Quartey"), ("Ilse", "Vantongeren"), ("Yoko", "Abiodun")]


@pytest.mark.parametrize("held", [100_000, 1, 2])
def test_every_name_counts(spark, monkeypatch, held):
    """Names of one record each are known, and so are those beyond what a task holds."""
    monkeypatch.setattr(P, "GAZETTEER", held)
    records = people(spark).unionByName(spark.createDataFrame(RARE, "first_name string, last_name string"))
    rows = [("parsed", i, f"# {a.upper() if i % 2 else a} {b}\nx@mail.example\n") for i, (a, b) in enumerate([("Ada", "Byron")] * 20 + RARE)] + [("parsed", 0, "# I L S E   V A N T O N G E R E N\nx@mail.example\n")]
    texts = spark.createDataFrame([*rows, ("redacted", None, "# Xaviera Zubrowska\n")], "src string, id bigint, text string")
    found = {(r.id, r.value) for r in P.personal_data(texts.filter("id IS NOT NULL"), records).collect() if r.kind == "name"}
    assert found == {(i, P.plain(a + b)) for i, (a, b) in enumerate([("Ada", "Byron")] * 20 + RARE)} | {(0, "ilsevantongeren")}
    done = P.redact(texts, records).collect()
    assert len(done) == len(rows) + 1 and all(r.text.startswith("# [NAME]\n") for r in done)


def test_empty(spark):
    texts = spark.createDataFrame([], "src string, id bigint, text string")
    assert P.personal_data(texts, people(spark)).count() == 0


@pytest.mark.parametrize("vote", [(1, 0, 2, 1, 0), (0, 0, 0, 0, 0), (2, 2, 2, 2, 2)])
def test_packing(vote):
    assert P.unpacked(P.packed(vote)) == vote
