import random

import numpy as np

from poolcraft.llm import subjects as S

WORDS = {
    "law": "court contract statute verdict lawyer appeal judge clause tribunal plaintiff".split(), "sport": "match goal league referee striker training stadium medal coach tackle".split(),
    "arts": "canvas stage violin gallery sculpture chorus sketch theatre poem ballet".split(),
}
PLAIN = ["I am calm and punctual.", "The post is full time.", "Thank you for reading this."]
FRAMES = ["I looked after the {} and the {} for years.", "Show us how you handled the {} and the {} before.", "We need someone for the {} and the {} soon."]


def text(rng, subject, n, plain=1):
    said = [rng.choice(FRAMES).format(*rng.sample(WORDS[subject], 2)) for _ in range(n)] + rng.sample(PLAIN, plain)
    rng.shuffle(said)
    return " ".join(said)


def test_subjects(spark):
    rng = random.Random(1)
    truth, rows, labels = {}, [], []
    for i in range(360):
        subject = rng.choice(list(WORDS))
        truth[i] = {subject}
        body = text(rng, subject, 4)
        if i % 6 == 0:
            other = rng.choice([s for s in WORDS if s != subject])
            body += " " + text(rng, other, 4)
            truth[i].add(other)
        rows.append((i, body))
        if i % 3 == 0:
            labels.append((i, rng.choice(list(WORDS)) if i % 30 == 0 else subject.upper()))
    passing = text(rng, "law", 8) + " I looked after the canvas and the violin for years."
    rows += [(900, None), (901, ""), (902, " ".join(PLAIN)), (903, passing), (904, text(rng, "sport", 400)), (0, rows[0][1])]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS subject")
    areas = spark.createDataFrame([("law", "courts and contracts"), ("sport", "training and clubs"), ("arts", "music, stage and film")], "subject string, description string")
    found = S.subjects_of_documents(documents, areas, spark.createDataFrame([*labels, (None, "law"), (1, None), (2, "cooking")], "doc_id bigint, subject string"))
    got = {}
    for r in found.collect():
        assert r.subject not in got.setdefault(r.doc_id, set())
        got[r.doc_id].add(r.subject)
    right = sum(got.get(i, set()) == truth[i] for i in truth)
    assert right / len(truth) > 0.95
    assert got[903] == {"law"} and got[904] == {"sport"} and not {900, 901, 902} & set(got)


def test_sentences():
    assert S.sentences("- Tutoring a trip, mentoring cover Explained quizzes at a school in Oldstead. The prÃ³ximo tunnel­ling") == [
        ["tutoring", "trip", "mentoring", "cover"], ["explained", "quizzes", "school", "oldstead"], ["the", "próximo", "tunnelling"]]


def test_reader_gives_the_codes_of_the_sentences():
    texts = ["Plain talk. More; and so on? Yes!  End", "- Tutoring a trip, mentoring cover Explained quizzes at a school", "A line\r\nanother… 'quoted.' don't stop-gap, x2y", "prÃ³ximo tunnel­ling. Ü - dash", "", "...  ; ."]
    read = S.Reader()
    for text in texts * 2:
        assert read(text) == [list(dict.fromkeys(map(S.code_of, words))) for words in S.sentences(text)]


def test_columns():
    codes = np.array([S.code_of(w) for w in ("a", "b", "c")], dtype=np.int32)
    place = S.Columns(codes)
    found = place(np.array([*codes, S.code_of("d")], dtype=np.int32))
    assert sorted(found[:3]) == [0, 1, 2] and 3 <= found[3] < place.count
    assert 0 <= S.Columns(codes[:0])(codes).min()


def test_rare_words_share_columns(spark, monkeypatch):
    """With hardly any columns for single words the labelled ones still tell."""
    monkeypatch.setattr(S, "VOCABULARY", 8)
    test_subjects(spark)


def test_mixtures_against_one_row_at_a_time():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 7, 0, 13, 40, 7, 3])
    p = rng.random((sizes.sum(), 4)).astype(np.float32)
    prior = rng.dirichlet(np.ones(4), len(sizes)).astype(np.float32)
    for drawn, more in ((None, 0.0), (prior, S.PRIOR)):
        held, part = S.mixtures(p, sizes, drawn, parts=True)
        at = 0
        for i, size in enumerate(sizes):
            block, at = p[at : at + size].astype(float), at + size
            base = np.full(4, 0.25) if drawn is None else drawn[i]
            w, share = base + 1e-3, np.zeros((0, 4))
            for _ in range(S.INNER if size else 0):
                share = w * block / (w * block).sum(1, keepdims=True)
                w = (share.sum(0) + more * base) / (size + more)
            assert np.allclose(held[i], share.sum(0), atol=1e-3) and np.allclose(part[at - size : at], share, atol=1e-3)


def test_chunks():
    sizes = np.array([5, 0, 40_000, 1, 2, 29_990, 20])
    runs = list(S._chunks(sizes))
    assert [i for a, b in runs for i in range(a, b)] == list(range(len(sizes)))
    assert all(sizes[a:b].sum() <= S.CHUNK or b == a + 1 for a, b in runs)


def test_empty(spark):
    documents = spark.createDataFrame([], "doc_id bigint, text string")
    areas = spark.createDataFrame([("law", "courts")], "subject string, description string")
    assert S.subjects_of_documents(documents, areas, spark.createDataFrame([], "doc_id bigint, subject string")).count() == 0
