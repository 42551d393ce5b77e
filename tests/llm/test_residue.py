import pytest

from poolcraft.llm import residue as R

BAD = [
    "502 Bad Gateway\nThe upstream c65a7a09 did not answer.", "<html><body>cv_360410.pdf: 410 Gone</body></html>", "Der angeforderte Inhalt cv_447683.pdf ist nicht verfügbar.", "La página solicitada cv_36.pdf no existe.",
    "Please enable JavaScript to view this document.\nRequest f5fde405", "Oops! That page can't be found.", "We're sorry but cvapp doesn't work properly without JavaScript enabled. Please enable it to continue.", "Bitte schalten Sie JavaScript ein.",
    "Hmm. We’re having trouble finding that site.\nWe can't connect to the server at www.x.com.", "404\nNot Found\nnginx/1.18.0", "This site can’t be reached\nwww.foo.com took too long to respond.", "La page demandée n'existe plus.", "Se ha producido un error. Inténtelo de nuevo más tarde.",
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.", "bla bla bla bla", "foo bar baz foo bar baz", "# Ada Byron\nYour session has expired. Please sign in again to download cv_1.pdf.\n- Built pipes for a bank.",
    "[ insert name of university college school company employer organisation position title ]", "# Ada\n- Built pipes.\n- <insert achievement here>", "# [Your Name]", "- %JOB_TITLE%", "- {{ Degree }}", "#ADD_METRIC#", "((YOUR CITY))",
    "(nombre – fill in)", "«Nachname», «Vorname»", "- Improved efficiency by XX%", "Saved nn% on [project name]", "- Text text text text text text.", "- asdf asdf jkl asdf qwer", "Dolorem magnat alique, enima venit quisque nostro ullam.",
    "### Engineer, Acme (2019 - 2020) {{COMPANY}}", "- Built a thing for a bank. <<EMPLOYER>>", "word " * 40_000 + "\nLorem ipsum dolor, consecta tur adipis elitro.\n", "Company Name Here | City, State", "{% block contact %}{% endblock %}", "@@JOB_TITLE@@", "[[ add dates ]]",
]
GOOD = [
    None, "", "   ", "- Added retry rules for 502 Bad Gateway answers of 75 partners.", "- Reduced 404 Not Found responses by 89% after repairing stale links.", "- Injected <DB_NAME> and <REGION> settings into 65 deployment files.",
    "- Wrote mail templates with {{ user.id }} variables for 47 campaigns.", "- Rendered ${order.total} fields in the invoice editor for 32 shops.", "- Parsed [Tracking Number] and [IP Address] columns from 71 carrier files.",
    "- Made the portal usable with JavaScript disabled, tested on 40 browsers.", "saved 100% of the audit effort", "array[0] and items[i]", "Reduced waiting from two hours to under thirty\nseconds.", "We found the claim was\ndenied.", "Worked in retail.\nNot found", "Skills: SQL | Enable JavaScript", "- Page not found handler for 3 shops", "Fixed 404 not found errors on the site.",
    "Cut the time that pages were\ntemporarily unavailable", "Wrote about access denied messages. Engineer with 10 years of experience in banks.", "Led the service desk\nService unavailable tickets down by 30%", "your-team handbook (internal wiki)", "templating with {{ .Values.image }} in charts", "# T O M A S   Q U I G S T A D",
    "- Cleared session-expired complaints, 87 a week before the fix.", "batch insert operations of 40k rows", "<ada@mail.example>",
]


@pytest.mark.parametrize("text", BAD, ids=lambda t: t[:30])
def test_bad(text):
    assert R.is_residue(text)


@pytest.mark.parametrize("text", GOOD, ids=lambda t: str(t)[:30])
def test_good(text):
    assert not R.is_residue(text)


def test_records(spark):
    parsed = spark.createDataFrame([(1, "502 Bad Gateway"), (1, "502 Bad Gateway"), (2, None), (3, ""), (None, "502 Bad Gateway"), (4, "fine")], "id bigint, markdown string").selectExpr("*", "1 AS text", "'x' AS src")
    schema = "candidate_id bigint, placeholders array<struct<kind:string,match:string>>"
    checks = spark.createDataFrame([(1, [(None, "[Your Name]"), ("x", None)]), (5, None), (6, []), (7, [("x", "")]), (8, [("x", "array[0]")]), (None, [("x", "[Your Name]")])], schema)
    assert sorted(map(tuple, R.residue_records(parsed, checks).collect())) == [("parsed", 1), ("prechecks", 1)]
    assert R.residue_records(parsed.limit(0), checks.limit(0)).count() == 0
