import hashlib
import io
import json
import threading
import zipfile
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from poolcraft.plans import screening
from poolcraft.sources import files, pdf, rest
from poolcraft.streaming import runs


def docx(*paragraphs: str) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_folder(spark, tmp_path):
    (tmp_path / "ada.docx").write_bytes(docx("Ada built pipes for many years in several places", "- one"))
    (tmp_path / "bob.DOCX").write_bytes(b"broken")
    (tmp_path / "cy.pdf").write_bytes(b"%PDF")
    (tmp_path / "cy.docx").write_bytes(docx("other"))
    (tmp_path / "note.txt").write_text("no")
    found = files.documents(spark, str(tmp_path))
    rows = {r.name: r for r in found.collect()}
    assert set(rows) == {"ada", "bob", "cy"} and rows["cy"].ext == "pdf"
    assert rows["ada"].id == int(hashlib.sha256(b"ada").hexdigest()[:8], 16) % 900_000_000 + 1_000_000
    parsed = {r.id: r for r in files.parsed(found, min_chars=10).collect()}
    assert parsed[rows["ada"].id].markdown.endswith("\n- one") and parsed[rows["bob"].id].problem == "unparseable" and parsed[rows["cy"].id].problem == "unparseable" and parsed[rows["ada"].id].hidden_text.spans == []
    other = found.withColumn("ext", F.lit("odt"))
    assert {r.problem for r in files.parsed(other).collect()} == {"unsupported_format"} and {r.markdown for r in files.parsed(other, {"odt": lambda b: "x" * 300}).collect()} == {"x" * 300}


def make_pdf(content: bytes, flate: bool = True, info: str = "/Producer (TestSuite) /CreationDate (D:20260102030405Z)", font: str = "/Type /Font /Subtype /Type1 /BaseFont /Helvetica", more: tuple[bytes, ...] = ()) -> bytes:
    body = zlib.compress(content) if flate else content
    streams = f"<< /Length {len(body)} {'/Filter /FlateDecode' if flate else ''} >>".encode() + b"\nstream\n" + body + b"\nendstream"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> /XObject << /X 7 0 R >> >> >>", b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>", streams, f"<< {font} >>".encode(), f"<< {info} >>".encode(), *more]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"trailer << /Root 1 0 R /Info 6 0 R >>\n%%EOF"


PAGE = rb"""BT /F1 20 Tf 50 700 Td (Ada Byron) Tj ET
BT /F1 10 Tf 12 TL 50 650 Td (Built \(many\) pipes for a bank, and caf\351s) Tj T* [(W) 20 (orked) -300 (daily)] TJ (next line) ' ET
q 1 1 1 rg BT /F1 10 Tf 50 500 Td (hidden words of a white run of terms) Tj ET Q
BT /F1 2 Tf 50 480 Td (tiny words that nobody will ever read) Tj ET
BT /F1 10 Tf 3 Tr 50 460 Td (invisible words drawn in mode three here) Tj 0 Tr ET
BT 0 0 0 1 k /F1 10 Tf 50 440 Td <e280a2> Tj ET /X Do"""


def test_pdf(spark, tmp_path):
    form = b"<< /Type /XObject /Subtype /Form /Length 44 >>\nstream\nBT /F1 10 Tf 50 100 Td (from a form) Tj ET\nendstream"
    (tmp_path / "ada.pdf").write_bytes(make_pdf(PAGE, more=(form,)))
    (tmp_path / "plain.PDF").write_bytes(make_pdf(b"BT /F1 10 Tf 1 0 0 1 9 9 Tm (Hello there) Tj ET", flate=False))
    (tmp_path / "scan.pdf").write_bytes(make_pdf(b"q 100 0 0 100 0 0 cm /Im Do Q"))
    (tmp_path / "broken.pdf").write_bytes(make_pdf(PAGE)[:180])
    (tmp_path / "none.pdf").write_bytes(b"no pdf at all")
    found = files.documents(spark, str(tmp_path))
    name = {r.id: r.name for r in found.collect()}
    rows = {name[r.id]: r for r in files.parsed(found, min_chars=5).collect()}
    ada = rows["ada"]
    assert ada.markdown.startswith("## Ada Byron\nBuilt (many) pipes for a bank, and cafés\nWorked daily\nnext line\n") and ada.markdown.endswith("from a form")
    assert (ada.meta.producer, ada.meta.created, ada.pages, ada.problem) == ("TestSuite", "D:20260102030405Z", 1, None)
    assert ada.hidden_text.found and [(s.kind, s.substantive) for s in ada.hidden_text.spans] == [("white_on_white", True), ("micro_font", True), ("invisible_render_mode", True)]
    assert rows["plain"].markdown == "Hello there" and not rows["plain"].hidden_text.found
    assert [rows[n].problem for n in ("scan", "broken", "none")] == ["unparseable"] * 3


def test_pdf_with_a_map_of_characters():
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0024> <0026> <0041> <0044> <0045> [<00e9> <0066006c>] endbfrange"
    data = make_pdf(b"BT /F1 10 Tf 5 5 Td <002400030025004400450026> Tj ET", font="/Type /Font /Subtype /Type0 /ToUnicode 7 0 R", more=(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap),))
    assert pdf.read(data)["markdown"] == "A BéflC"


def test_pdf_with_object_streams():
    inner = b"1 0 2 36 3 115 << /Type /Catalog /Pages 2 0 R >>    << /Type /Pages /Kids [3 0 R] /Resources << /Font << /F1 5 0 R >> >> >>          << /Type /Page /Contents 4 0 R >>"
    head = inner[: inner.index(b"<<")]
    body = zlib.compress(inner)
    offsets = [inner.index(x) - len(head) for x in (b"<< /Type /Catalog", b"<< /Type /Pages", b"<< /Type /Page /")]
    head2 = b"1 %d 2 %d 3 %d " % tuple(offsets)
    body = zlib.compress(head2 + inner[len(head) :])
    page = b"BT /F1 9 Tf 1 1 Td (packed objects) Tj ET"
    data = b"%%PDF-1.5\n4 0 obj << /Length %d >>\nstream\n%s\nendstream endobj\n9 0 obj << /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream endobj\n10 0 obj << /Type /XRef /Root 1 0 R /Length 0 >>\nstream\n\nendstream endobj" % (len(page), page, len(head2), len(body), body)
    assert pdf.read(data)["markdown"] == "packed objects"


def test_csv_and_snapshots(spark, tmp_path):
    (tmp_path / "side.csv").write_text("Name,Email\n Ada ,a@x\nada,b@x\n,c@x\n")
    assert [(r.key, r.Email) for r in files.side_input(spark, str(tmp_path / "side.csv")).collect()] == [("ada", "b@x")]
    root = str(tmp_path / "snap")
    files.write_snapshot(spark.range(3), root, "1")
    assert files.read_snapshot(spark, root, "id bigint", "1").count() == 3 and files.read_snapshot(spark, root + "none", "id bigint", "2").count() == 0
    with pytest.raises(FileNotFoundError, match="version 2"):
        files.read_snapshot(spark, root, "id bigint", "2")
    with pytest.raises(Exception, match="unknown status lost of id 7"):
        runs.checked(spark.createDataFrame([(7, "lost")], "id bigint, status string")).collect()


def test_throttle_and_retry():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    throttle = rest.Throttle(2, 10, lambda: now[0], sleep)
    for _ in range(3):
        throttle.wait()
    assert slept == [10]
    replies = iter([(429, {"Retry-After": "3"}, b""), (500, {}, b""), (200, {}, b'{"ok": 1}')])
    assert rest.get("u", {}, rest.Throttle(9, 1, lambda: now[0], sleep), lambda *_: next(replies)) == {"ok": 1} and slept[1:] == [3, 2]
    with pytest.raises(PermissionError):
        rest.get("u", {}, rest.Throttle(9, 1, lambda: now[0], sleep), lambda *_: (401, {}, b""))


def test_pause():
    assert rest.pause("2.5", 0) == 2.5 and rest.pause(None, 3) == 8 and rest.pause("soon", 1) == 2
    assert rest.pause("Wed, 21 Oct 2026 07:28:00 GMT", 0, lambda: 1792567680.0 - 30) == pytest.approx(30, abs=1)


def test_fetch_and_save(spark, tmp_path):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status = {"/gone": 404, "/wall": 999}.get(self.path, 200)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(self.path.encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = spark.createDataFrame([(1, f"{base}/a.pdf"), (2, f"{base}/gone"), (3, f"{base}/wall"), (4, None), (5, " "), (6, "http://127.0.0.1:9/x"), (7, "no url")], "id bigint, url string")
    found = rest.fetched(rows, "url", readers=2, window=1.0).withColumn("live", rest.liveness(F.col("status"))).cache()
    got = {r.id: (r.status, r.live) for r in found.collect()}
    assert got == {1: (200, "live"), 2: (404, "unknown"), 3: (999, "unknown"), **{i: (None, "unknown") for i in (4, 5, 6, 7)}}
    folder = str(tmp_path / "files")
    kept = rest.saved(found.filter("status = 200").withColumn("name", F.lit("../a.pdf")), folder).collect()
    assert [tuple(r)[1:] for r in kept] == [(f"{folder}/a.pdf", 6)] and (tmp_path / "files" / "a.pdf").read_bytes() == b"/a.pdf" and len(list((tmp_path / "files").iterdir())) == 1
    server.shutdown()
    with pytest.raises(ValueError):
        rest.fetched(rows, "url", most=1, readers=2)


def test_role_and_waiting_work(spark, tmp_path):
    from poolcraft.plans.role import Role, waiting

    good = {"title": "Engineer", "version": 3, "criteria": {"depth": 60, "breadth": 40}, "fraction": 0.2, "preferred": ["ET"]}
    (tmp_path / "role.json").write_text(json.dumps(good))
    role = Role.read(tmp_path / "role.json")
    assert role == Role.read(good) and role.order(tie="zone").preferred == ("ET",)
    for change in ({"criteria": {"depth": 60}}, {"criteria": {}}, {"fraction": 0}, {"fraction": 1.5}, {"window": -1}, {"colour": 1}):
        with pytest.raises(ValueError):
            Role.read({**good, **change})
    with pytest.raises(ValueError, match="title"):
        Role.read({k: v for k, v in good.items() if k != "title"})
    (tmp_path / "twice.json").write_text('{"title": "x", "title": "y"}')
    with pytest.raises(ValueError, match="twice"):
        Role.read(tmp_path / "twice.json")
    texts = spark.createDataFrame([(1, "one {title}"), (2, "two"), (3, None), (2, "two")], "id bigint, text string").withColumn("digest", F.lit("clash"))
    first = waiting(texts, spark.createDataFrame([], "id bigint, digest string"), role, "For {title}:\n{criteria}\n---\n{text}\n---")
    rows = {r.id: r for r in first.collect()}
    assert set(rows) == {1, 2} and rows[1].prompt == "For Engineer:\n- breadth (0 to 40)\n- depth (0 to 60)\n---\none {title}\n---"
    assert {r.id for r in waiting(texts, first.filter("id = 1"), role, "{text}").collect()} == {2}
    assert {r.id for r in waiting(texts, first, Role.read({**good, "version": 4}), "{text}").collect()} == {1, 2}


def test_paged_rest(spark):
    rows = [{"id": i, "opening_id": "7" if i != 3 else "8"} for i in range(7)]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            at, n = int(q["offset"][0]), int(q["limit"][0])
            body = json.dumps({"meta": {"total": len(rows)}, "objects": rows[at : at + n]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rest.register(spark)
    df = spark.read.format("paged_rest").option("url", f"http://127.0.0.1:{server.server_port}/list").option("limit", "3").option("param_opening_id", "7").option("scope", "opening_id").load()
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 4, 5, 6]
    server.shutdown()


def test_stream(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    schema = "id bigint, status string, value double, seq bigint"

    def arrive(name, rows):
        (source / name).write_text("\n".join(json.dumps(dict(zip(("id", "status", "value", "seq"), r))) for r in rows))
        stream = spark.readStream.schema(schema).json(str(source))
        runs.merge_stream(stream, root, str(tmp_path / "checkpoint")).awaitTermination()

    arrive("1.json", [(1, "accepted", 9.0, 1), (2, "waitlist", 5.0, 1), (2, "waitlist", 6.0, 2)])
    arrive("2.json", [(1, "waitlist", 1.0, 3), (3, "gated", 2.0, 3)])
    got = {r.id: (r.status, r.value) for r in runs.latest_state(spark, root, 1).collect()}
    assert got == {1: ("accepted", 9.0), 2: ("waitlist", 6.0), 3: ("gated", 2.0)}


def test_screen_folder(spark, tmp_path):
    long = "Built pipes for a bank. " * 5
    for name in ("ada", "bob", "cyd", "dee"):
        (tmp_path / f"{name}.docx").write_bytes(docx(long + name, "- Insert [your city] here" if name == "dee" else "- Ran the team of pipe builders"))
    ids = {r.name: r.id for r in files.documents(spark, str(tmp_path)).collect()}
    raw = '{"redflag":{"flags":[]},"fit":{"scores":{"a":{"score":%d,"quote":"built pipes"}},"bonus":{"points":0}}}'
    verdicts = spark.createDataFrame([(ids["ada"], raw % 9), (ids["bob"], raw % 5), (ids["dee"], raw % 10)], "id bigint, raw string")
    rows = {r.id: (r.status, r.problem) for r in screening.screen_folder(spark, str(tmp_path), verdicts, {"a": 10.0}, 0.3, 2026 * 12 + 7).collect()}
    assert rows == {ids["ada"]: ("seated", None), ids["bob"]: ("no_slot", None), ids["cyd"]: ("needs_review", "no verdict"), ids["dee"]: ("barred", "placeholders")}


def test_screen_folder_redacts_own_name_and_contact(spark, tmp_path):
    body = "Built pipes for a bank with Ada Byron. " * 3 + "Write to ada at home or dial 12-34-5."
    (tmp_path / "Ada Byron.docx").write_bytes(docx("Ada Byron", body))
    (tmp_path / "Bob.docx").write_bytes(docx("Built pipes for a bank. " * 5))
    (tmp_path / "side.csv").write_text("Name,Email,Phone\n ada byron ,ada at home,12-34-5\n")
    ids = {r.name: r.id for r in files.documents(spark, str(tmp_path)).collect()}
    people = {r.id: tuple(r)[1:] for r in screening.people_of(files.documents(spark, str(tmp_path)), files.side_input(spark, str(tmp_path / "side.csv"))).collect()}
    assert people == {ids["Ada Byron"]: ("Ada", "Byron", "ada at home", "12-34-5"), ids["Bob"]: ("Bob", "", None, None)}
    # Quotes are checked against the redacted text: one with the name, the e-mail or the phone isn't there any more.
    raw = '{"redflag":{"flags":[]},"fit":{"scores":{"a":{"score":9,"quote":"built pipes"},"b":{"score":9,"quote":"%s"}},"bonus":{"points":0}}}'
    for quote, final in (("for a bank", 18.0), ("with Ada Byron", 9.0), ("ada at home", 9.0), ("12-34-5", 9.0)):
        verdicts = spark.createDataFrame([(ids["Ada Byron"], raw % quote)], "id bigint, raw string")
        rows = screening.screen_folder(spark, str(tmp_path), verdicts, {"a": 10.0, "b": 10.0}, 0.5, 2026 * 12 + 7, str(tmp_path / "side.csv")).collect()
        assert {r.id: r.final for r in rows}[ids["Ada Byron"]] == final


def test_sinks(spark, tmp_path):
    from pyspark.sql import functions as F

    from poolcraft.operators import ranking
    from poolcraft.sources import sinks

    df = spark.createDataFrame([(i, "a" if i < 3 else "b<", i / 2) for i in range(5)], "id bigint, status string, final double")
    assert open(sinks.to_csv(df, str(tmp_path / "x.csv"), ["id"])).read().splitlines()[:2] == ["id,status,final", "0,a,0.0"]
    top = ranking.first_of_each(df, "status", [F.col("final").desc()], 2).select("status", "k", "id", "final", "more")
    text = open(sinks.to_markdown(top, str(tmp_path / "x.md"), "status", "Pool")).read()
    assert "## a\n\n1. id 2, final 1\n2. id 1, final 0.5\n… and 1 more" in text and text.endswith("2. id 3, final 1.5\n")
    assert "<td>b&lt;</td>" in open(sinks.to_html(df, str(tmp_path / "x.html"), ["id"], "Pool")).read()
    assert json.load(open(sinks.to_json({"cap": 3}, str(tmp_path / "x.json")))) == {"cap": 3}
    marks = spark.createDataFrame([([("no link", 20), ("gap", 5)],)], "p array<struct<kind:string,points:int>>")
    assert marks.select(sinks.deductions(F.col("p"))).first()[0] == "no link(-20);gap(-5)"


def test_page(spark, tmp_path):
    from poolcraft.sources import sinks

    schema = "id bigint, name string, url string, scores map<string,double>, flags array<string>, quotes array<struct<kind:string,quote:string>>"
    rows = [(1, "<Ada>", "https://x.example/?a=1&b", {"depth": 30.0, "breadth": 0.0}, ["new", "a&b"], [("gap", "said <so>"), ("x", None)]), (2, "Bob", "javascript:alert(1)", None, [], None), (3, "Cy", None, {}, None, [])]
    df = spark.createDataFrame(rows, schema)
    links = {"name": "https://host.example/{id}/{name}", "url": "{url}"}
    text = open(sinks.to_page([sinks.Section("Seated & more", df, ("id",), links, {"depth": 60.0}, 2), sinks.Section("Empty", df.limit(0), ("id",))], str(tmp_path / "p.html"), "Pool <1>")).read()
    assert "<h1>Pool &lt;1&gt;</h1>" in text and "<h2>Seated &amp; more (3)</h2>" in text and "<p>and 1 more</p>" in text and "<h2>Empty (0)</h2>\n<p>none</p>" in text
    assert 'href="https://host.example/1/%3CAda%3E">&lt;Ada&gt;</a>' in text and 'href="https://x.example/?a=1&amp;b"' in text
    assert "href=\"javascript" not in text and "<td>javascript:alert(1)</td>" in text
    assert 'style="width:30px" title="depth: 30 of 60"' in text and 'class="bar none"' in text and '<span class="chip">a&amp;b</span>' in text
    assert "<details><summary>2</summary><blockquote>kind: gap<br>quote: said &lt;so&gt;</blockquote><blockquote>kind: x</blockquote></details>" in text and "Cy" not in text


def test_lookup_and_scope(spark):
    from poolcraft.operators import state

    rows = spark.createDataFrame([("u1",), ("u2",), (None,)], "url string")
    cache = spark.createDataFrame([("u1", "live"), ("u9", "live")], "url string, liveness string")
    assert {r.url: r.liveness for r in state.looked_up(rows, cache, "url", "liveness").collect()} == {"u1": "live", "u2": "unknown", None: "unknown"}
    kept, counts = state.in_scope(rows, "url", "u1")
    assert kept.count() == 1 and tuple(counts.first()) == (1, 2)
