"""Files masked end to end, and segments as files of any kind give them."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import segments
from cloakwork.operators.recognizers import Config
from cloakwork.sources import office, pipeline
from cloakwork.sources.files import read_files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:wp="urn:wp" xmlns:mc="urn:mc" mc:Ignorable="w14"'
CARD = "4242 4242 4242 4242"


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(body: str, **parts: str) -> bytes:
    return package({"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"} | {k.replace("__", "/"): v for k, v in parts.items()})


def run(text: str) -> str:
    return f"<w:r><w:t>{text}</w:t></w:r>"


def parts_of(data: bytes) -> dict[str, str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n: z.read(n).decode() for n in z.namelist()}


def test_split_and_pack():
    for text in ("", "short", "a" * 25, "aa bb cc dd ee ff", "line\nline line\n" * 5):
        pieces = segments.split_long(text, 10)
        assert "".join(t for _, t in pieces) == text and all(len(t) <= 10 for _, t in pieces)
        assert all(text[a : a + len(t)] == t for a, t in pieces)
    assert [t for _, t in segments.split_long("aa bb cc dd", 6)] == ["aa bb ", "cc dd"]
    rng = random.Random(1)
    found = [{"text": rng.choice(["", " ", "word " * rng.randint(1, 9), "x" * 40]), "context": rng.choice(["", "Phone: "])} for _ in range(60)]
    seen = {}
    for text, pieces in segments.packed(found, 30):
        assert len(text) <= 30 + len("Phone: ")
        for i, offset, start, size, head in pieces:
            assert text[start : start + size] == (found[i]["context"] if head else "") + found[i]["text"][offset : offset + size - head]
            seen[i] = seen.get(i, "") + text[start + head : start + size]
    assert seen == {i: s["text"] for i, s in enumerate(found) if s["text"].strip()}


def test_edits_on_runs_like_a_splice():
    rng = random.Random(2)
    for _ in range(300):
        runs = ["".join(rng.choices("abc", k=rng.randint(0, 5))) for _ in range(rng.randint(1, 6))]
        n, edits, at = len("".join(runs)), [], 0
        while at < n and rng.random() < 0.7:
            a = rng.randint(at, n - 1)
            b = rng.randint(a + 1, n)
            edits.append((a, b, rng.choice(["", "X", "YZ"])))
            at = b
        whole, want, last = "".join(runs), "", 0
        for a, b, r in edits:
            want, last = want + whole[last:a] + r, b
        assert "".join(office.runs_with_edits(runs, edits)) == want + whole[last:]


@pytest.mark.parametrize("text", ['a,"b, ""c""\n d",e\r\nf,,g', "", ",", '"open, no end\n', "a\rb", 'x"y,z'])
def test_cells_join_to_the_text(text):
    tokens = office.cells_of(text, ",")
    assert "".join(t for _, t in tokens) == text
    assert [t for is_cell, t in tokens if is_cell] == re.split(r",|\r\n|\r|\n", text) or '"' in text


def test_contexts_and_spans_over_two_cells(spark):
    files = spark.createDataFrame(
        [("f", "c", [("0", "Name", ""), ("1", "4242 4242", ""), ("2", "4242 4242", ""), ("3", "(415) 555-2671", "Phone: "), ("4", "(415) 555-2672", "")])], f"path string, conv string, segments {segments.SEGMENTS}"
    )
    edits, vault = segments.segment_edits(files, "path", "conv", b"k", now=F.lit(1000).cast("long"))
    r = files.join(edits.withColumnRenamed("key", "path"), "path").select(segments.applied(F.col("segments"), F.col("edits")).alias("t"), "blocked").first()
    assert r.t[:3] == ["Name", "[REDACTED:CREDIT_CARD]", "[REDACTED:CREDIT_CARD]"] and r.t[3].startswith("+1 555 ") and r.t[4] == "(415) 555-2672" and not r.blocked
    assert [v.real for v in vault.collect()] == ["(415) 555-2671"]


def test_masked_files(spark, tmp_path):
    table = "<w:tbl><w:tr><w:tc><w:p>{}</w:p></w:tc><w:tc><w:p>{}</w:p></w:tc></w:tr><w:tr><w:tc><w:p>{}</w:p></w:tc><w:tc><w:p>{}</w:p></w:tc></w:tr></w:tbl>".format(*map(run, ("Who", "Phone", "Ann", "(415) 555-2671")))
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Phone</t></is></c></row><row r="2"><c r="A2" s="3"><v>4242424242424242</v></c><c r="B2" t="s"><v>1</v></c><c r="C2"><v>1.5</v></c></row></sheetData><hyperlinks><hyperlink ref="A1" display="mail a@example.org"/></hyperlinks><oddHeader>&amp;LTo b@example.org&amp;RPage</oddHeader></worksheet>'
    strings = "<sst><si><t>Card</t></si><si><r><t>(415) </t></r><r><t>555-2671</t></r></si></sst>"
    book = lambda name, **more: package({"xl/workbook.xml": f'<workbook><sheets><sheet name="{name}" r:id="r1"/></sheets></workbook>', "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": strings, "xl/comments1.xml": '<comments><authors><author>Ann</author></authors><commentList><comment ref="A1" authorId="0"><text><r><t>ask c@example.org</t></r></text></comment></commentList></comments>'} | more)
    link = '<Relationships><Relationship Id="r9" Type="http://x/hyperlink" Target="mailto:d@example.org" TargetMode="External"/><Relationship Id="r2" Type="p" Target="people.xml"/></Relationships>'
    inputs = {
        "a.txt": f"pay {CARD} now, write to ann@example.org".encode("utf-16"), "b.csv": f'Name,Card\r\n"Ann, B",{CARD}\r\n'.encode("cp1252"), "c.txt": "caf\xe9 ann@example.org".encode("latin-1"), "d.png": b"\x89PNG\r\n\x1a\nxx", "e.bin": b"a\0b", "f.pdf": b"%PDF-1.7",
        "g.docx": docx(
            f'<w:p>{run("pay 4242 4242")}<w:r><w:br/></w:r>{run("4242 4242 and 4242424242424242 &amp; co")}</w:p><w:p><w:r><w:t>to ann@</w:t></w:r><w:r><w:t xml:space="preserve">example.org </w:t></w:r></w:p>{table}<w:p><wp:docPr descr="of e@example.org" name="pic"/></w:p><w:ins w:author="Ann" w:initials="A">{run("ok")}</w:ins>',
            word___rels__document_xml="x", **{"word/_rels/document.xml.rels": link, "word/people.xml": "<p/>", "docProps/core.xml": "<c><dc:creator>Ann</dc:creator></c>", "docProps/app.xml": "<a>Acme</a>"},
        ),
        "h.docx": docx(f"<w:p>{run('text')}</w:p>", **{"word/comments.xml": "<w:t>secret</w:t>"}), "i.docx": b"PK\x03\x04 word/document.xml broken", "j.xlsx": book("Sheet"), "k.xlsx": book("ann@example.org"), "m.txt": b"\xff\xfe\xfa",
    }
    for name, data in inputs.items():
        (tmp_path / name).write_bytes(data)
    files = read_files(spark, str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content", F.lit("c").alias("conv"))
    done, vault = pipeline.masked_files(files, "conv", b"k", now=F.lit(1000).cast("long"))
    got = {r.path: r for r in done.collect()}
    fake = {(v.label, v.real): v.fake for v in vault.collect()}
    mail, phone = fake["EMAIL", "ann@example.org"], fake["PHONE_NUMBER", "(415) 555-2671"]
    assert {k: r.status for k, r in got.items()} == {
        "a.txt": "masked", "b.csv": "masked", "c.txt": "masked", "d.png": "blocked: image", "e.bin": "blocked: unknown", "f.pdf": "blocked: pdf", "g.docx": "masked", "h.docx": "blocked: uninspected content",
        "i.docx": "blocked: parse failed: BadZipFile", "j.xlsx": "masked", "k.xlsx": "blocked: uninspected content", "m.txt": "blocked: parse failed: UnicodeDecodeError",
    }
    assert all((r.output is not None) == (r.status == "masked") for r in got.values())
    assert got["a.txt"].output.decode("utf-16") == f"pay [REDACTED:CREDIT_CARD] now, write to {mail}" and got["a.txt"].replacements == 2
    assert got["b.csv"].output == b'Name,Card\r\n"Ann, B",[REDACTED:CREDIT_CARD]\r\n'
    assert got["c.txt"].output.decode("cp1252") == "café " + mail
    word = parts_of(got["g.docx"].output)
    assert "> and [REDACTED:CREDIT_CARD] &amp; co<" in word["word/document.xml"] and ">pay [REDACTED:CREDIT_CARD]<" in word["word/document.xml"] and "w:br" not in word["word/document.xml"] and f">to {mail}<" in word["word/document.xml"] and phone in word["word/document.xml"] and "e@example.org" not in word["word/document.xml"]
    assert 'w:author="user"' in word["word/document.xml"] and "w:initials" not in word["word/document.xml"] and "mc:Ignorable" in word["word/document.xml"]
    assert "d@example.org" not in word["word/_rels/document.xml.rels"] and "people.xml" not in word["word/_rels/document.xml.rels"] and "word/people.xml" not in word
    assert "Ann" not in word["docProps/core.xml"] and "Acme" not in word["docProps/app.xml"]
    cells = {f[0].split(":")[-1]: office.text_of(f) for f in office.package_segments(got["j.xlsx"].output) if f[0].startswith("c:")}
    assert cells == {"A1": "Card", "B1": "Phone", "A2": "[REDACTED:CREDIT_CARD]", "B2": phone, "C2": "1.5"}
    excel = parts_of(got["j.xlsx"].output)
    assert not re.search(r"[abc]@example\.org", "".join(v for k, v in excel.items() if "shared" not in k)) and "<author>user</author>" in excel["xl/comments1.xml"] and 's="3"' in excel["xl/worksheets/sheet1.xml"]
    assert got["k.xlsx"].blockers == ["sheet_name_contains_sensitive_data"] and got["h.docx"].blockers == ["COMMENTS"] and "reviewer_list_removed" in got["g.docx"].warnings


def test_policy_blocks_a_file(spark):
    from cloakwork.operators.policy import Policy

    files = spark.createDataFrame([("a.txt", b"to ann@example.org", "c"), ("b.txt", b"nothing here", "c")], "path string, content binary, conv string")
    done, vault = pipeline.masked_files(files, "conv", b"k", Policy().override({"EMAIL": "BLOCK"}), Config(enabled_labels=frozenset({"EMAIL"})))
    assert {r.path: (r.status, r.output) for r in done.collect()} == {"a.txt": ("blocked: policy", None), "b.txt": ("masked", bytearray(b"nothing here"))} and vault.count() == 0
    strict, _ = pipeline.masked_files(files, "conv", b"k", config=Config(enabled_labels=frozenset({"EMAIL"})), strict=True, degraded=F.col("path") == "b.txt")
    assert {r.path: r.status for r in strict.collect()} == {"a.txt": "masked", "b.txt": "blocked: degraded"}


def test_packages_lose_what_names_people():
    parts = {
        "[Content_Types].xml": '<Types><Override PartName="/word/people.xml" ContentType="x"/><Override PartName="/word/document.xml" ContentType="y"/></Types>',
        "_rels/.rels": '<Relationships><Relationship Id="a" Target="docProps/thumbnail.jpeg"/><Relationship Id="b" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": '<Relationships><Relationship Id="a" Target="people.xml"/><Relationship Id="b" Target="/word/people.xml"/><Relationship Id="c" Target="people.xml" TargetMode="External"/></Relationships>',
        "word/document.xml": '<w:document><w:ins w:author="Ann" w:initials="A">text</w:ins></w:document>', "word/people.xml": "<p>Ann</p>", "docProps/thumbnail.jpeg": "jpeg",
        "docProps/core.xml": "<c><dc:creator x='1'>Ann</dc:creator><dc:title>T</dc:title><cp:revision>2</cp:revision></c>", "docProps/app.xml": "<Company>Ann Ltd</Company>", "xl/comments1.xml": "<author>Ann</author><t>note</t>",
    }
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    new, notes = office.scrubbed(data.getvalue())
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        got = {n: z.read(n).decode() for n in z.namelist()}
    assert notes == ["app_properties_removed", "review_author_names_removed", "reviewer_list_removed", "thumbnail_removed"]
    assert set(parts) - set(got) == {"word/people.xml", "docProps/thumbnail.jpeg"} and not any("Ann" in body for body in got.values())
    assert got["[Content_Types].xml"] == '<Types><Override PartName="/word/document.xml" ContentType="y"/></Types>'
    assert got["_rels/.rels"] == '<Relationships><Relationship Id="b" Target="word/document.xml"/></Relationships>'
    assert got["word/_rels/document.xml.rels"] == '<Relationships><Relationship Id="c" Target="people.xml" TargetMode="External"/></Relationships>'
    assert got["docProps/core.xml"] == "<c><dc:creator></dc:creator><dc:title></dc:title><cp:revision>2</cp:revision></c>" and "<t>note</t>" in got["xl/comments1.xml"]
