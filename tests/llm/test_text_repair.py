import pytest

from driftnet.llm import emails, mojibake, residue, scans

GOOD = [
    "Übergabe für Käse, très élégant, niño pequeño", "Протокол и Договор", "źródło książka", "登山地図14.json", "ReçuÉgaré.docx", "SÃO Paulo", "Å-Zeichen", "ﬁne print", "║ box ║",
    "👩‍🔬 works", "a – b — c “quoted” ’s", "3 × 4 ≥ 12, 20 °C, 5 µm", "", "ascii",
]


@pytest.mark.parametrize("text", GOOD)
def test_right_texts_stay(text):
    assert mojibake.repair(text) == (text, "clean")


@pytest.mark.parametrize("text", ["déclaration d'impôts à côté", "Prüfungsgebühr Größe", "señal roja pequeña", "Учебник новый", "給湯器と水道計", "łódź gęś źródło", "It’s “fine” – 5 €"])
@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp437", "mac_roman"])
def test_utf8_round_trip(text, read):
    table = {v: k for k, v in mojibake._MAPS[read].items()}
    garbled = "".join(chr(b) if b < 128 else table[b] for b in text.encode())
    assert mojibake.repair(garbled) == (text, "restored")
    if read == "cp1252":
        twice = "".join(chr(b) if b < 128 else table[b] for b in garbled.encode())
        assert mojibake.repair(twice)[0] == text


@pytest.mark.parametrize(("text", "written", "read"), [("Протокол старый", "koi8_r", "cp1251"), ("Рецепт", "cp1251", "latin-1"), ("habitación pequeña", "cp1252", "cp850"), ("旅行日記", "cp932", "latin-1")])
def test_legacy_round_trip(text, written, read):
    assert mojibake.repair(text.encode(written).decode(read)) == (text, "restored")


def test_lost_and_tables(spark):
    rows = [(1, "caf�.txt", "/a/caf�.txt"), (2, "GÃ¼te.txt", "/Ã¼/GÃ¼te.txt"), (3, None, ""), (None, "Ã¼", "x"), (4, "gut.txt", "/ü/gut.txt")]
    df = spark.createDataFrame(rows, "id long, filename string, path string").withColumn("state", __import__("pyspark").sql.functions.lit(1))
    got = {(r["field_name"], r["record_key"]): (r["restored"], r["state"]) for r in mojibake.garbled(df, "id", {"filename": "text", "path": "path"}).collect()}
    assert got == {("filename", "1"): ("caf�.txt", "lost"), ("path", "1"): ("/a/caf�.txt", "lost"), ("filename", "2"): ("Güte.txt", "restored"), ("path", "2"): ("/ü/Güte.txt", "restored")}
    assert mojibake.garbled(df.limit(0), "id", {"path": "path"}).count() == 0


MAIL = """From: Ada Bell <ada@x.example>
To: Bo
Subject: Re: plan
Date: Mon, 1 Jan 2024 10:00:00 +0000

Hello Bo,

On 2024-01-01 09:00, Bo Carr wrote:
> The plan is ready and everybody has read it twice.
>
> Bo

I agree with the plan.

> 4 bar would be too much

-- and that is all I know

From: page 3 onward it is wrong.

Best regards,
Ada Bell
Treasurer | Works
Phone: +00 11 222

P.S. Bring the key.

Sent from my phone

________________________________
This message is confidential. Delete it.

-----Original Message-----
From: Bo Carr <bo@x.example>
Sent: 1 January 2024
To: Ada
Subject: plan

Old words.
"""


def test_mail_lines():
    marks = emails.classify(MAIL, emails.Closings())
    new = [x for x, m in zip(MAIL.split("\n"), marks, strict=True) if m == "N"]
    assert new == ["Hello Bo,", "I agree with the plan.", "> 4 bar would be too much", "-- and that is all I know", "From: page 3 onward it is wrong.", "P.S. Bring the key."]
    assert emails.classify("", emails.Closings()) == ["B"]
    assert "N" in emails.classify("only words\r\nof mine", emails.Closings())


MAILS_ELSEWHERE = [
    ("Od: Jan Lis <jan@x.example>\nDo: Ewa\nTemat: Odp: mur\n\nDzień dobry Ewo,\n\nMur ogrodu stoi już od maja.\n\nPozdrawiam,\nJan Lis\n\nEwa Kos napisała:\n> Czy mur już stoi?", ["Dzień dobry Ewo,", "Mur ogrodu stoi już od maja."]),
    ("От: Иван Лис <ivan@x.example>\nКому: Анна\nТема: стена\n\nЗдравствуйте, Анна!\n\nСтена стоит с мая.\n\nС приветом,\nИван\n\nАнна Кос пишет:\n> Стоит ли стена?", ["Здравствуйте, Анна!", "Стена стоит с мая."]),
]


@pytest.mark.parametrize(("text", "want"), MAILS_ELSEWHERE)
def test_mails_in_other_languages(text, want):
    marks = emails.classify(text, emails.Closings())
    assert [x for x, m in zip(text.split("\n"), marks, strict=True) if m == "N"] == want


def test_notice_without_rule_is_told_by_compression():
    notice = "this message and any files attached to it are confidential and meant only for the addressee named above."
    text = "From: A B <a@b.example>\nTo: C\nSubject: x\n\nHi,\n\nsome words of my own about the roof\n\n" + notice.capitalize() + " If it reached you by mistake, tell the sender at once and delete every copy."
    marks = emails.classify(text, emails.Closings([notice]))
    assert marks[-1] == "L" and marks[6] == "N"
    assert emails.gain(notice, notice.encode()) > 0.6 > emails.gain("the kettle in the garden shed costs four pounds and ten", notice.encode())


def _word(i):
    return "".join("bdfgklmnprstvz"[i // 14**k % 14] + "aeiou"[(i // 7 + k) % 5] for k in range(3))


HEAD = "From: Ann Lee <ann@x.org>\nTo: b@y.org\nSubject: s\n\nThe kettle in the shed costs four pounds.\n\n"


def test_rare_notices_and_long_threads_are_told_too(spark):
    said = [" ".join(_word(7 * i + 13 * k * k) for k in range(9)) + "." for i in range(1500)]
    closings = emails.Closings(said)
    for body in (said[0], said[-1], f"{said[5]} {said[900]} {said[-5]}"):
        assert emails.classify(HEAD + body, closings)[-1] == "L"
    assert emails.classify(HEAD + "We will bring the ladder and paint the shed on Sunday.", closings)[-1] == "N"
    quoted = "\n".join("> " + s for s in said)
    marks = emails.classify(f"{HEAD}{said[0]}\n{said[1]}\n{said[2]}\n\n{quoted}", emails.Closings())
    assert marks[6:9] == ["Q"] * 3
    # each message gets what it shares runs with, however many notices there are
    rows = [(str(i), f"{HEAD}Yes.\n\n{'_' * 30}\n{s}") for i, s in enumerate(said[:300])] + [("x", HEAD + said[140]), ("y", HEAD + "We will bring the ladder and paint the shed on Sunday, said Ann to me.")]
    mails = spark.createDataFrame(rows, "id string, text string")
    last = {r["id"]: r["mark"] for r in emails.marked_lines(mails).where("line_no = 7").collect()}
    assert last["x"] == "L" and last["y"] == "N"
    assert {r["id"]: r["notices"] for r in emails.dictionaries(mails).where("id = 'x'").collect()}["x"] == [said[140]]


def test_ancestors_come_from_the_thread_without_quote_marks(spark):
    own = "The garden wall near the old mill was painted twice by my brother last summer."
    first = f"From: Bo Carr <bo@x.example>\nTo: Ann\nSubject: wall\nDate: Mon, 1 Jan 2024 10:00:00 +0000\n\n{own}"
    reply = f"From: Ann Lee <ann@x.example>\nTo: Bo Carr <bo@x.example>\nSubject: Re: wall\nDate: Tue, 2 Jan 2024 10:00:00 +0000\n\nI had no idea of that.\n\n{own}"
    apart, stranger = reply.replace("Subject: Re: wall", "Subject: other"), reply.replace("To: Bo Carr <bo@x.example>", "To: Cy Dunn")
    mails = spark.createDataFrame([("first", first), ("reply", reply), ("apart", apart), ("again", first), ("stranger", stranger)], "id string, text string")
    got = {(r["id"], r["mark"]) for r in emails.marked_lines(mails).collect() if r["line"] == own}
    assert got == {("first", "N"), ("reply", "Q"), ("apart", "N"), ("again", "N"), ("stranger", "N")}
    assert [r["id"] for r in emails.ancestors(mails).collect()] == ["reply"]


def test_closing_formulas_are_learnt(spark):
    names = ["Ann Lee", "Bo Carr", "Cy Dunn", "Di Ford"]
    rows = [(n, f"From: {n} <a@x.example>\nTo: b\nSubject: {n}\n\nThe wall is green.\n\nUntil the cows come home,\n{n}") for n in names[:3]]
    rows.append(("alone", "From: Di Ford <a@x.example>\nTo: b\nSubject: z\n\nThe wall is green.\n\nUntil the cows come home,"))
    got = {r["id"]: r["mark"] for r in emails.marked_lines(spark.createDataFrame(rows, "id string, text string")).where("line_no = 7").collect()}
    assert set(got.values()) == {"C"}
    one = emails.marked_lines(spark.createDataFrame(rows[3:], "id string, text string")).where("line_no = 7").collect()
    assert [r["mark"] for r in one] == ["N"]


def test_mail_tables(spark):
    texts = spark.createDataFrame([("a", MAIL, 1), ("b", None, 1), ("c", MAIL, 1), (None, MAIL, 1)], "content_hash string, extracted_text string, id int")
    cat = spark.createDataFrame([("a", "eml"), ("a", "EML"), ("b", "msg"), (None, "eml"), ("c", "txt")], "content_hash string, ext string")
    mails = emails.mail_contents(texts, cat)
    lines = emails.marked_lines(mails)
    assert {r["id"] for r in lines.collect()} == {"a"} and lines.where("mark = 'N'").count() == 6
    none = emails.mail_contents(texts.limit(0), cat)
    assert emails.marked_lines(none).count() == 0


def test_residue(spark):
    prose = ["The kettle stands on the stove and the garden wall was painted by my brother in May."] * 30
    rows = [(i, f"{t} We met {i} times.") for i, t in enumerate(prose)]
    rows += [(100, "404 Not Found\nThe page you asked for is not on this server."), (101, "Lorem ipsum dolor sit amet consectetur."), (102, "The kettle stands on the {{place}} and the garden wall was painted by ${name} in May."),
             (103, "Please enable JavaScript to view this page."), (104, prose[0] + "\n\nIn the mail merge you type {{first_name}} and the office program puts the real name there."), (105, None), (106, " "), (None, "404 Not Found")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("residue", __import__("pyspark").sql.functions.lit("clash"))
    got = {r["key"] for r in residue.judged(df, "doc_id", "text").where("residue").collect()}
    assert got == {100, 101, 102, 103, None}
    assert residue.judged(df.limit(0), "doc_id", "text").count() == 0


def test_copies_of_residue_do_not_become_natural(spark):
    notice = "404 Not Found\nThe page you asked for is not on this server. Check the address and try again, or go back to the start page."
    prose = [f"The {a} stands on the {b} and the garden wall was painted by my {c} in May." for a in ("kettle", "lamp", "jar", "clock") for b in ("stove", "shelf", "table") for c in ("brother", "aunt", "cousin")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(prose + [notice] * 300)], "doc_id long, text string")
    got = {r["key"] for r in residue.judged(df, "doc_id", "text").where("residue").collect()}
    assert got == set(range(len(prose), len(prose) + 300))


PAGE = """THE GARDEN WALL   7

The garden wall was painted in May and the kettle stands on the news-
paper that my brother brought home. The lady of the house is well-
known and the rnoon is bright over the garden and the kettle again.
list of words 12

The kettle st@nds there and the newspaper lies on the garden wall now.
Page 7 of 9
\fTHE GARDEN WALL   8
The moon is bright and the garden wall is painted, says the newspaper.
Page 8 of 9"""


def test_scanned_page(spark):
    filler = ["the newspaper and the moon and the well-known lady stand in the garden with the kettle"] * 30
    rows = [("p", PAGE), ("n", None), ("e", ""), (None, PAGE)] + [(f"f{i}", t) for i, t in enumerate(filler)]
    df = spark.createDataFrame(rows, "content_hash string, extracted_text string").withColumn("id", __import__("pyspark").sql.functions.lit(1))
    lines, words = scans.label_lines(df, "content_hash", "extracted_text")
    got = {(r["line_no"], r["fault"]) for r in scans.faults(lines, words).collect() if r["id"] == "p"}
    assert got == {(1, "furniture"), (9, "furniture"), (10, "furniture"), (12, "furniture"), (3, "broken"), (5, "misread"), (8, "misread")}
    text = [r["text"] for r in scans.paragraphs(lines, words).where("id = 'p'").orderBy("paragraph_no").collect()]
    assert text[0].startswith("The garden wall was painted in May and the kettle stands on the newspaper that") and "well-known and the moon is bright" in text[0]
    assert text[1] == "list of words 12" and text[2].startswith("The kettle stands there")
    a, b = scans.label_lines(df.limit(0), "content_hash", "extracted_text")
    assert scans.faults(a, b).count() == 0


def test_breaks_are_a_label_and_one_long_line_does_not_hide_a_scan():
    labels = {no: label for no, _, label in scans.scanned_lines(PAGE)}
    assert labels[3] == scans.BREAK and labels[1] == scans.HEADER and labels[9] == scans.FOOTER and labels[5] == scans.BODY
    longer = PAGE.replace("list of words 12", "list of words 12 " + "and so on " * 30)
    assert {no: label for no, _, label in scans.scanned_lines(longer)} == labels | {6: scans.BODY}
    late = "\n".join(f"key {i}, value {i}" for i in range(20)) + "\ntext in image: " + PAGE
    assert {no - 20: label for no, _, label in scans.scanned_lines(late)} == labels


def test_corrections_stay_few_on_long_tokens():
    assert "moon" in scans.corrections("rnoon", 1) and "stands" in scans.corrections("st@nds", 3) and "clinic" in scans.corrections("c1in!c", 3)
    assert not scans.corrections("aGVsbG8gd29ybGQ1234567890" * 4, 3)
    assert len(scans.corrections("e" * 60, 1)) <= 60 * 2
