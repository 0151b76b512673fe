"""Literal cases and edge cases of the operators."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import comparison, corpus, date_normalizer, images, language, masker, providers, regex_extractor, retrieval, text_cleaner, text_corrector
from vellum.operators.text_splitter import split_text
from vellum.sources import files


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def values(df, col, key="doc_id"):
    return [r[0] for r in df.orderBy(key).select(col).collect()]


def test_splitter_reassembles(spark):
    text = "".join(chr(97 + i % 26) for i in range(1500))
    rows = split_text(docs(spark, text, "short", " \n", None), size=512, overlap=100).orderBy("doc_id", "index").collect()
    mine = [r for r in rows if r.doc_id == 0]
    assert "".join(r.text[100 if r["index"] else 0 :] for r in mine) == text
    assert [r.char_start for r in mine] == [0, 412, 824, 1236]
    assert {r.doc_id for r in rows} == {0, 1}
    with pytest.raises(ValueError):
        tx.chunks(F.lit("x"), 10, 10)


def test_cleaner(spark):
    given = docs(spark, "Hello    world.\nThis is a docu-\nment  with   spaces.", "a\n\n\n\nb \t c ", None, "")
    assert values(text_cleaner.clean_text(given), "cleaned_text") == ["Hello world.\nThis is a document with spaces.", "a\n\nb c", None, ""]
    assert values(text_cleaner.clean_text(docs(spark, "Hello World"), normalize_casing="upper"), "cleaned_text") == ["HELLO WORLD"]
    assert values(text_cleaner.clean_text(docs(spark, "it's ÉTÉ"), normalize_casing="title"), "cleaned_text") == ["It'S Été"]
    dated = text_cleaner.clean_text(docs(spark, "Invoice date: 15/03/2024"), normalize_dates=True)
    assert values(dated, "cleaned_text") == ["Invoice date: 2024-03-15"]
    assert values(text_cleaner.clean_text(docs(spark, "a§b – é%"), strip_special_chars=True), "cleaned_text") == ["ab é%"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Rendez-vous le 12/08/2026", "Rendez-vous le 2026-08-12"),
        ("on ١٢/٠٨/٢٠٢٦ and", "on 2026-08-12 and"),
        ("le 3 février 2021, puis March 4, 2022", "le 2021-02-03, puis 2022-03-04"),
        ("am 5. Oktober 2020 um", "am 2020-10-05 um"),
        ("el 6 de enero de 2019", "el 2019-01-06"),
        ("31/02/2020 is none, 2020-02-29 is", "31/02/2020 is none, 2020-02-29 is"),
        ("at 12/08/2026 10:30", "at 2026-08-12 10:30:00"),
        ("at 12/08/2026 10:30 pm", "at 2026-08-12 22:30:00"),
        ("no date 1.2.3.4", "no date 1.2.3.4"),
        ("", ""),
    ],
)
def test_dates(spark, text, expected):
    assert values(date_normalizer.normalize_dates(docs(spark, text)), "normalized_text") == [expected]


def test_hijri(spark):
    rows = date_normalizer.find_hijri_dates(docs(spark, "الموعد 17-01-1437 هـ 08:30 مساءً", "في 1 رمضان 1440", "17-01-1650")).orderBy("doc_id").collect()
    assert [r.normalized for r in rows] == ["2015-10-30 20:30:00", "2019-05-06"]


def test_masker(spark):
    text = "Mail a.b@x.org, tel +216 71 123 456, CIN: AB12345, 12 rue de Paris; IBAN FR7630006000011234567890189, ip 10.0.0.1."
    row = masker.sensitive_spans(docs(spark, text)).first()
    assert {s.type for s in row.spans} == {"EMAIL", "PHONE", "ID", "ADDRESS", "FINANCIAL", "IP_ADDRESS"}
    assert all(text[s.start : s.end] == s.value for s in row.spans)
    assert all(a.end <= b.start for a, b in zip(row.spans, row.spans[1:]))
    masked = masker.mask_text(docs(spark, text, "", None, "card 4111 1111 1111 1111 x", "4111 1111 1111 1112"))
    out = masked.orderBy("doc_id").collect()
    assert len(out[0].masked_text) == len(text) and out[0].total_masked == len(row.spans)
    assert out[1].masked_text == "" and out[2].masked_text is None and out[3].by_type == {"FINANCIAL": 1}
    again = masker.mask_text(masked.select("doc_id", F.col("masked_text").alias("text")))
    assert values(again, "masked_text") == [r.masked_text for r in out]


def test_ipv4_octets(spark):
    rows = masker.sensitive_spans(docs(spark, "256.1.1.1 01.2.3.4 1.2.3.4 9.255.0.1"), kinds=("IP_ADDRESS",)).first().spans
    assert [s.value for s in rows] == ["1.2.3.4", "9.255.0.1"]


def test_regex_extractor(spark):
    P = regex_extractor.Pattern
    rules = [
        P("code", r"Code:\s*(\w+-\w+-\w+)", 1, required=True),
        P("near", r"\d{3}", context_before="ref", exact_length=3),
        P("gone", "zzz", required=True),
    ]
    given = docs(spark, "Code: ABC-123-XYZ" + " " * 100 + "456 ref 789", None)
    rows = {(r.doc_id, r.name): r for r in [x for x in regex_extractor.extract_fields(given, rules).collect()]}
    assert rows[0, "code"].value == "ABC-123-XYZ" and rows[0, "code"].confidence == 0.8
    assert rows[0, "near"].value == "456" and rows[0, "near"].confidence == 1.0
    assert not rows[0, "gone"].found and not rows[1, "code"].found
    stats = regex_extractor.extraction_stats(given, rules).orderBy("doc_id").collect()
    assert stats[0].matched == 2 and stats[0].match_rate == 0.6667 and stats[0].missing == ["gone"]


def test_gap_checker(spark):
    invoice = "Facture: F-2024\nDate: 12/08/2026\nMontant: 120,50 EUR\nTVA: 20\nFournisseur: ACME\nClient: Dupont"
    score = regex_extractor.gap_score(docs(spark, invoice, "12/08/2026", None), regex_extractor.INVOICE_FR).orderBy("doc_id").collect()
    assert [r.matched for r in score] == [6, 1, 0] and [r.total_fields for r in score] == [6, 6, 6]
    assert score[0].threshold_exceeded and score[1].missing == ["fournisseur", "montant", "numero_facture"]


def test_language(spark):
    rows = language.detect_languages(docs(spark, "The cat is in the house and it was the best", "le chat est dans la maison", "12 34", None)).where("rank = 1")
    assert values(rows, "lang") == ["en", "fr", "unknown", "unknown"]
    mixed = language.detect_languages(docs(spark, "The cat is in the house\nle chat est dans la maison"), mode="paragraph")
    assert {"en", "fr"} <= {r.lang for r in mixed.collect()}


def test_comparison(spark):
    pairs = spark.createDataFrame([(1, "HELLO    WORLD\n", "hello world\n"), (2, "a\nb\nc", "a\nx\nc\nd"), (3, None, "")], "id int, original string, revised string")
    rows = comparison.compare(pairs, ignore_case=True).orderBy("id").collect()
    assert rows[0].identical and rows[0].similarity == 1.0 and rows[2].identical
    assert not rows[1].identical and rows[1].modified == 1 and rows[1].added == 1 and rows[1].changes[0].type == "modified"
    a, b = docs(spark, "a\na\nb"), docs(spark, "a\nb\nc")
    assert comparison.line_overlap(a, b, "doc_id").first()[1:] == (2, 1, 1)


def test_corrector(spark):
    words = spark.createDataFrame([("Helo",), ("WORLD",), ("wrld",), ("qqqq",), ("ABC",)], "word string")
    terms = spark.createDataFrame([("hello", 5), ("help", 9), ("world", 3)], "term string, frequency int")
    assert {r.word: r.corrected for r in text_corrector.corrections(words, terms).collect()} == {"Helo": "Help", "wrld": "world"}
    row = text_corrector.correct_text(docs(spark, "the docu ment is smal"), {"the": 9, "document": 3, "is": 5, "small": 2}).first()
    assert row.corrected_text == "the document is small" and row.n_changes == 2


def test_corpus(spark):
    rows = spark.createDataFrame([("A.PDF", 10), ("b.exe", 10), ("c", 10), ("d.csv", 0), ("e.txt", 60 << 20)], "path string, size_bytes long")
    assert [r.valid for r in corpus.validate_uploads(rows).collect()] == [True, False, False, False, False]
    assert corpus.route(rows, "path", [("text", [".csv", ".txt"])]).select("route").collect()[3][0] == "text"
    given = spark.createDataFrame([(1, "positive", None), (2, "negative", " "), (3, "NEGATIVE ", "x"), (4, None, None)], "id int, sentiment string, correction string")
    assert [r.signal for r in corpus.validate_feedback(given).orderBy("id").collect()] == [1, 0, -1, 0]


def test_retrieval(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query array<double>")
    rows = retrieval.top_k(store, q, 3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(1, 1.0), (4, 1.0), (3, 0.7071)]
    index = retrieval.index_documents(docs(spark, "red apples grow on trees", "the sea is deep and blue", " "))
    asked = spark.createDataFrame([(1, "which apples are red")], "query_id long, question string")
    found = retrieval.retrieve(index, asked, 1).first()
    assert found.retrieved[0].source == "0"
    empty = retrieval.retrieve(index.limit(0), asked).select(retrieval.build_prompt(F.col("retrieved"), F.col("question"))).first()[0]
    assert retrieval.NO_DOCUMENTS in empty and "which apples are red" in empty


def test_providers(spark):
    assert providers.sentiment(docs(spark, "x")).first().sentiment.polarity == "neutral"
    said = providers.batched(lambda prompts: ['Sure. {"polarity":"positive","score":0.5}' for _ in prompts])
    assert providers.sentiment(docs(spark, "x"), said).first().sentiment.score == 0.5
    assert providers.summarize(docs(spark, "One. Two! Three? Four."), "bullet_points").first().summary == "- One.\n- Two!\n- Three?"
    steps = spark.createDataFrame([('{"steps":[{"agent":"ocr","instruction":"read"}]}',), ("bad",)], "reply string")
    assert [len(r.steps) for r in providers.plan_steps(steps).collect()] == [1, 0]
    with pytest.raises(RuntimeError):
        providers.translate(docs(spark, "x"), "en", "fr")


def test_images(spark):
    p = (np.arange(6 * 5 * 3) % 97).astype(np.uint8).reshape(6, 5, 3)
    df = spark.createDataFrame([("a", 6, 5, 3, bytearray(p.tobytes()))], "origin string, height int, width int, nChannels int, data binary")
    row = images.transform_images(df, lambda x: images.rotate(x, 90)).first()
    assert (row.height, row.width) == (5, 6) and row.luminance_before == row.luminance_after
    assert images.transform_images(df, images.enhance).first().luminance_after > row.luminance_before
    flat = np.full((5, 5, 3), 9, np.uint8)
    spot = flat.copy()
    spot[2, 2] = 255
    assert (images.denoise(spot) == flat).all() and (images.denoise(flat, "gaussian") == flat).all()
    assert images.watermark_mask(np.full((4, 4, 3), 250, np.uint8)).all()


def _zip(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def test_files(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('A1')}{cell('B1')}</w:tr><w:tr>{cell('A2')}{cell('B2')}</w:tr></w:tbl>"
    docx = _zip(**{"word__document.xml": f"<w:document {w}><w:body>{p('one')}{table}{p('two')}</w:body></w:document>", "word__header1.xml": f"<w:hdr {w}>{p('head')}</w:hdr>", "word__footer1.xml": f"<w:ftr {w}>{p('foot')}</w:ftr>"})
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = "".join(f'<row><c t="inlineStr"><is><t>r{i}</t></is></c><c><v>{i}</v></c></row>' for i in range(20))
    xlsx = _zip(**{
        "xl__workbook.xml": f'<workbook {s} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="x"/></sheets></workbook>',
        "xl___rels__workbook.xml.rels": '<Relationships><Relationship Id="x" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl__worksheets__sheet1.xml": f"<worksheet {s}><sheetData>{sheet}</sheetData></worksheet>",
    })
    given = [("a.docx", docx), ("b.xlsx", xlsx), ("c.csv", b"a;b\n1;2;3\n"), ("d.txt", "é".encode("latin-1")), ("e.zip", b"x"), ("f.docx", b"junk"), ("g.txt", b"")]
    rows = spark.createDataFrame([(n, bytearray(b)) for n, b in given], "path string, content binary").withColumn("extension", tx.extension(F.col("path")))
    out = {r.path[0]: r for r in files.parse_documents(rows).collect()}
    assert [b.kind for b in out["a"].blocks] == ["paragraph", "paragraph", "table", "paragraph", "paragraph"]
    assert "A1\tB1" in out["a"].text and out["a"].text.startswith("head") and out["a"].text.endswith("foot")
    assert out["b"].row_count == 20 and not out["b"].truncated and out["c"].blocks[0].cells == [["a", "b"], ["1", "2", "3"]]
    assert out["d"].text == "é" and [out[k].status for k in "efg"] == ["failure"] * 3
    few = files.parse_documents(rows.where("path = 'b.xlsx'"), parse_entire_document=False, max_rows_per_sheet=5).first()
    assert few.row_count == 5 and few.truncated
    assert files.table_long(files.parse_documents(rows)).where("path = 'c.csv'").count() == 5


def test_key_values(spark, tmp_path):
    folder = f"file://{tmp_path}/kv"
    assert files.list_keys(spark, folder) == []
    files.save_value(spark.range(3), folder, "a1")
    files.save_value(spark.range(2), folder, "b1")
    assert files.list_keys(spark, folder, "a") == ["a1"] and files.read_value(spark, folder, "b1").count() == 2
    assert files.delete_value(spark, folder, "a1") and files.list_keys(spark, folder) == ["b1"]


def test_clusters(spark):
    from vellum.operators import clustering

    money = ["bank credit loan interest money account", "money bank account loan credit payment", "interest credit bank payment account loan"]
    health = ["doctor patient hospital medicine nurse care", "hospital nurse doctor patient care surgery", "medicine patient doctor care hospital nurse"]
    rows = clustering.cluster_topics(docs(spark, *money, *health), k=2)
    got = values(rows, "cluster")
    assert len(set(got[:3])) == len(set(got[3:])) == 1 and got[0] != got[3]
    usable, skipped = clustering.eligible(docs(spark, "long enough to be counted", " ", None))
    assert usable.count() == 1 and skipped.count() == 2


def test_streams(spark, tmp_path):
    from vellum.streaming import events

    src = f"file://{tmp_path}/in"
    docs(spark, "x" * 1000, "y").write.parquet(src)
    stream = events.stream_table(spark, src, docs(spark, "x").schema)
    events.ingest_chunks(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 4


def test_languages_of_texts_without_latin_letters(spark):
    rows = [(1, "ذهب الولد إلى المدرسة في الصباح مع أن هذا اليوم كان يوم عطلة من العمل"), (2, "12 34"), (3, None), (4, "y\nde\n7"), (5, "The end of it and the rest of it was that.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for mode in ("document", "paragraph"):
        best = {r.doc_id: r.lang for r in language.detect_languages(docs, mode).where("rank = 1").collect()}
        assert best == {1: "ar", 2: "unknown", 3: "unknown", 4: "es", 5: "en"}


def test_first_wins_and_latest(spark):
    rows = spark.createDataFrame([(1, "a", 3), (2, "a", None), (3, None, 1), (4, None, 2)], "id long, k string, at int")
    assert sorted(r.id for r in corpus.first_wins(rows, [F.col("k")], [F.col("at")]).collect()) == [2, 3]
    assert corpus.first_wins(rows, [F.col("k")], [F.col("at")]).columns == rows.columns
    latest = corpus.upsert_latest(rows.where("id < 3"), rows.where("id > 2"), "k", "at", "id")
    assert sorted(r.id for r in latest.collect()) == [1, 4]


def test_dates_of_both_calendars(spark):
    rows = docs(spark, "الموعد 17-01-1437 هـ 08:30 مساءً ثم 12/08/2026", "1 رمضان 1440, 17-01-1650, 3/4/2020 10:05 pm", None, "")
    out = date_normalizer.normalize_dates(rows, hijri=True).orderBy("doc_id").collect()
    assert [[(d.normalized, d.calendar) for d in r.dates or []] for r in out] == [
        [("2015-10-30 20:30:00", "hijri"), ("2026-08-12", "gregorian")],
        [("2019-05-06", "hijri"), ("1650-01-17", "gregorian"), ("2020-04-03 22:05:00", "gregorian")],
        [],
        [],
    ]
    assert out[0].normalized_text == "الموعد 2015-10-30 20:30:00 ثم 2026-08-12"


def test_index_is_stored(spark, tmp_path):
    index = retrieval.index_documents(docs(spark, "one two", "three"))
    assert retrieval.save_index(index, f"file://{tmp_path}/i") == 2 == retrieval.save_index(index, f"file://{tmp_path}/i")
    assert sorted(retrieval.load_index(spark, f"file://{tmp_path}/i").collect()) == sorted(index.collect())
