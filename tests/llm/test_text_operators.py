"""Language, toxicity, decontamination, secrets and pseudonyms, against plain versions and on held-out rows."""

import time
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from playseq.llm import decontaminate, html, langid, pii, secret_scan, toxicity
from playseq.llm.common import table
from tests.conftest import SF, collected

MID = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None, "en", "s", 0), (2, "", "en", None, 0), (3, long, None, "s", 1), (4, "only 12345", "en", "s", 1), (4, "only 12345", "en", "s", 1), (None, "null id text", "de", "s", 1), (7, "…!? 42", "de", "t", 1), (8, "\t\n ", "fr", "t", 1)]
    return spark.createDataFrame(rows, DOCS)


def test_language_of_held_out_documents(spark):
    docs = table(spark, MID, "documents")
    found = langid.identify(docs, ["doc_id", "lang"]).where("held_out").collect()
    assert len(found) > 100 and np.mean([r.lang == r.lang_pred for r in found]) > 0.95


def test_language_edge_cases(spark, odd):
    found = langid.identify(odd).collect()
    assert len(found) == odd.count()
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 7, 8))
    assert langid.identify(odd.limit(0)).count() == 0
    nobody = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nobody.collect()} == {"und"}


def test_windows_cover_texts():
    texts = [b"", b"a" * 5, bytes(range(65, 91)) * 40]
    cut, owner = langid.windows(texts)
    assert set(owner) == {0, 1, 2}
    last = cut[owner == 2]
    joined = b"".join(bytes(w[: langid.STEP]) for w in last[:-1]) + bytes(last[-1])
    assert joined.rstrip(b" ") == texts[2]


def test_folding():
    assert toxicity.fold("Thе 1D10T іs $tupid, m0r0n! wortһless 42") == " the idiot is stupid moron worthiess 42 "


def test_toxicity_of_labelled_rows(spark):
    docs, labels = table(spark, MID, "documents"), table(spark, MID, "labels")
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    clean = [r.predicted for r in found if r.toxic == 0]
    toxic = [r.predicted for r in found if r.toxic == 1]
    assert np.mean(clean) < 0.05 and np.mean(toxic) > 0.5


def test_exceptions_and_hits():
    words = toxicity.Lexicon({" scum ": 5.0, " lowe": 4.0}, ["pond scum"])
    assert words.hits(" the scum ") == {4: 5.0}
    assert words.hits(" pond scum ") == {}
    assert words.hits(" loweiss ") == {0: 4.0}
    assert toxicity.Lexicon({}).score(" a ") < 0.5


def test_toxicity_edge_cases(spark, odd):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity(odd, none).collect()
    assert len(found) == odd.count() and all(r.predicted == 0 and 0 <= r.score <= 1 for r in found)
    assert toxicity.toxicity(odd.limit(0), none.limit(0)).count() == 0


def _plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_contamination_with_blocks_and_offsets(spark, odd):
    item = " ".join(f"word{i}" for i in range(100, 130))
    bench = spark.createDataFrame([(5, item), (6, "Only 12345"), (7, None), (8, "--"), (None, "null ID"), (5, item)], "item_id long, text string")
    plain = collected(decontaminate.find_contamination(odd, bench))
    assert plain == collected(decontaminate.find_contamination(odd, bench, block_bytes=20))
    rows = {r.doc_id: r for r in decontaminate.find_contamination(odd, bench, keep=["doc_id", "text", "n_words"]).collect()}
    assert rows[4].contaminated and rows[4]["items"] == ["6"] and rows[4].n_hit == 2
    assert [rows[4].text[s.start : s.end] for s in rows[4].spans] == ["only 12345"]
    assert rows[None].n_hit == 2 and rows[None].n_items == 0
    hits = [rows[3].text[s.start : s.end] for s in rows[3].spans]
    assert set(hits) == {item} and rows[3].n_hit == 30 * len(hits)
    assert rows[1].n_words == 0 and not rows[1].contaminated
    assert rows[3].n_words == len(_plain_words(rows[3].text))
    assert decontaminate.find_contamination(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_contamination(odd.limit(0), bench).count() == 0


def test_secrets(spark):
    rng = random.Random(3)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(80)]
    rows = [(i, f'some words token = "{h}" and more', None, "app/config.yml", 0) for i, h in enumerate(hexes[:40])]
    rows += [(100 + i, f"card {rng.randrange(10**15, 10**16)} of the day", None, "app/a.txt", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    found = secret_scan.scan(docs, ["doc_id", "text"]).collect()
    assert all(r.text[r.start : r.start + len(r.value)] == r.value for r in found)
    assert {r.doc_id for r in found if r.secret} == set(range(40))
    clean = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert clean[3].text == 'some words token = "[SECRET]" and more' and clean[3].n_chars == len(clean[3].text)
    assert clean[100].text == rows[40][1] and clean[100].n_chars == 0


def test_secret_edge_cases(spark, odd):
    assert secret_scan.scan(odd).count() == 0
    assert collected(secret_scan.redact(odd)) == collected(odd)
    assert secret_scan.redact(odd.limit(0)).count() == 0
    lone = spark.createDataFrame([(None, "password=b7db7aa4a5fcc78305 x", None, None, 1)], DOCS)
    assert secret_scan.redact(lone).first().text == "password=[SECRET] x"


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    text = "card 4111 1111 1111 1111, +1 (988) 555-2485, 10.0.0.255, 300.1.1.1, 2024-02-29, 2023-02-30, a.b7@x.org, DE89370400440532013000"
    docs = spark.createDataFrame([(1, text), (2, "4111111111111111"), (3, None), (4, ""), (5, "1234567890123")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    new = rows[1].text
    assert new != text and len(new.split(", ")) == len(text.split(", "))
    card, phone, ip, bad, day, no_day, mail, iban = (x.removeprefix("card ") for x in new.split(", "))
    assert re.fullmatch(r"(\d{4} ){3}\d{4}", card) and _luhn(card.replace(" ", "")) and card != "4111 1111 1111 1111"
    assert rows[2].text == card.replace(" ", "")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone)
    assert all(int(x) < 256 for x in ip.split(".")) and bad == "300.1.1.1" and no_day == "2023-02-30"
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", day) and re.fullmatch(r"[a-z]\.[a-z]\d@x\.org", mail)
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert rows[3].text is None and rows[4].text == "" and rows[5].text == "1234567890123" and rows[5].n_values == 0
    assert rows[1].kinds == ["card", "date", "email", "iban", "ip", "phone"]
    assert pii.pseudonymise(docs, "other").where("doc_id = 2").first().text != rows[2].text


def test_permutation_is_one_to_one(spark):
    numbers = spark.range(0, 1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    made = numbers.select(pii.permute_digits(F.col("d"), "t", "k").alias("p"))
    assert made.distinct().count() == 1000 and made.where("length(p) <> 3").count() == 0
    names = spark.range(0, 676).select(F.concat(F.char(97 + F.col("id") % 26), F.char((97 + F.col("id") / 26).cast("int"))).alias("d"))
    assert names.select(pii.permute_text(F.col("d"), "t", "k").alias("p")).distinct().count() == 676


def test_held_out_fold_is_not_learned_from(spark):
    docs = table(spark, SF, "documents")
    model = langid.fit(docs)
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "en").otherwise(F.col("lang")))
    assert np.array_equal(model.filters, langid.fit(changed).filters)


def _same_text(spark, change):
    """Share of all small pages that give the same text as before ``change``."""
    pages = table(spark, SF, "pages")
    want = {r.page_id: r.text for r in html.main_text(pages).collect()}
    rows = [(r.page_id, r.url, change(r.html) if r.html else r.html) for r in pages.collect()]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, pages.schema)).collect()}
    return sum(got[i] == t for i, t in want.items()) / len(want)


def test_pages_that_mark_nothing_up_have_texts(spark):
    assert _same_text(spark, lambda h: re.sub(r"<(/?)(?:article|main)\b", r"<\1div", h)) >= 0.9


def test_pages_without_class_names_have_texts(spark):
    assert _same_text(spark, lambda h: re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", h)) >= 0.9


def test_variants_of_the_examples_keep_their_nodes():
    for nodes, labels in html.examples():
        assert len(nodes) == len(labels) and 0 < sum(labels) < len(labels)


def test_stray_end_tags_and_deep_nesting_parse_in_linear_time():
    start = time.perf_counter()
    for page in ("<div>" * 100_000 + "x" + "</span>" * 100_000, "<div><b>" * 50_000 + "x" + "</i></p>" * 50_000):
        assert [n.text for n in html.parse(page) if n.text] == ["x"]
    assert time.perf_counter() - start < 20
