"""Inputs that the small tables do not hold: tiny tables, repeated ids, other notations."""

import re
import subprocess
import sys
import time
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from playseq.llm import decontaminate, mixing, ngram_join, pii, secret_scan, toxicity
from playseq.llm.common import table
from tests.conftest import collected

MID = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", range(6))
def test_shingles_of_a_lone_short_text(n):
    text = " ".join("abcde"[:n]).encode()
    alone = ngram_join.shingle_sets([text], 5)
    assert [len(s) for s in alone] == [int(n > 0)]
    # The same hashes as beside a longer text.
    assert np.array_equal(alone[0], ngram_join.shingle_sets([text, b"one two three four five six"], 5)[0])


def test_shingles_of_a_short_text_between_long_ones():
    long = b"word " * (ngram_join.CHUNK // 5 + 1)
    assert [len(s) for s in ngram_join.shingle_sets([long, b"two words", long], 5)] == [1, 1, 1]


def test_ngram_join_of_a_tiny_table(spark):
    for n in range(1, 6):
        df = spark.createDataFrame([(7, " ".join("abcde"[:n]))], "doc_id long, text string")
        assert [(r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, words=5, percent=80).collect()] == [(1, 7)]


def test_repeated_id_is_learned_from_once(spark):
    docs, labels = table(spark, MID, "documents"), table(spark, MID, "labels")
    drawn = {r.text: r.toxic for r in toxicity.sample(docs, labels).collect()}
    one = docs.join(labels.where("toxic = 0"), "doc_id", "left_semi").join(toxicity.sample(docs, labels).select("text"), "text", "left_semi").select("doc_id", "text").orderBy("doc_id").first()
    again = spark.range(2000).select(F.lit(one.doc_id).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit(one.text)).otherwise(F.concat(F.lit("scum "), F.col("id").cast("string"))).alias("text"))
    many = docs.select("doc_id", "text").union(again)
    rows = toxicity.sample(many, labels).collect()
    assert len(rows) == toxicity.sample(docs, labels).count()
    # One of the id's own texts, the same on every run; all other rows are as before.
    assert {r.text: r.toxic for r in toxicity.sample(many.repartition(7), labels).collect()} == {r.text: r.toxic for r in rows}
    assert len({r.text for r in rows} - set(drawn)) <= 1


def test_copies_of_an_id_do_not_change_scores(spark):
    docs, labels = table(spark, MID, "documents"), table(spark, MID, "labels")
    one = toxicity.sample(docs, labels).where("toxic = 0").join(docs, "text").select("doc_id").orderBy("doc_id").first()[0]
    copies = docs.where(F.col("doc_id") == one).crossJoin(spark.range(500)).select(*docs.columns)
    plain, many = toxicity.fit(docs, labels), toxicity.fit(docs.union(copies), labels)
    assert plain.weights == many.weights and list(plain.exceptions) == list(many.exceptions)
    assert np.allclose(plain.coefficients, many.coefficients)


SECRETS = [
    ('password = "{}" here', "correctHorseBattery"),
    ('pwd: "{}"', "Tr0ub4dor&3"),
    ("DB_PASSWORD={}\nnext", "hunter2!x"),
    ("password: '{}',", "s.e$c@r#1"),
    ('{{"password": "{}"}}', "rainyTuesdayEvening"),
    ("secret={} and", "Ab3$efgh"),
]
PLAIN = ["password = getUserPassword() here", "token: undefined", "the password: anything you like", 'password = os.environ["DB_PASSWORD"]', "password = ${MAIN_PASSWORD}", "author: somebody else", "x = correctHorseBattery"]


def test_secrets_without_digits_or_with_signs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, form.format(value)) for i, (form, value) in enumerate(SECRETS)] + [(50 + i, t) for i, t in enumerate(PLAIN)]
    rows += [(100 + i, f'token = "{rng.bytes(20).hex()}" and {rng.integers(10**15, 10**16)}') for i in range(150)]
    for given in (rows, rows[: len(SECRETS) + len(PLAIN)]):
        docs = spark.createDataFrame(given, "doc_id long, text string")
        found = secret_scan.scan(docs, ["doc_id", "text"]).collect()
        assert all(r.text[r.start : r.start + len(r.value)] == r.value for r in found)
        assert {(r.doc_id, r.value) for r in found if r.secret and r.doc_id < 100} == {(i, v) for i, (_, v) in enumerate(SECRETS)}
        clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
        assert [clean[i] for i in range(len(SECRETS))] == [form.format("[SECRET]") for form, _ in SECRETS]
        assert [clean[50 + i] for i in range(len(PLAIN))] == PLAIN


def test_long_texts_of_assignments_are_scanned(spark):
    texts = ["password = " * 2000, 'password="' * 2000, "password:" + " " * 300_000, "token" * 60_000, 'secret = "' + "word! " * 50_000 + '"']
    found = secret_scan.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(texts[r.doc_id][r.start : r.start + len(r.value)] == r.value for r in found)
    assert {r.doc_id for r in found} == {0, 1, 4} and max(len(r.value) for r in found) == 300_000


def test_pseudonyms_of_other_notations(spark):
    values = ["12/25/2024", "02/29/2024", "01/31/1999", "+49 30 1234567", "+44 20 7946 0958", "+4930123456", "+1 2345678", "DE89 3704 0044 0532 0130 00", "AT61 1904 3002 3457 3201", "NO93 8601 1117 947"]
    docs = spark.createDataFrame([(1, "|".join(values)), (2, "pay AT61 1904 3002 3457 3201 EUR"), (3, "AT611904300234573201"), (4, "02/30/2024, 13/13/2024, DE88 3704 0044 0532 0130 00, +49 12345")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    new = rows[1].text.split("|")
    assert rows[1].n_values == len(values) and all(a != b for a, b in zip(values, new))
    assert [re.sub("[0-9]", "0", v) for v in values] == [re.sub("[0-9]", "0", v) for v in new]
    assert all(datetime.strptime(d, "%m/%d/%Y").day > 12 for d in new[:3])
    assert [v.split(" ")[0] for v in new[3:5]] == ["+49", "+44"] and new[5].startswith("+49") and new[6].startswith("+1 ")
    for iban in new[7:]:
        joined = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in joined[4:] + joined[:4])) % 97 == 1
    assert rows[2].text == f"pay {new[8]} EUR" and rows[3].text == new[8].replace(" ", "")
    assert rows[4].n_values == 0 and rows[4].text == docs.where("doc_id = 4").first().text


def test_slash_dates_are_permuted_one_to_one(spark):
    days = [date(1900, 1, 1) + timedelta(d) for d in range(0, 73049)]
    days = [d for d in days if d.day > 12 and (d.day > 28 or d.year % 20 == 0)]
    df = spark.createDataFrame([(d.strftime("%m/%d/%Y"),) for d in days], "v string").repartition(8)
    made = [r.p for r in df.select(pii.pseudonym(F.col("v"), F.lit("date"), "k").alias("p")).collect()]
    assert len(set(made)) == len(days) and None not in made
    assert all(datetime.strptime(p, "%m/%d/%Y").day > 12 and 1900 <= int(p[6:]) < 2100 for p in made)
    late = [d.strftime("%m/%d/%Y") for d in days if d.day > 28]
    assert {p for p in made if int(p[3:5]) > 28} == set(late)


def test_spans_do_not_depend_on_blocks(spark):
    words = [f"word{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x, " + " -- ".join(words[:25])), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(words[a:b])) for i, (a, b) in enumerate([(0, 12), (5, 18), (18, 30), (35, 50), (40, 55), (52, 60), (35, 50)])], "item_id long, text string")
    plain = decontaminate.find_contamination(docs, bench)
    assert [(s.start, s.end) for s in plain.where("doc_id = 1").first().spans] == [(0, len(" ".join(words[:30]))), (len(" ".join(words[:35])) + 1, len(" ".join(words)))]
    assert collected(plain) == collected(decontaminate.find_contamination(docs, bench, block_bytes=150))


def test_a_full_block_fits_a_worker():
    code = """
import random, resource
from playseq.llm import decontaminate as d
r = random.Random(1)
items = [(str(i), " ".join(f"{r.randrange(5000):07d}" for _ in range(100)).encode()) for i in range(d.BLOCK_BYTES // 800)]
d.Automaton(items)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    made = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert int(made.stdout) < 1000, made.stdout


def test_redact_of_one_id_is_linear_and_keeps_columns(spark):
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit('token = "'), F.sha1(F.col("id").cast("string")), F.lit('" here')).alias("text"), F.lit("a.py").alias("source"), F.lit("mine").alias("_key"))
    start = time.perf_counter()
    got = secret_scan.redact(rows)
    assert got.columns == rows.columns
    found = got.agg(F.count("*"), F.count_if(F.col("text") == 'token = "[SECRET]" here'), F.count_if(F.col("_key") == "mine")).first()
    assert tuple(found) == (20_000, 20_000, 20_000)
    assert time.perf_counter() - start < 60


def test_long_run_with_a_late_digit_is_a_candidate(spark):
    for letters in (150, 210, 5000):
        df = spark.createDataFrame([(1, "x " + "q" * letters + "7 y", "s")], "doc_id long, text string, source string")
        assert [len(r.value) for r in secret_scan.candidates(df).collect()] == [letters + 1]
    # Texts without a digit after a long run take no longer for it.
    df = spark.createDataFrame([(1, "q" * 300_000 + " : " + "ab-" * 100_000, "s")], "doc_id long, text string, source string")
    assert secret_scan.candidates(df).where("start < 300000").count() == 0


def test_candidates_equal_a_plain_version(spark):
    docs = table(spark, MID, "documents")
    plain = set()
    for row in docs.select("doc_id", "text").collect():
        text = row.text or ""
        for m in re.finditer(r"[A-Za-z0-9+/_-]+", text):
            given = re.search(r"(?i)(token|secret|passw(or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)s?[\"'\])]{0,2}\s{0,2}[:=]{1,2}\s{0,2}[\"'`]?$", text[: m.start()][-60:])
            if len(m[0]) >= 12 and re.search("[0-9]", m[0]) and not given:
                plain.add((row.doc_id, m.start(), m[0] + re.match("={0,2}", text[m.end() :])[0]))
    found = {(r.doc_id, r.start, r.value) for r in secret_scan.candidates(docs).collect()}
    assert plain <= found
    assert all(re.search("[:=]", docs.where(F.col("doc_id") == i).first().text[:s][-12:]) for i, s, _ in list(found - plain)[:20])


def test_mixing_of_a_repeated_id(spark):
    """A third of the rows under one id: the same result as with ids of their own, up to which of them gives a part."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("w x y").alias("text"))
    rows = mixing.mix(docs.repartition(7)).collect()
    assert len(rows) == 3000 and sum(r.taken for r in rows) == round(rows[0].target)
    assert all(r.taken <= 2 * r.size for r in rows)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    # Positions of the copies follow each other as those of other documents do.
    places = sorted(r.position for r in rows)
    assert len(set(places)) == 3000


def test_automaton_of_a_large_vocabulary():
    """Building and scanning depend on the words, not on how many different ones there are."""
    rng = np.random.default_rng(4)
    took = {}
    for vocabulary in (200, 20_000, 300_000):
        names = [f"w{i}" for i in range(vocabulary)]
        items = [(str(i), " ".join(names[k] for k in rng.integers(0, vocabulary, 200)).encode()) for i in range(400)]
        automaton = decontaminate.Automaton(items)
        text = [names[k].encode() for k in rng.integers(0, vocabulary, 20_000)] + decontaminate.words(items[7][1])[50:75]
        start = time.perf_counter()
        spans, who = automaton.scan(text)
        took[vocabulary] = time.perf_counter() - start
        assert spans[-1] == (20_000, 20_025) and "7" in who
    assert took[300_000] < 10 * took[200] + 0.05


def test_one_id_with_many_texts_is_one_vertex(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(2000)]
    base = [" ".join(words[k] for k in rng.integers(0, 2000, 40)) for _ in range(300)]
    rows = [(9, t) for t in base] + [(3, base[0]), (20 + 0, base[299]), (4000, "something else entirely that nobody else has written")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df).collect()}
    assert got == {9: 3, 3: 3, 20: 3, 4000: 4000}


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(1)
    for n in (1, 50, 476, 2040, 2050, 9000):
        for drop in (0, 5, n // 10, n // 2):
            base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            other = np.unique(np.concatenate([base[drop:], rng.integers(0, 2**63, drop // 2, dtype=np.uint64)]))
            left, right = (ngram_join.sketch(x).tobytes() for x in (base, other))
            for size in (ngram_join.SKETCH, min(len(left), len(right)) // 8):
                differ = (ngram_join.folded(left, size) ^ ngram_join.folded(right, size)).view(np.uint64)
                assert np.bitwise_count(differ).sum() <= len(np.setxor1d(base, other))


def test_pseudonyms_of_social_security_numbers_are_valid_and_one_to_one(spark):
    rng = np.random.default_rng(2)
    values = {f"{a:03d}-{g:02d}-{n:04d}" for a, g, n in zip(rng.integers(1, 900, 3000), rng.integers(1, 100, 3000), rng.integers(1, 10000, 3000)) if a != 666}
    values |= {"001-01-0001", "899-99-9999", "665-50-5000", "667-50-5000"}
    df = spark.createDataFrame([(v,) for v in sorted(values)], "v string")
    rows = df.select("v", pii.kind_of(F.col("v")).alias("k")).select("v", "k", pii.pseudonym(F.col("v"), F.col("k"), "key").alias("p")).select("*", pii.kind_of(F.col("p")).alias("again")).collect()
    assert {r.k for r in rows} == {"ssn"} == {r.again for r in rows}
    assert len({r.p for r in rows}) == len(values) and sum(r.v == r.p for r in rows) < 5
    noise = {}

    def drawn(i, right):
        if (i, right) not in noise:
            noise[i, right] = spark.range(1).select(pii._random("key", F.lit("ssn"), F.lit(i), F.lit(right).cast("long"))).first()[0]
        return noise[i, right]

    for r in rows[:3]:
        area, group, serial = (int(x) for x in r.v.split("-"))
        left, right = area - 1 - (area > 666), (group - 1) * 9999 + serial - 1
        for i in range(pii.ROUNDS):
            left, right = right, (left + drawn(i, right)) % (898 if i % 2 == 0 else 99 * 9999)
        area = left + 1 + (left + 1 >= 666)
        assert r.p == f"{area:03d}-{right // 9999 + 1:02d}-{right % 9999 + 1:04d}"


def plain_hits(lexicon, folded):
    found = {}
    for start in range(len(folded)):
        best = max((w for p, w in lexicon.weights.items() if folded.startswith(p, start)), default=None)
        if best is not None:
            found[start] = best
    for phrase in lexicon.exceptions:
        for start in range(len(folded)):
            if folded.startswith(f" {phrase} ", start):
                for at in [s for s in found if start <= s < start + len(phrase) + 1]:
                    del found[at]
    return found


def test_hits_equal_a_plain_version_and_are_linear():
    rng = np.random.default_rng(3)
    words = ["scum", "pond", "scummy", "idiot", "the", "a", "iow", "iower"]
    lexicon = toxicity.Lexicon({" scum ": 5.0, " scum": 2.0, " idiot ": 3.0, " iow": 1.0, " a ": 0.5}, ["pond scum", "scum pond scum", "the idiot", "a a"])
    for _ in range(200):
        folded = f" {' '.join(rng.choice(words, rng.integers(0, 12)))} "
        assert lexicon.hits(folded) == plain_hits(lexicon, folded), folded
    took = []
    for n in (10_000, 160_000):
        folded = f" {' '.join(['pond scum idiot'] * (n // 3))} "
        lexicon.hits(" a ")
        start = time.perf_counter()
        assert len(lexicon.hits(folded)) == n // 3
        took.append(time.perf_counter() - start)
    assert took[1] < 60 * took[0] + 0.1
