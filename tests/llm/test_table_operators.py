"""Archive, vectors, pages, n-gram join, mixing, queries and pipeline, against plain versions."""

import itertools
import pathlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from playseq.llm import components, embeddings, html, mixing, ngram_join, queries, secret_scan, warc
from playseq.llm.common import table
from playseq.operators.storage import shared_dir
from tests.conftest import SF, collected
from tools.compare import TABLES, rows


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, db, name):
    want = db.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_queries_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def _minimum(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 330)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(500, i) for i in range(501, 600)] + [(5, 5), (7, 3), (7, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: c for n, c in _minimum({n for e in edges for n in e}, edges).items() if n in nodes}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGES = "page_id long, url string, html string"


def test_archive_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 40
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", big), (2, None, big), (3, "http://c", None), (4, "http://d", ""), (None, "http://e", big), (6, "u", "short"), (6, "u", "short"), (1, "http://a", big)], PAGES)
    warc.write_archive(pages, str(tmp_path / "a"))
    archive = warc.read_archive(spark, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == 3
    kinds = collected(archive, "page_id", "record_type", "refers_to")
    assert kinds == sorted([(1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "revisit", 1), (3, "response", None), (4, "response", None), (6, "response", None), (6, "response", None)], key=repr)
    warc.export_warc(archive, str(tmp_path / "files"))
    back = warc.import_warc(spark, f"{tmp_path}/files/*.gz").collect()
    exact = sorted(bytes(r.record) for r in warc.record_bytes(archive).collect())
    assert exact == sorted((r.warc + r.http).encode() + bytes(r.payload) + b"\r\n\r\n" for r in back)
    assert all("\nX: y" not in r.warc for r in back)
    assert warc.archived(pages.limit(0)).count() == 0


def test_archive_detects_damage(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "x" * 200)], PAGES), str(tmp_path))
    payloads = spark.read.parquet(f"{tmp_path}/payloads").withColumn("payload", F.lit(b"other")).collect()
    spark.createDataFrame(payloads, "payload_digest string, payload binary").write.mode("overwrite").parquet(f"{tmp_path}/payloads")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, str(tmp_path)).collect()


def _vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    made = [c + rng.normal(scale=s, size=8) for c in centres for s in (0.05, 0.2, 0.3) for _ in range(12)]
    return made + [rng.normal(size=8) for _ in range(60)] + made[:5]


def test_vectors_against_all_pairs(spark):
    made = [[float(x) for x in v] for v in _vectors()]
    data = [(i, v) for i, v in enumerate(made)] + [(900, None), (901, [0.0] * 8), (902, [1.0, None] + [0.0] * 6), (903, [float("nan")] * 8), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, made[0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    unit = np.array([v / np.linalg.norm(v) for v in np.array(made)])
    links = [(i, j) for i, j in itertools.combinations(range(len(made)), 2) if unit[i] @ unit[j] >= 0.9] + [(905, 906)]
    label = _minimum([i for i, _ in data if i is not None], links)
    for block in (17, 4096):
        got = {r.vec_id: r for r in embeddings.near_duplicates(df, block=block).collect()}
        assert {i: r.component_id for i, r in got.items() if i is not None} == label
        assert {i: r.n_links for i, r in got.items() if i is not None} == {i: sum(i in e for e in links) for i in label}
    assert got[None].n_links == 0 and got[905].kept and not got[906].kept
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def _shingles(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def _labels(texts, k, percent):
    """Smallest id reachable by links, from all pairs."""
    sets = {i: _shingles(t, k) for i, t in texts.items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, _minimum(sets, links)


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_ngram_join_against_all_pairs(spark, words, percent):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for size in (4, 9, 12, 13, 14, 22, 40, 90, 200):
        for _ in range(3):
            base = [rng.choice(vocabulary) for _ in range(size)]
            texts.append(base)
            for _ in range(14):
                other = list(base)
                for _ in range(rng.choice([0, 1, 1, 2, 3])):
                    at = rng.randrange(len(other))
                    other[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [other[at], rng.choice(vocabulary)]])
                    other = other or ["x"]
                texts.append(other)
    data = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(5000, None), (5001, ""), (5002, "One"), (5003, "one"), (5004, "a b"), (5005, "A\tb\n"), (None, "one"), (5006, "lost " * 50_000)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("n", F.lit(1))
    sets, label = _labels({i: t for i, t in data if i is not None}, words, percent)
    got = {r.doc_id: r for r in ngram_join.near_duplicates(df, words=words, percent=percent).collect()}
    assert {i: r.n_shingles for i, r in got.items() if i is not None} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items() if i is not None} == label
    assert got[None].component_id is None
    assert ngram_join.near_duplicates(df.limit(0), words=words, percent=percent).count() == 0


def _copies(folder):
    return [p.name.split("-")[0] for p in pathlib.Path(folder.removeprefix("file://"), "playseq").glob("*")]


def test_components_of_stars_take_one_round(spark):
    folder = shared_dir(spark)
    before = _copies(folder).count("edges")
    edges = spark.createDataFrame([(1, i) for i in range(2, 40)] + [(50, 51), (51, 50)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 40)}, 50: 50, 51: 50}
    # The edges, and one round.
    assert _copies(folder).count("edges") - before == 2


def test_ngram_join_gives_the_driver_no_queries_without_rows(spark, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(30)]
    # Every fifth text has a copy with one word more.
    data = [(i, t) for i, t in enumerate(texts)] + [(100 + i, f"{t} more") for i, t in enumerate(texts) if i % 5 == 0]
    df = spark.createDataFrame(data, "doc_id long, text string")
    calls = []
    verified = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda *a: calls.append(1) or verified(*a))
    folder = shared_dir(spark)
    before = len(_copies(folder))
    spark.sparkContext.setJobGroup("driver's work", "")
    try:
        found = ngram_join.near_duplicates(df)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("driver's work"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert got == {i: i - 100 if i >= 100 else i for i, _ in data}
    # No key is left open, so nothing is paired, verified and joined into components a second time.
    assert len(calls) == 1 and len(_copies(folder)) - before <= 17 and jobs <= 80


def test_ngram_join_pairs_members_outside_their_hub(spark, monkeypatch):
    rng = random.Random(3)
    texts = {}
    for _ in range(4):
        words = [f"v{rng.randrange(500)}" for _ in range(25)]
        for _ in range(60):
            texts[len(texts)] = " ".join(words)
            words[rng.randrange(25)] = f"v{rng.randrange(500)}"
    calls = []
    verified = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda *a: calls.append(1) or verified(*a))
    found = ngram_join.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words=1, percent=80)
    assert {r.doc_id: r.component_id for r in found.collect()} == _labels(texts, 1, 80)[1]
    assert len(calls) == 2


def test_any_allotment_finds_similar_sets():
    rng = np.random.default_rng(2)
    for size in (10, 19, 40, 150):
        base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        need = ngram_join.most_different(2 * len(base)) + 1
        sets = [np.unique(rng.integers(0, 2**63, size, dtype=np.uint64)) for _ in range(25)]
        for segments in {-(-need // 2), need, need + 3}:
            units = ngram_join.allot(sets, 3, need, segments, 10.0)[1]
            assert units.sum() >= need
            for _ in range(20):
                d = int(rng.integers(0, need))
                gone = rng.choice(len(base), d // 2 + d % 2, replace=False)
                other = np.unique(np.concatenate([np.delete(base, gone), rng.integers(0, 2**63, d // 2, dtype=np.uint64)]))
                a, b = (set(np.concatenate(ngram_join.segment_keys(s, 3, units)).tolist()) for s in (base, other))
                assert a & b


def test_spare_segments_find_similar_sets():
    """Also where many segments are empty, and where one set has keys of empty segments and the other has none."""
    rng = np.random.default_rng(4)
    for size, need in ((10, 4), (40, 9), (40, 12), (150, 34), (30, 29)):
        for spare in {1, 3, ngram_join.spare_segments(need, size), need // 2}:
            for _ in range(150):
                base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
                gone, new = (int(x) for x in rng.multinomial(int(rng.integers(0, need)), [0.5, 0.5]))
                gone = min(gone, len(base) - 1)
                other = np.unique(np.concatenate([base[gone:][rng.permutation(len(base) - gone)], rng.integers(0, 2**63, new, dtype=np.uint64)]))
                a, b = (set(np.concatenate(ngram_join.segment_keys(s, 3, np.ones(need + spare, np.int64), spare)).tolist()) for s in (base, other))
                assert a & b


def test_page_text(spark):
    page = "<html><head><title>no</title><script>var a='<p>x</p>'</script></head><body><nav><a href=/>Menu</a></nav><article><h1>A &amp; B</h1><p>First   text\nhere.<p>Second <b>bold</b> text.<aside>Read on: <a href=/x>more</a></aside></article><div class='ad'>Buy this now, it is good.</div><footer>&copy; all rights</footer>"
    pages = spark.createDataFrame([(i, f"u{i}", page) for i in range(40)] + [(50, None, None), (51, "u", ""), (52, "u", "<" * 5000), (53, "u", "<div>" * 3000 + "x")], PAGES)
    got = {r.page_id: r for r in html.main_text(pages).collect()}
    assert got[0].text == "A & B\nFirst text here.\nSecond bold text." and got[0].n_chars == len(got[0].text)
    assert got[50].text == "" and got[51].text == "" and got[50].n_chars == 0 and len(got) == 44
    assert html.main_text(pages.limit(0)).count() == 0


def test_marginals_are_exact():
    """Messages against the sum over all labellings of a small tree."""
    nodes = html.parse("<div class=ad><p>Some text.</p></div><article><p>Long text of it.</p></article>")
    model = html.count([nodes], [html.semantic_labels(nodes)])
    total, content = 0.0, np.zeros(len(nodes))
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        log = 0.0
        for node, y in zip(nodes, labels):
            log += sum(model.features[f][y] for f in node.features if f in model.features)
            kind = html._KINDS["text" if node.text is not None else html._KIND.get(node.tag, "other")]
            log += model.pair[kind][labels[node.parent], y] if node.parent >= 0 else (0.0, -3.0)[y]
        total += np.exp(log)
        content += np.exp(log) * np.array(labels)
    assert np.allclose(model.marginals([nodes])[0], content / total)


def test_mix(spark):
    rng = random.Random(5)
    data = [(i, "w " * rng.randrange(0, 30), s) for i, s in enumerate(["a", "b", "c", None, "a", "a", "d"] * 60)] + [(9000, None, "b"), (None, "x y", "a"), (3, "again here", "a"), (3, "again here", "a")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.mix(docs).collect()
    assert len(out) == len(data)
    sums = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"] and (r.position is None) == (r.taken == 0)
        sums.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
    assert all(abs(t - goal) <= 0.5 and goal <= 2 * size for t, goal, size in sums.values())
    words = sum(v[2] for v in sums.values())
    assert abs(sum(v[1] for v in sums.values()) - 1.5 * words) < 1e-6
    assert collected(mixing.mix(docs.repartition(3))) == collected(mixing.mix(docs))
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("knots", mixing.SCHEDULES)
def test_schedule_is_inverted(spark, knots):
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))

    def spent(t):
        total = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            x = min(max(t - t0, 0.0), t1 - t0)
            total += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        return total / whole

    for q, t in spark.range(0, 21).select((F.col("id") / 20).alias("q"), mixing.time_at(F.col("id") / 20, knots)).collect():
        assert abs(spent(t) - q) < 1e-9


def _clean(texts, items):
    """Ids of the texts that hold no window of an item, by comparing all windows."""

    def windows(words, n):
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    found: dict[int, set] = {}
    for words in filter(None, map(split, items)):
        n = min(10, len(words))
        found.setdefault(n, set()).update(windows(words, n))
    return {i for i, t in texts.items() if not any(windows(split(t), n) & own for n, own in found.items())}


def test_pipeline(spark):
    """Each stage against a plain version of it on its own input."""
    docs = table(spark, SF, "documents")
    inputs, kept = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        inputs[name] = {r.doc_id: r for r in kept.collect()}
        made = stage(spark, kept, SF)
        assert made.columns == docs.columns, name
        kept = spark.createDataFrame(made.collect(), docs.schema)
    inputs["mix"] = {r.doc_id: r for r in kept.collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert collected(corpus_pipeline.run(spark, SF)) == collected(last)

    # Language: documents that stay are unchanged; those that go hold no letters or are unsure.
    assert all(inputs["language"][i] == r for i, r in inputs["near_duplicates"].items())
    lettered = {i for i, r in inputs["language"].items() if len(re.findall(r"[^\W\d_]", r.text or "")) > 100}
    assert len(lettered - set(inputs["near_duplicates"])) <= 0.02 * len(lettered)
    # Near duplicates: the smallest id of each group.
    before = {i: r.text for i, r in inputs["near_duplicates"].items()}
    label = _labels(before, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)[1]
    assert set(inputs["decontamination"]) == set(label.values()) < set(before)
    # Decontamination: documents without any window.
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    assert set(inputs["secrets"]) == _clean({i: r.text for i, r in inputs["decontamination"].items()}, items)
    # Secrets: all documents stay; every value found is replaced wherever it was found.
    before = spark.createDataFrame(list(inputs["secrets"].values()), docs.schema)
    plain = {i: r.text for i, r in inputs["secrets"].items()}
    for r in secret_scan.scan(before).where("secret").collect():
        plain[r.doc_id] = plain[r.doc_id].replace(r.value, "[SECRET]")
    assert {i: r.text for i, r in inputs["mix"].items()} == plain
    # Mix: the words taken come near the targets, no document is taken more than twice, positions never fall.
    taken = last.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 1 for r in taken)
    rows = last.collect()
    assert all(0 < r.taken <= 2 * r.size for r in rows)
    assert [r.position for r in rows] == sorted(r.position for r in rows)


def test_pipeline_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "the of and to in that is it was", "en", "s", 5), (2, "the of and to in that is it was", "en", "s", 5), (None, "ein und der die das ist nicht", "de", None, 5)], "doc_id long, text string, lang string, source string, score long")
    for empty in (False, True):
        kept = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, kept, SF)
            assert made.columns == docs.columns
            kept = spark.createDataFrame(made.collect(), docs.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
        assert last.count() <= (0 if empty else 2)
