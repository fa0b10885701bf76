"""Every operator and stage on nulls, empty and long texts, repeats, empty tables, clashes."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from salesmart.llm import (
    embedding_dedup,
    fingerprints,
    html_text,
    jaccard_join,
    language_id,
    mixing,
    packing,
    quality,
    queries,
    token_files,
    toxicity,
)
from salesmart.llm.tokens import default_tokenizer

# Extra columns are named like columns that the operators add.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars int, "
    "toxicity string, language string, quality int, class long, size long, taken long, "
    "`group` string, `range` int, row string, place int, position long"
)


@pytest.fixture(scope="module")
def documents(spark):
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    texts = [
        (1, "one two three four five six. seven eight nine ten", "en", "a"),
        (2, None, "en", "a"),
        (3, "", "fr", None),
        (4, " \n\t", None, "b"),
        (5, "!!! ... ###", "en", "b"),
        (6, long, "en", "c"),
        (7, "one two three four five six. seven eight nine ten", "en", "b"),
        (8, "deux mots", "fr", "é"),
        (8, "deux mots", "fr", "é"),  # the same row again
        (9, "same id", "fr", "a"),
        (9, "other text", "en", "a"),
        (None, "no id here", "en", "a"),
        (10, "\U0001d54fİ Σ́ mixed   signs", None, "b"),
        (11, "single", "en", "d"),
    ]
    extra = ("x", "y", 1, 2, 3, 4, "g", 5, "r", 6, 7)
    rows = [(i, t, lang, s, len(t or ""), *extra) for i, t, lang, s in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(i, i % 2, i % 2) for i in range(1, 12)] + [(None, 1, 1), (3, None, None)],
        "doc_id long, quality int, toxic int",
    )


def ids(df):
    return sorted((r[0] is None, r[0] or 0) for r in df.select("doc_id").collect())


def test_toxicity(documents, nothing, labels):
    model = toxicity.train(documents, labels)
    out = toxicity.toxicity(documents, model, "judged")
    assert out.columns == [*documents.columns, "judged"]
    assert ids(out) == ids(documents)
    empty = out.where("coalesce(trim(text), '') = ''").select("judged.*").collect()
    assert all(r.score == 0 and r.predicted == 0 and r.offending == [] for r in empty if not r.n_sentences)
    model = toxicity.train(nothing, labels.limit(0))
    assert toxicity.toxicity(nothing, model).count() == 0
    assert [r[0] for r in toxicity.toxicity(documents, model).select("toxicity.predicted").distinct().collect()] == [0]


def test_language(documents, nothing):
    model = language_id.train(documents, F.lit(True))
    out = language_id.identify(documents, model, "named")
    found = {(r.doc_id, r.text): r.named for r in out.collect()}
    for text in (None, "", " \n\t", "!!! ... ###"):
        assert [v.lang_pred for (_, t), v in found.items() if t == text] == ["und"]
    assert all(0 <= v.score <= 1 for v in found.values())
    assert ids(out) == ids(documents)
    model = language_id.train(nothing, F.lit(True))
    assert {r[0] for r in language_id.identify(documents, model).select("language.lang_pred").collect()} == {"und"}
    assert language_id.identify(nothing, model).count() == 0


def test_jaccard_join(documents, nothing):
    out = {}
    for r in jaccard_join.join(documents).collect():
        out.setdefault(r.doc_id, []).append((r.class_id, r.n_links, r.component_id, r.kept))
    assert out[1] == [(1, 1, 1, True)] and out[7] == [(1, 1, 1, False)]
    assert out[8] == [(8, 1, 8, True)] * 2
    assert out[None] == [(None, 0, None, True)]
    assert all(out[i] == [(i, 0, i, True)] for i in (2, 3, 4, 5, 6, 10, 11))
    assert out[9] == [(9, 0, 9, True)] * 2
    assert jaccard_join.join(nothing).count() == 0


def test_packing(documents, nothing):
    rows = packing.pack(documents, default_tokenizer()).collect()
    assert sorted({r.doc_id for r in rows} - {None}) == list(range(1, 12))
    assert [r.length for r in rows if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    assert len([r for r in rows if r.doc_id == 8]) == 2
    assert packing.pack(nothing, default_tokenizer()).count() == 0


def test_mixing(documents, nothing):
    out = mixing.taken(mixing.mix(documents))
    assert ids(out) == ids(documents)
    for r in out.collect():
        assert 0 <= r.taken <= 2 * r["size"]
    assert mixing.taken(mixing.mix(nothing)).count() == 0
    planned = mixing.mix(documents)
    mixed = mixing.mixed_documents(documents, planned)
    assert mixed.columns == documents.columns and mixed.schema == documents.schema
    words = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD_PATTERN)), F.lit(0))
    per_id = {r[0]: r[1] for r in mixed.groupBy("doc_id").agg(F.sum(words)).collect()}
    want = {r[0]: r[1] for r in mixing.taken(planned).groupBy("doc_id").agg(F.sum("taken")).collect()}
    assert {k: v for k, v in want.items() if v} == per_id


def test_token_files(documents, nothing):
    out = token_files.round_trip(documents, default_tokenizer()).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for none, i in ids(documents) if not none)
    at = 0
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at
        at += r.n_tokens
    assert token_files.round_trip(nothing, default_tokenizer()).count() == 0


def test_token_files_hold_documents_without_ids(spark, documents, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    large = spark.createDataFrame([(2**53 + 1, "x")], "doc_id long, text string")
    rows = documents.select("doc_id", "text").unionByName(large)
    rows = rows.unionByName(documents.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    rows.write.parquet(f"{folder}/documents.parquet")
    out = queries.op6_token_files(spark, folder).collect()
    assert ids(rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in out)
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id is None for r in sorted(out, key=lambda r: r.start)] == [False] * 14 + [True] * 15


def test_fingerprints(documents, nothing):
    out = fingerprints.edited(documents)
    assert ids(out) == ids(documents)
    rows = out.collect()
    prints = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[1] == prints[7] and len(prints[8]) == 1
    assert prints[2] == prints[3] == prints[4] == {fingerprints.BLANK * fingerprints.BINS}
    assert fingerprints.edited(nothing).count() == 0
    assert fingerprints.edited(documents.where("doc_id = 1")).first().near_next == 1


def test_quality(documents, nothing, labels):
    model = quality.train(documents, labels)
    out = quality.quality(documents, model, "judged")
    assert ids(out) == ids(documents)
    assert all(0 <= r.judged <= 1 for r in out.collect())
    assert quality.quality(nothing, quality.train(nothing, labels)).count() == 0


def test_html(spark):
    schema = "page_id long, url string, html string, text int, n_chars string, host int"
    long = "<article><p>" + "word " * 100_000 + "</article>"
    rows = [
        (1, "http://a.example/1", None, 1, "x", 2),
        (2, None, "", 1, "x", 2),
        (3, "http://a.example/2", "<article>kept</article>", 1, "x", 2),
        (3, "http://a.example/2", "<article>kept</article>", 1, "x", 2),
        (4, "not a url", "plain &amp;amp; text", 1, "x", 2),
        (None, "http://b.example", long, 1, "x", 2),
    ]
    out = html_text.extract(spark.createDataFrame(rows, schema))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    texts = sorted((r.page_id or 0, r.text) for r in out.collect())
    assert texts[1:] == [(1, ""), (2, ""), (3, "kept"), (3, "kept"), (4, "plain &amp; text")]
    assert len(texts[0][1]) == 499_999
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


def test_html_that_only_mentions_an_article(spark):
    menu = "<p>home about us contact news shop help terms jobs"
    mentions = ("<!-- <article> -->", "<script>'<main>'</script>", "<article></article>", "")
    rows = [(i, "http://a.example", f"{x}{menu}<p>{i} pages") for i, x in enumerate(mentions)]
    rows += [(9, "http://a.example", f"{menu}<article id='related'>text</article>")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted((r.page_id, r.text) for r in out.collect()) == [
        (0, "0 pages"), (1, "1 pages"), (2, "2 pages"), (3, "3 pages"), (9, "text"),
    ]


@pytest.mark.parametrize("together", [10**9, 10])
def test_html_is_told_by_marked_neighbours(spark, monkeypatch, together):
    """What a page without a mark shares with the marked pages of its host is boilerplate."""
    monkeypatch.setattr(html_text, "BYTES_TOGETHER", together)
    menu = "<p>home about us contact news shop help terms jobs"
    rows = [(i, "http://a.example", f"{menu}<article>story {i}</article>") for i in range(3)]
    rows += [(8, "http://a.example", f"{menu}<p>own text"), (9, "http://b.example", f"{menu}<p>b")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted((r.page_id, r.text) for r in out.collect()) == [
        (0, "story 0"), (1, "story 1"), (2, "story 2"), (8, "own text"),
        (9, "home about us contact news shop help terms jobs\n\nb"),
    ]


def test_html_of_a_large_host(spark, monkeypatch):
    """A host dealt out over tasks gives what one task gives."""
    random = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)] + ["é", "&amp;"]
    passages = [" ".join(random.choice(words, 12)) for _ in range(20)]
    rows = []
    for i in range(80):
        own = [" ".join(random.choice(words, n)) for n in (5, 30)]
        shared = [passages[k] for k in random.integers(0, 20, 2)]
        parts = ["home about us contact news shop help terms jobs", own[0], *shared, own[1]]
        page = "".join(f"<p>{part}</p>" for part in parts)
        rows += [(i, f"http://{'ab'[i % 5 == 0]}.example/{i}", page)] * (1 + (i % 9 == 0))
    rows += [(100, "http://a.example/x", ""), (101, "http://a.example/y", "<p>short"), (102, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)

    def texts():
        return sorted((r.page_id, r.text) for r in html_text.extract(df).collect())

    whole = texts()
    monkeypatch.setattr(html_text, "BYTES_TOGETHER", 500)
    assert texts() == whole
    monkeypatch.setattr(html_text, "BYTES_TOGETHER", 8_000)  # one host of two
    assert texts() == whole
    assert not any("home about" in text for _, text in whole)


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    schema = "vec_id long, embedding array<double>, label int, n_links string, class int"
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1),
        (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1),
        (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [], 1),
        (12, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (13, [1e300, 1e299], 1),
        (14, [-0.0, 1e-300], 3), (15, [0.0, 1e-300], 3),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    got = {}
    for r in embedding_dedup.near_copies(df).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(4, 1, True)]
    assert got[2] == got[13] == [(4, 1, False)]
    assert got[3] == [(4, 1, False)] * 2
    for alone in (4, 5, 6, 7, 8, 9, 10, 11, 12):
        assert got[alone] == [(0, alone, True)], alone
    assert got[None] == [(0, None, True)]
    assert got[14] == [(1, 14, True)] and got[15] == [(1, 14, False)]
    assert embedding_dedup.near_copies(df.limit(0)).count() == 0


def test_pipeline_rejects_languages_never_learned(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    random = np.random.default_rng(4)
    gibberish = " ".join("".join(random.choice(list("bcdfghjklmnpqrstvwxz"), 6)) for _ in range(500))
    finnish = "kaikki ihmiset syntyvät vapaina heille on annettu järki heidän toimittava toisiaan " * 20
    added = [(-1, gibberish, None), (-2, finnish, None), (-3, "все люди рождаются свободными " * 9, None)]
    both = docs.unionByName(spark.createDataFrame(added, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.drop_unknown_languages(spark, both, folder).collect()}
    worded = {r.doc_id for r in docs.where("text rlike '[a-z]'").collect()}
    assert kept.isdisjoint({-1, -2, -3}) and len(worded - kept) <= 0.01 * len(worded)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, documents, nothing, labels, tmp_path_factory, stage):
    folder = str(tmp_path_factory.mktemp("tables"))
    labels.write.parquet(f"{folder}/labels.parquet")
    function = dict(corpus_pipeline.STAGES)[stage]
    out = function(spark, documents, folder)
    rows = out.collect()
    if stage != "packing":
        assert out.columns == documents.columns
    assert function(spark, nothing, folder).count() == 0
    kept = {r.doc_id for r in rows}
    if stage == "toxicity":
        assert ids(out) == ids(documents)
    if stage == "language_id":
        assert kept.isdisjoint({2, 3, 4, 5}) and {1, 7, 8} <= kept
    if stage == "ngram_jaccard_join":
        assert 7 not in kept and len([r for r in rows if r.doc_id == 8]) == 1
        assert len([r for r in rows if r.doc_id == 9]) == 2 and None in kept
