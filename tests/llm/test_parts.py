"""Parts of the operators by themselves."""

import cProfile
import io
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from salesmart.llm import (
    common,
    embedding_dedup,
    html_text,
    jaccard_join,
    language_id,
    mixing,
    packing,
    token_files,
    toxicity,
)
from salesmart.llm.common import batched, components, find_roots, running_start
from salesmart.llm.tokens import Encoder, default_tokenizer


def test_encoder_equals_the_tokenizer():
    encoder = Encoder(default_tokenizer())
    letters = list("abAB.,'!<|>%1²İΣéá̊ \n\t \x1c日x") + ["<|endoftext|>", "'LL ", " "]
    rng = random.Random(1)
    texts = ["", "   ", "It's DON'T 'S <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>"]
    texts += ["".join(rng.choices(letters, k=30)) for _ in range(1_500)]
    for text, ids in zip(texts, encoder.encode_all([t.encode() for t in texts])):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text


def test_encoder_forgets_without_harm(monkeypatch):
    monkeypatch.setattr("salesmart.llm.tokens.REMEMBERED", 4)
    encoder = Encoder(default_tokenizer())
    for turn in range(5):
        text = " ".join(f"word{chr(97 + (turn + i) % 9)}." for i in range(6))
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode_all([text.encode()])[0].tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_packs_every_length_once(lengths):
    counts = {n: lengths.count(n) for n in lengths}
    bins, seen = {}, {}
    for n, first, number, sequence, offset in packing.plan(counts, 64):
        assert seen.get(n, 0) == first
        seen[n] = first + number
        for i in range(number):
            bins.setdefault(sequence + i, []).append((offset, n))
    assert seen == counts
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(bins) <= 1.3 * sum(lengths) / 64 + 1 or max(lengths) > 32


def test_plan_finds_the_fullest_combination():
    for room in range(1, 60):
        left = {3: 2, 5: 1, 7: 4, 20: 1}
        sums = {0}
        for n, times in left.items():
            for _ in range(times):
                sums |= {s + n for s in sums}
        best = max(s for s in sums if s <= room)
        assert sum(packing._fullest(left, 0, room)) == best


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 1000])
def test_permutations_are_permutations(n):
    one, other = (mixing.permuted(np.arange(n), n, key) for key in (1, 2))
    assert sorted(one.tolist()) == list(range(n))
    assert n < 10 or one.tolist() != other.tolist()


def test_draws_add_up():
    slots = [1000, 10, 0, 5000]
    drawn = mixing.draw(slots, 16)
    assert drawn.sum(axis=0).tolist() == slots
    assert drawn.sum(axis=1).max() - drawn.sum(axis=1).min() <= 1
    assert (drawn == mixing.draw(slots, 16)).all()


def test_targets_stop_at_twice_the_size():
    assert mixing.targets([100, 100, 100]) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.targets([]) == []
    assert mixing.targets([0, 10]) == [0.0, 15.0]


def test_token_file_reads_single_frames_and_notices_damage():
    documents = [(i, np.arange(i, i + 50_000) % 60_000) for i in range(9)]
    sink = io.BytesIO()
    written = token_files.write_file(sink, documents, 2)
    data = sink.getvalue()
    assert len(written) == 3 and sum(n for _, n, _ in written) == 9
    got = list(token_files.read_frames(io.BytesIO(data), len(data), [1]))
    assert [(f, d) for f, d, _ in got] == [(1, 3), (1, 4), (1, 5)]
    assert all((ids == documents[d][1]).all() for _, d, ids in got)
    # Any zstandard reader can read the whole, frame after frame.
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
    assert len(whole.read()) == sum(entry[2] for entry in token_files.seek_table(io.BytesIO(data), len(data)))
    table = token_files.seek_table(io.BytesIO(data), len(data))
    wrong = data[:-9 - 12 * 3 + 8] + bytes(4) + data[-9 - 12 * 3 + 12 :]
    with pytest.raises(ValueError, match="checksum"):
        list(token_files.read_frames(io.BytesIO(wrong), len(wrong), [0]))
    assert table[0][0] == 0


def test_runs_reach_the_recall():
    assert jaccard_join.runs_needed(deepest=1, target=0.9) == 3  # 1 - e^-1 each
    assert jaccard_join.runs_needed(target=0.999) > jaccard_join.runs_needed(target=0.9)


def test_embedding_agrees_like_jaccard():
    rng, shares = np.random.default_rng(1), []
    for _ in range(200):
        both = np.unique(rng.integers(0, 2**63, 80).astype(np.uint64))
        x, y = (np.unique(np.r_[both, rng.integers(0, 2**63, 10).astype(np.uint64)]) for _ in "xy")
        shares.append((jaccard_join.embed(x) == jaccard_join.embed(y)).mean())
    assert np.mean(shares) == pytest.approx(0.8, abs=0.02)


def test_guests_miss_no_link():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2_000, 24))
    y = x + rng.normal(size=x.shape) * 0.3
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    linked = (x * y).sum(axis=1) >= 0.93
    assert linked.sum() > 200
    centres = embedding_dedup.centroids(x, 32)
    home, _ = embedding_dedup.guests(x, centres, 0.93)
    _, visits = embedding_dedup.guests(y, centres, 0.93)
    assert visits[np.arange(len(y)), home][linked].all()
    assert visits.mean() < 0.9


@pytest.mark.parametrize("dimensions, rank", [(64, 3), (768, 8)])
def test_guests_miss_no_link_of_low_rank(dimensions, rank):
    """Vectors of many components that vary in few directions, against all pairs."""
    rng = np.random.default_rng(2)
    few = rng.normal(size=(1_500, rank))
    few = np.concatenate([few, few + rng.normal(size=few.shape) * 0.3])
    units = few @ np.linalg.qr(rng.normal(size=(dimensions, rank)))[0].T
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    home, visits = embedding_dedup.guests(units, embedding_dedup.centroids(units, 25), 0.93)
    i, j = np.nonzero(units @ units.T >= 0.93)
    assert (home[i] != home[j]).sum() > 200
    assert visits[j, home[i]].all()


def test_shared_runs_are_covered():
    menu, foot = "home about contact news shop help terms jobs".split(), "all rights reserved by us since long ago".split()
    pages = [[*menu, f"own{i}", f"text{i}", *foot] for i in range(3)]
    got = html_text.covered(pages)
    for page, marks in zip(pages, got):
        assert [w for w, shared in zip(page, marks) if not shared] == page[8:10]
    # A run that one page repeats is its own, and so is a shorter shared one.
    assert not any(html_text.covered([["a"] * 40, ["b", "c"], ["b", "c"]])[0])
    assert not html_text.covered([["b", "c"], ["b", "c"]])[0].any()


def test_unmarked_pages_lose_what_their_host_repeats():
    menu = "home about us contact news shop help terms jobs"
    assert html_text.unique_text([[menu, "one page"], [menu, "two pages"], [menu, "two pages"]]) == [
        "one page", "two pages", "two pages",
    ]


@pytest.mark.parametrize(
    "page, article, others",
    [
        ("", [], []),
        ("a &lt;b&gt; c<br>d<p class='notice'>x</p><p>y", [], ["a <b> c d", "y"]),
        ("<nav>u<article><header><h1>T</h1></header><p>x</article><footer>f", ["T", "x"], []),
        ("<article><script>'</article>'</script>y<!-- z --></article>", ["y"], []),
        ("<main>m<aside>s</aside><form>f</form></main>", ["m"], []),
        ("<article>a<section class='comments'><p>c</section></article>", ["a"], []),
        ("1 < 2 &amp;amp; <b>b</b>old <img src='x", [], ["1 < 2 &amp; bold"]),
        ("<style>p{}</style><title>t</title>x", [], ["x"]),
        (
            "<p>o<article class='post category-social tag-newsletter'><h2 id='related-work'>R</h2>"
            "<h2 id='notice'>N</h2><p class='ad-free'>a<p class='notice'>b<div class='ad'>c</div>",
            ["R", "N", "a", "b"],
            ["o"],
        ),
        ("<div class='x Ad'>a</div><div id='menu'>b</div><main role='banner'>m</main>", ["m"], []),
        ("<article>a</article><ul class=comments><article class='comment'>c</ul>", ["a"], []),
        ("<!-- <article> --><script>'<main>'</script><p>x", [], ["x"]),
    ],
)
def test_markup(page, article, others):
    assert html_text.blocks(page) == (article, others)


def test_length_alone_is_not_toxic():
    model = toxicity.Model({"=vile": 14.0, "=kind": -1.0, "=odd": 1e-3}, toxicity.BIAS)
    clean = "1.2.3.4 a kind word\n" * 50_000
    for text in (clean, "version one. " * 200_000):
        score, predicted, n, found = toxicity.judge(text, model, {})
        assert (score, predicted, found) == (0, 0, []) and n >= 200_000
    assert toxicity.judge("odd. " * 200_000, model, {})[1] == 0
    one = toxicity.judge("a vile word.", model, {})
    among = toxicity.judge(clean + "a vile word." + clean, model, {})
    assert one[0] == pytest.approx(among[0]) and one[0] > 0.9 and among[1] == 1
    assert [span[:2] for span in among[3]] == [(len(clean), len(clean) + 11)]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    pairs += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = sorted({n for pair in pairs for n in pair})
    index = {n: i for i, n in enumerate(nodes)}
    left, right = (np.array([index[p[k]] for p in pairs]) for k in (0, 1))
    root = find_roots(len(nodes), left, right)
    want = {n: nodes[root[i]] for n, i in index.items()}
    alone = {a for a, b in pairs if a == b} - set(got)
    assert got == {n: c for n, c in want.items() if n not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_running_starts(spark, monkeypatch):
    monkeypatch.setattr("salesmart.llm.common.ROWS_PER_BUCKET", 7)
    rows = [("a" if i % 3 else "b", i, i % 5) for i in range(100)]
    out = running_start(spark.createDataFrame(rows, "g string, i long, n long"), "g", ["i"], "n", "begin")
    for group in "ab":
        at = 0
        for r in sorted((r for r in out.collect() if r.g == group), key=lambda r: (r.begin, r.begin + r.n)):
            assert r.begin == at
            at = r.begin + r.n


def test_numerals_are_no_letters(spark):
    documents = spark.createDataFrame(
        [(i, text, lang) for i in range(40) for text, lang in (("one two", "en"), ("deux mots", "fr"))],
        "doc_id long, text string, lang string",
    )
    model = language_id.train(documents, F.lit(True))
    guesser = language_id.Guesser(model)
    for text in ("½ ② ²", "Ⅷ", "123 456", "", None, "!?"):
        assert guesser.guess(text)[:2] == ("und", 0.0), text
    assert guesser.guess("½ one")[0] == "en"
    assert guesser.guess("deux Ⅷ")[0] == "fr"


def test_a_language_of_any_size_is_sampled(spark, monkeypatch):
    """A share of a thousandth of a millionth still is one."""
    documents = spark.range(2_000).selectExpr("id AS doc_id", "'text' AS text", "'en' AS lang")
    _, picked = language_id.sample(documents, F.lit(True))
    assert 1_000 < picked.count() < 1_400
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 1e-6)
    plan = language_id.sample(documents, F.lit(True))[1]._jdf.queryExecution().toString()
    assert str(int(1e-6 / 2_000 * 2**62)) in plan


def test_languages_are_learned_from_all_rows(spark, monkeypatch):
    """Counts and the usual share of known words are those of the whole table, not of a sample."""
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 10)
    documents = spark.range(3_000).selectExpr(
        "id AS doc_id", "concat('common, (w', id DIV 3, ') it''s') AS text", "'en' AS lang"
    )
    model = language_id.train(documents, F.lit(True))
    assert len(model.rows[0]) == 4 and model.logs[2][model.rows[2]["co"]].shape == (1,)
    found = language_id.identify(documents, model, "found")
    assert found.where("found.n_words = 4 AND found.n_known = 4").count() == 3_000
    poor = found.withColumn(
        "found", F.expr("if(doc_id % 20 = 0, named_struct('n_words', 4, 'n_known', 1), "
                        "named_struct('n_words', 4, 'n_known', 4))")
    )
    assert language_id.least_known(poor, F.lit(True), "found") == {"en": 0.25}


def test_batches_of_large_rows_are_small():
    rows = ((i, None if i % 2 else bytes(1_000)) for i in range(100))
    sizes = [len(frame) for frame in batched(rows, ["a", "b"], 1_000, 10_000)]
    assert sum(sizes) == 100 and max(sizes) == 20
    assert [len(f) for f in batched(((i, "x") for i in range(5)), ["a", "b"], 2)] == [2, 2, 1]


def test_words_between_white_space_count_as_words_of_the_text():
    text = "Don't ΑΣ ΑΣ. x½y Ⅷ e\u0301a\u00a0b\x1cC 12 İx \u0301q a_b"
    model = language_id.Model(["xx"], [{}] * 5, [np.zeros((0, 1))] * 5, np.zeros((0, 1), bool))
    words = language_id.WORD.findall(text)
    assert language_id.Guesser(model).guess(text)[2] == len(words)
    frames = iter([pd.DataFrame({"lang": ["xx"] * 2, "text": [text] * 2})])
    counted = pd.concat(language_id._counted_words(frames))
    lowered = language_id.WORD.findall(text.lower())
    assert dict(zip(counted["gram"], counted["times"])) == {
        word: 2 * lowered.count(word) for word in lowered
    }


@pytest.mark.parametrize(
    "page, article",
    [
        (
            "<main><h1>T</h1><p>Long story one.</p><p>Two.</p>"
            '<section><article class="teaser"><p>Other page</p></article></section></main>',
            ["T", "Long story one.", "Two."],
        ),
        (
            "<article><p>The story.</p></article>"
            '<div id="comments"><ol class="comment-list"><li class="comment">'
            '<article class="comment-body"><p>I agree with all of it.</p></article></li></ol></div>',
            ["The story."],
        ),
        (
            "<article><p>The story.</p></article>"
            '<aside class="related"><article class="card"><p>Another one</p></article></aside>',
            ["The story."],
        ),
        (
            "<nav><article><p>Menu card</p></article></nav><article><p>The story.</p></article>",
            ["The story."],
        ),
        ("<nav>menu <article><p>The story.</p></article>", ["The story."]),
        (
            "<main><p>Short.</p><article><p>The whole long story.</p></article></main>",
            ["The whole long story."],
        ),
    ],
)
def test_teasers_and_comments_are_no_articles(page, article):
    assert html_text.blocks(page)[0] == article


@pytest.mark.parametrize(
    "name",
    ["ad-slot", "cookie-banner", "comment-list", "related-posts", "c-ad", "social_share",
     "newsletter__signup", "article-sidebar", "lead x-promo"],
)
@pytest.mark.parametrize("container", ["div", "section", "ul"])
def test_compound_names_tell_containers(name, container):
    block = f'<{container} class="{name}"><p>Buy this <div>now</div></p></{container}>'
    page = f"<article><p>One.</p>{block}<p>Two.</p></article>"
    assert html_text.blocks(page) == (["One.", "Two."], [])


@pytest.mark.parametrize(
    "name", ["no-sidebar", "has-comments", "sidebar-layout", "menu-of-the-day", "badge-row", "-", "ad2"]
)
def test_other_names_tell_nothing(name):
    for opened in (f'<div class="{name}">', '<div id="ad-slot">', '<table class="share-prices">'):
        kind = opened[1:].split()[0]
        inside = "<tr><td>Two.</td></tr>" if kind == "table" else "<p>Two.</p>"
        page = f"<article><p>One.</p>{opened}{inside}</{kind}></article>"
        assert html_text.blocks(page)[0] == ["One.", "Two."]
    for kept in ("h2", "p", "article", "main"):
        page = f'<article><p>One.</p><{kept} class="related-work">Two.</{kept}></article>'
        assert html_text.blocks(page)[0] == ["One.", "Two."]


@pytest.mark.parametrize(
    "text, words",
    [
        ("हिन्दी भाषा", ["हिन्दी", "भाषा"]),
        ("cafe\u0301 9 nai\u0308ve", ["cafe\u0301", "nai\u0308ve"]),
        ("x2y a_b \u0301 \u0301a", ["x", "y", "a", "b", "a"]),
        ("", []),
    ],
)
def test_marks_belong_to_their_words(text, words):
    assert language_id.WORD.findall(text) == words


def test_shards_grow_with_the_slots(spark, monkeypatch):
    rows = [(i, "a b c d " * 40, "xyz"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "SHARDS", 2)
    monkeypatch.setattr(mixing, "SLOTS_PER_SHARD", 20)
    planned = mixing.mix(docs)
    slots = planned.pieces.select("position", "slot", "shard").distinct()
    assert slots.select("shard").distinct().count() == -(-planned.sources["slots"].sum() // 20) > 2
    assert slots.count() == planned.sources["slots"].sum()


def test_words_are_looked_up_and_their_ngrams_counted_together():
    """New words cost a few lookups each, not a dozen calls of numpy; n-grams none of their own."""
    letters, rng = "abcdefghijklmnopqrstéß語𐐀", random.Random(5)
    words = list({"".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(20_000)})
    frame = pd.DataFrame({"lang": "xx", "gram": words, "times": range(1, len(words) + 1)})
    one_by_one = {
        (n, gram): times
        for n in range(1, language_id.LONGEST_NGRAM + 1)
        for gram, times in _ngram_times(frame, n).items()
    }
    with cProfile.Profile() as calls:
        counted = pd.concat(language_id._counted_ngrams(iter([frame])))
    assert dict(zip(zip(counted["n"], counted["gram"]), counted["times"])) == one_by_one
    assert _calls(calls) < 10 * len(words)

    known = counted.iloc[::2]
    model = language_id.model_of(["xx", "yy"], pd.concat([known, known.iloc[::3].assign(lang="yy")]))
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    with cProfile.Profile() as calls:
        found = language_id.Guesser(model).guesses(texts)
    assert _calls(calls) < 22 * len(words)
    assert found == [language_id.Guesser(model).guess(text) for text in texts]


def _ngram_times(frame, n):
    times = Counter()
    for word, number in zip(frame["gram"], frame["times"]):
        for gram in language_id.ngrams(word, n):
            times[gram] += number
    return times


def _calls(profile):
    return sum(entry.callcount for entry in profile.getstats())


@pytest.mark.parametrize("most", [2**27, 1])
def test_rows_perhaps_among_keys(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BITS", most)
    keys = spark.range(0, 100_000, 50).selectExpr("id * id - 7 AS some")
    for kind in ("long", "string"):
        rows = spark.range(100_000).selectExpr(f"CAST(id * id - 7 AS {kind}) AS doc_id", "'x' AS text")
        found, rest = common.perhaps_among(rows, keys.selectExpr(f"CAST(some AS {kind})"), "doc_id")
        assert found.columns == rest.columns == rows.columns
        assert found.unionByName(rest).exceptAll(rows).isEmpty() and rest.count() == 100_000 - found.count()
        ids = {row.doc_id for row in found.collect()}
        assert ids >= {row[0] for row in keys.selectExpr(f"CAST(some AS {kind})").collect()}
        assert len(ids) == found.count() and (most == 1 or len(ids) < 5_000)
    none = keys.where("false").selectExpr("'' AS some")
    assert common.perhaps_among(rows, none, "doc_id")[0].isEmpty()


def test_texts_without_candidates_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Nor does the embedding of all classes meet the longer paths of a few."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(1_500)]
    same = " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=2_000))
    texts += [same + f" {i}" for i in range(jaccard_join.SMALL_BUCKET + 50)]  # a large bucket
    documents = common.stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "docs")
    asked, held = [], []
    plain, stored = jaccard_join.perhaps_among, jaccard_join.stored

    def perhaps_among(*args):
        asked.append(plain(*args)[0].count())
        return plain(*args)

    def noted(df, name):
        out = stored(df, name)
        if name == "minima":
            held.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "perhaps_among", perhaps_among)
    monkeypatch.setattr(jaccard_join, "stored", noted)
    out = jaccard_join.join(documents)
    assert asked and asked[0] < len(texts) / 2
    assert held[0] == len(texts) and len(held) > 1 and max(held[1:]) < len(texts) / 2
    links = {row.doc_id: row.n_links for row in out.collect()}
    alike = jaccard_join.SMALL_BUCKET + 50
    assert [links[i] for i in range(len(texts) - alike, len(texts))] == [alike - 1] * alike


def test_documents_that_stay_are_not_shuffled(spark, with_settings, tmp_path):
    """Only those that may go meet the ids that do; repeated and null ids as before."""
    with_settings(spark__sql__autoBroadcastJoinThreshold="-1")
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(400)]
    rows = [(i, text) for i, text in enumerate(texts)] + [(1_000 + i, texts[i]) for i in range(40)]
    # 1,000 repeats its id with a text of its own; 7 both; nulls stay.
    rows += [(1_000, "a text of its own"), (7, texts[7]), (None, texts[0]), (None, texts[0])]
    docs = common.stored(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    kept = [(i, text) for i, text in rows if i is None or i <= 1_000]
    del kept[kept.index((7, texts[7]))]
    want = Counter(kept)
    want[None, texts[0]] = 1  # as dropDuplicates has it once an id is repeated
    assert Counter(map(tuple, left.collect())) == want
    docs = docs.where("doc_id < 400 OR doc_id > 1000")
    left = corpus_pipeline.drop_near_copies(spark, docs.distinct(), "")
    assert "Union" in left._jdf.queryExecution().toString()


def test_mixing_sends_only_cut_texts_to_python(spark):
    docs = spark.createDataFrame(
        [(i, " ".join(f"w{i}x{j}" for j in range(150)), "web", 0) for i in range(40)],
        "doc_id long, text string, source string, n_chars int",
    )
    mixed = mixing.mixed_documents(docs, mixing.mix(docs))
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"_words_of\(CASE WHEN", plan), plan
    # The first pass takes all of the one source, the second the other half of the mix.
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = [(r.doc_id, r.text) for r in mixed.collect()]
    assert {i for i, text in found if text == texts[i]} == set(texts)
    parts = [(i, text) for i, text in found if text != texts[i]]
    assert parts and all(run in texts[i] for i, text in parts for run in text.split("\n"))


def test_stored_sends_long_texts_to_python_in_small_batches(spark):
    texts = spark.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 1_000_000).alias("text"))

    def sizes(frames):
        for frame in frames:
            yield pd.DataFrame({"size": [int(frame["text"].str.len().sum())]})

    found = [r.size for r in common.stored(texts.mapInPandas(sizes, "size long"), "sizes").collect()]
    assert sum(found) == 40_000_000
    assert max(found) <= common.BYTES_AT_A_TIME + 1_000_000
