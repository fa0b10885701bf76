"""Token alignment against a plain reading of its contract."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from salesmart.llm import queries, token_alignment

TABLES = "/root/testdata/sf0.001"
COLUMNS = [
    "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
]
NO_TOKENS = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def sides():
    a_path, b_path = token_alignment.default_paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    return a, b


def _spans(sides, text):
    """(id, begin, end) in bytes for both sides, None if bytes differ."""
    a, b = sides
    letters = {letter: byte for letter, byte in token_alignment._letter_bytes().items()}
    out = []
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
    for tokens in (
        [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a_ids],
        [
            (i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
            for i, p in pieces
        ],
    ):
        spans, at = [], 0
        for i, token in tokens:
            spans.append((i, at, at + len(token)))
            at += len(token)
        if b"".join(token for _, token in tokens) != (" " + text).encode():
            return None
        out.append(spans)
    return out


def _plain(sides, documents):
    aligned = []
    for doc_id, text in documents:
        spans = _spans(sides, text) if text else None
        if not spans:
            aligned.append((doc_id, None))
            continue
        a, b = spans
        ends = sorted({s[2] for s in a} & {s[2] for s in b})
        groups, begin = [], 0
        for end in ends:
            groups.append(
                tuple(
                    ",".join(str(i) for i, low, high in side if begin <= low and high <= end)
                    for side in (a, b)
                )
            )
            begin = end
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        text = ";".join("|".join(group) for group in groups)
        aligned.append((doc_id, (len(a), len(b), len(groups), links, text)))
    counts = Counter(pair for _, found in aligned if found for pair in set(found[3]))
    most = Counter()
    for (first, _), n in counts.items():
        most[first] = max(most[first], n)
    rows = []
    for doc_id, found in aligned:
        if found is None:
            rows.append((doc_id, *NO_TOKENS))
            continue
        n_a, n_b, n_groups, links, text = found
        rows.append(
            (doc_id, n_a, n_b, n_groups, len(links),
             sum(counts[pair] == most[pair[0]] for pair in links),
             sum(counts[pair] for pair in links), hashlib.sha256(text.encode()).hexdigest())
        )
    return rows


def _sorted(rows):
    return sorted(map(tuple, rows), key=lambda row: (row[0] is None, row))


ODD = [
    (1, "plain words, and 1234 numbers!  two spaces\n\n\tand a tab"),
    (2, None),
    (3, ""),
    (4, " "),
    (5, "<|endoftext|> and <s> </s> <unk> <0x41> are text"),
    (6, "a▁mark that side B reads as a space"),
    (7, "हिन्दी 中文 \U0001f600é ½ ﬁ \u0085  x"),
    (8, "plain words, and 1234 numbers!  two spaces\n\n\tand a tab"),
    (8, "plain words, and 1234 numbers!  two spaces\n\n\tand a tab"),
    (None, "no id"),
    (9, "nul \x00 and �"),
    (10, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 3),
    (11, " begins with a space and ends with one "),
]


@pytest.mark.parametrize("hot_pairs", [1 << 19, 20, 0])
def test_odd_texts(spark, sides, hot_pairs):
    rows = [(i, t, 1, "x", "y") for i, t in ODD]
    schema = "doc_id long, text string, row int, pair string, times string"
    documents = spark.createDataFrame(rows, schema).repartition(2)
    found = token_alignment.digests(documents, hot_pairs=hot_pairs)
    assert found.columns[:4] == ["doc_id", "row", "pair", "times"]
    assert _sorted(found.select(COLUMNS).collect()) == _sorted(_plain(sides, ODD))


def test_names_that_clash_stay(spark):
    schema = "doc_id long, text string, n_a string, n_best string, links int"
    documents = spark.createDataFrame([(1, "some text", "mine", "mine", 7)], schema)
    row = token_alignment.digests(documents).first().asDict()
    assert (row["n_a"], row["n_best"], row["links"]) == ("mine", "mine", 7)
    assert row["n_a_"] == 2 and row["n_best_"] == row["n_links"]


def test_no_documents(spark):
    documents = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.digests(documents).collect() == []
    assert token_alignment.groups(documents).collect() == []


def test_segments_change_nothing(sides, monkeypatch):
    draw = random.Random(4)
    words = ["word", "  two", "\n", "1,234.5", "don't", "é中", "<|endoftext|>", "x" * 40]
    texts = [" ".join(draw.choice(words) for _ in range(n)) for n in (0, 1, 50, 400)]
    tool = token_alignment.Aligner(*token_alignment.default_paths())
    assert tool.divisible
    whole = [token_alignment._digest_of(d) for d in tool.documents(texts, True)]
    monkeypatch.setattr(token_alignment, "SEGMENT", 30)
    monkeypatch.setattr(token_alignment, "PORTION", 100)
    assert len(list(tool.segments(texts[-1]))) > 20
    cut = [token_alignment._digest_of(d) for d in tool.documents(texts, True)]
    for one, other in zip(whole, cut):
        assert one[:5] == other[:5]
        assert one[5].tolist() == other[5].tolist() and one[6].tolist() == other[6].tolist()
    for text, document in zip(texts, tool.documents(texts, False)):
        a, b, a_ends, b_ends = token_alignment._groups_of(document)
        if text:
            assert a.tolist() == sides[0].encode(" " + text, add_special_tokens=False).ids
            assert b.tolist() == sides[1].encode(text)
            assert len(a_ends) == len(b_ends) and (a_ends[-1], b_ends[-1]) == (len(a), len(b))


def test_same_ids_as_the_tokenizers_library(sides):
    tool = token_alignment.Aligner(*token_alignment.default_paths())
    draw = random.Random(6)
    parts = ["the", "ing", " ", "  ", "'s", "\u0085", "\x00", "é", "1", "!!", "\n", "<|", "中", "ि"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 20))) for _ in range(5_000)]
    theirs = [e.ids for e in sides[0].encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in tool.a.encode(texts)] == theirs


def test_groups_of_documents(spark):
    documents = spark.createDataFrame([("x", "New York, NY")], "id string, text string")
    row = token_alignment.groups(documents).first()
    assert (row["id"], row["a_ends"][-1], row["b_ends"][-1]) == ("x", len(row["a_ids"]), len(row["b_ids"]))


def test_query_on_whole_table(spark, sides):
    found = queries.queries()["op11_token_alignment"](spark, TABLES)
    documents = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text")
    documents = [tuple(row) for row in documents.collect()]
    # Long texts take a quadratic time here; their links follow from the numbers of tokens.
    theirs = {row[0]: row for row in _plain(sides, [d for d in documents if len(d[1] or "") < 4_000])}
    ours = {row["doc_id"]: tuple(row[c] for c in COLUMNS) for row in found.collect()}
    assert len(ours) == len(documents)
    for doc_id, row in theirs.items():
        assert (ours[doc_id][:5], ours[doc_id][7]) == (row[:5], row[7])
    for _, n_a, n_b, n_groups, n_links, n_best, count_sum, _ in ours.values():
        assert n_links == n_a + n_b - n_groups and n_best <= n_links <= count_sum
