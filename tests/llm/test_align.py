"""Groups, links and counts against the two libraries and loops over all pairs."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from commentflow.llm import align, queries
from tokenizers import Tokenizer

TEXTS = [
    "Hello  world\n\tÉç 𓀀 日本", "a\x00b", "x" * 300, " " * 40 + "y" + " " * 15, "it's they'll  don't 12345 ...!?",
    "日" * 3 + "한국어 कखग", "\n\n   indented   code(x, y)\r\n", "<|endoftext|> <s> </s> <unk> <0x41>",
    "▁x ▁▁ y", "� tail ", " nbsp em", "é ñ", "word " * 20000, "🙂🙃 👩‍👩‍👧", " ", "  ",
]


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(queries.BYTE_TOKENS)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    symbols = align.byte_symbols()

    def a(text):
        ids = one.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(symbols[c] for c in one.id_to_token(i))) for i in ids]

    def b(text):
        return [
            (i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode())
            for i in two.encode(text) for p in [two.id_to_piece(i)]
        ]

    return a, b


def plain(libraries, rows):
    """Expected rows, by loops over all tokens of a document."""
    made, holders = [], Counter()
    for doc, text in rows:
        sides = [f(text) if text else [] for f in libraries]
        if text and any(b"".join(t for _, t in s) != (" " + text).encode() for s in sides):
            sides = [[], []]
        spans = []
        for side in sides:
            at, out = 0, []
            for i, raw in side:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        a, b = spans
        links, k = [], 0
        for i, s, e in a:
            while k and b[k - 1][2] > s:
                k -= 1
            while k < len(b) and b[k][1] < e:
                if b[k][2] > s:
                    links.append((i, b[k][0]))
                k += 1
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        at = [0, 0]
        for high in ends:
            sides_of = []
            for n, side in enumerate(spans):
                ids = []
                while at[n] < len(side) and side[at[n]][2] <= high:
                    ids.append(str(side[at[n]][0]))
                    at[n] += 1
                sides_of.append(",".join(ids))
            groups.append("|".join(sides_of))
            low = high
        assert not a or low == a[-1][2]
        made.append((doc, len(a), len(b), len(groups), links, ";".join(groups)))
        holders.update(set(links))
    top = {}
    for (i, _), n in holders.items():
        top[i] = max(top.get(i, 0), n)
    return [
        (doc, na, nb, ng, len(links), sum(holders[p] == top[p[0]] for p in links), sum(holders[p] for p in links), text)
        for doc, na, nb, ng, links, text in made
    ], holders, top


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS chunk", "2 AS id", "3 AS pairs", "4 AS groups")
    return align.align(df.repartition(3), queries.BYTE_TOKENS, queries.PIECES, **options)


def compare(spark, libraries, rows):
    expected, _, _ = plain(libraries, rows)
    got = [tuple(r) for r in run(spark, rows).select(COLUMNS).collect()]
    assert Counter(got) == Counter(expected)
    hashed = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in expected]
    assert Counter(tuple(r) for r in run(spark, rows, printed="sha256").select(COLUMNS).collect()) == Counter(hashed)


def test_odd_texts(spark, libraries):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, "", *TEXTS[:3]])]
    compare(spark, libraries, [*rows, (None, "same id"), (None, "same id"), (0, "Hello again")])


def test_documents(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    compare(spark, libraries, [tuple(d) for d in docs][:120])


def test_empty(spark, libraries):
    assert run(spark, []).count() == 0
    compare(spark, libraries, [(1, None), (2, "")])


def test_pair_counts(spark, libraries):
    rows = [(i, f"common words and rare{i % 3}") for i in range(30)] + [(99, "common")]
    _, holders, top = plain(libraries, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = align.pair_counts(df, queries.BYTE_TOKENS, queries.PIECES).collect()
    assert {(r.a, r.b): (r.n_docs, r.best) for r in got} == {p: (n, n == top[p[0]]) for p, n in holders.items()}
    assert len(got) == len(holders)


def test_many_chunks(libraries, monkeypatch, spark):
    """Texts of several chunks; a chunk ends as soon as it has a slice of text."""
    rows = [(i, ("Lorem ipsum dolor " + str(i % 7)) * 40000) for i in range(40)]
    got = run(spark, rows).select(COLUMNS).collect()
    few, _, _ = plain(libraries, rows[:7])
    by_kind = {r[0] % 7: r for r in few}
    assert len(got) == 40
    for r in got:
        assert tuple(r)[1:5] == by_kind[r.doc_id % 7][1:5] and r.groups == by_kind[r.doc_id % 7][7]
    assert sum(r.n_best for r in got) <= sum(r.n_links for r in got)


def test_blanks_beyond_the_matcher(libraries):
    with open(queries.BYTE_TOKENS, encoding="utf-8") as file:
        tool = align.ByteTokens(file.read())
    for text in ("\n" * 1_000_000 + "x", " " * 700_000 + "a b"):
        assert tool.ids(" " + text).tolist() == [i for i, _ in libraries[0](text)]


def test_other_vocabulary():
    with pytest.raises(ValueError), open("/opt/tokenizers/word_bpe_49k.json", encoding="utf-8") as file:
        align.ByteTokens(file.read())
