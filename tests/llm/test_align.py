"""The alignment against one text at a time."""

from __future__ import annotations

import collections
import hashlib

import public_tokenizers
import pytest

from loomgraph.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """Whole texts by the libraries, ends by running sums, all links one by one."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    tk = Tokenizer.from_file(A)
    tk.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    from tokenizers.pre_tokenizers import ByteLevel as Pre

    letters = {}
    for x in range(256):  # the byte that each letter of the vocabulary stands for
        c = bytes([x]).decode("latin-1")
        own = Pre(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0]
        letters[own[-1]] = c.encode()[-1]
    assert ByteLevel and len(letters) >= 189
    size = lambda i: len(tk.id_to_token(i))
    whole, docs = [], collections.Counter()
    for _, text in rows:
        tokens = None
        if text:
            data = (" " + text).encode()
            a, b = tk.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            pieces = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(pieces) == data and sum(map(size, a)) == len(data):
                ends_a, ends_b, at = [], [], 0
                for i in a:
                    at += size(i)
                    ends_a.append(at)
                at = 0
                for p in pieces:
                    at += len(p)
                    ends_b.append(at)
                cuts = sorted(set(ends_a) & set(ends_b))
                groups, last = [], 0
                for c in cuts:
                    groups.append(([i for i, e in zip(a, ends_a) if last < e <= c], [i for i, e in zip(b, ends_b) if last < e <= c]))
                    last = c
                tokens = groups
                docs.update({(x, y) for g in groups for x in g[0] for y in g[1]})
        whole.append(tokens)
    most = collections.defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = []
    for (d, _), groups in zip(rows, whole):
        if groups is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((d, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(docs[k] == most[k[0]] for k in links), sum(docs[k] for k in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(str, out))


def result(df):
    return sorted(str((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect())


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n b", "\n", "\t a▁b c", "x ▁ y", "▁", "<|endoftext|> a <s> </s> <unk> <0x41>", "naïve café 日本語 日 \U0001f600 \U0001f468‍\U0001f469",
    "a　b  c \u0085 d​ e", "it's we'll 123 4567 8.9 ... !!! a.b", "word " * 50 + "end", "x" * 3000, "日本" * 900, "\x00 nul \x1c sep \x1fb", "tab\tin side \r\n lines\nmore", "é ﬁ Ａ", "a" * 40 + " " + "ab" * 700, "the the the", "The the",
]


@pytest.mark.parametrize("bundle", [1 << 20, 300])
def test_same_as_whole_texts(spark, bundle):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "the the the"), (None, "the end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out, pairs = align.align(df, A, B, bundle=bundle)
    assert result(out) == plain(rows)
    assert pairs.where("best").count() > 50 and pairs.agg({"n_docs": "max"}).first()[0] >= 3
    assert align.align(df.limit(0), A, B)[0].count() == 0


def test_units_are_the_text():
    for t in ODD:
        assert " ".join(align.units(t or "")) == (t or "")


def test_query_on_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.queries()["op12_alignment"](spark, sf)) == plain(rows)


def test_less_is_shuffled_than_the_texts(spark):
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size, before = docs.selectExpr("sum(octet_length(text))").first()[0], shuffled()
    out, _ = align.align(docs, A, B)
    assert out.count() == docs.count()
    assert shuffled() - before < size
