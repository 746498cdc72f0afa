"""The operators for training data against brute force, exact round trips and held-out accuracy."""

import base64
import collections
import hashlib
import io
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import ann, jpeg, mixing, near, packing, queries, sharding, simhash, suffix, tokens, warc
from loomgraph.llm import rows as rows_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, source string"


def frame(spark, rows):
    """With columns whose names operators might use themselves."""
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(7) for c in ("n_bytes", "size", "row", "fp", "slot", "length", "score", "spans", "media", "bytes", "cols", "__row", "__spans", "__size", "__source", "__text", "row__", "__key")})


ODD = [(1, None, None), (2, "", "a"), (3, "  ", "a"), (None, "hello there world", "b"), (5, "hello there world", "b"), (5, "hello there world", "b"), (6, "x " * 5000, None), (7, "é<|endoftext|> \n\n it's 12,5.", "")]


# --- tokens and packing --------------------------------------------------------

PIECES = st.lists(st.sampled_from(["a", " ", "  ", "\n", " the", " hello", "é", "12", "!!", ".", ", ", "<|endoftext|>", " ½", "…", "'s", " x"]), max_size=120)


@settings(max_examples=60, deadline=None)
@given(PIECES, st.integers(12, 60))
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_spliced_ids_are_those_of_the_whole(name, parts, chunk):
    tok, text = tokens.load(public_tokenizers.path(name)), "".join(parts)
    assert tokens.encode_spliced(tok, text, chunk, 4).tolist() == list(tok.ids([text])[0])


@settings(max_examples=40, deadline=None)
@given(st.lists(PIECES, max_size=6))
def test_remembered_words_give_the_librarys_ids(many):
    texts = ["".join(p) for p in many]
    tok, memo = tokens.load(VOCABULARY), tokens.memo_of(VOCABULARY)
    want = tok.ids(texts) if texts else []
    if texts:
        assert [x.tolist() for x in memo.encode(texts)] == want
        assert memo.counts(texts).tolist() == [len(x) for x in want]


def thue_morse(n, a, b):
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return "".join((a, b)[x] for x in out[:n])


def test_words_that_hashes_confuse_and_long_words():
    tok, memo = tokens.load(VOCABULARY), tokens.memo_of(VOCABULARY)
    pairs = [(thue_morse(n, a, b), thue_morse(n, b, a)) for n in (32, 64, 128, 1024, 2048) for a, b in ("ab", "xq", "0a")]
    pairs += [("abcdefgh" + "x" * k + "y", "abcdefgh" + "x" * k + "z") for k in (0, 7, 8, 54, 55, 56, 57, 500)]
    pairs += [("é" * 31 + "a", "é" * 31 + "b"), ("w" * 64, "w" * 65), ("q" * 70_000, "q" * 70_001)]
    texts = [f"start abcdefgh{x} end, {x}. {x}" for pair in pairs for x in pair] + ["one " + "u" * 80 + "<|endoftext|> two"]
    for _ in range(2):
        assert [x.tolist() for x in memo.encode(texts)] == tok.ids(texts)
        assert memo.counts(texts).tolist() == [len(x) for x in tok.ids(texts)]
    # a hash that confuses everything
    other = tokens.WordMemo(tok)
    other.of_byte = np.ones(256, np.uint64)
    assert [x.tolist() for x in other.encode(texts)] == tok.ids(texts)


def test_token_counts(spark):
    got = tokens.count_tokens(frame(spark, ODD), VOCABULARY, chunk=500, overlap=20).collect()
    tok = tokens.load(VOCABULARY)
    want = collections.Counter((k, len((t or "").encode()), len(tok.ids([t or ""])[0])) for k, t, _ in ODD)
    assert collections.Counter(map(tuple, got)) == want
    assert tokens.count_tokens(frame(spark, ODD).limit(0), VOCABULARY).count() == 0


def brute_cost(at, penalty, width):
    best = [0.0] + [math.inf] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            n = at[j] - at[i]
            if n <= width:
                pad = packing.SHORT if n < width and n & (n - 1) == 0 and n >= packing.LEAST_SHORT else width - n
                best[j] = min(best[j], best[i] + pad + penalty[j])
    return best[-1]


@pytest.mark.parametrize("seed", range(5))
def test_cuts_are_optimal(seed):
    rng = np.random.default_rng(seed)
    at = np.cumsum(np.concatenate([[0], rng.integers(1, 90, 60)]))
    penalty = rng.integers(0, 9, 61).astype(float)
    penalty[[0, -1]] = 0
    cuts = [0, *packing.plan_cuts(at, penalty, 256)]
    cost = 0.0
    for i, j in zip(cuts, cuts[1:]):
        n = at[j] - at[i]
        cost += penalty[j] + (packing.SHORT if n < 256 and n & (n - 1) == 0 and n >= packing.LEAST_SHORT else 256 - n)
    assert cost == brute_cost(at.tolist(), penalty.tolist(), 256)


def check_pieces(rows, docs, width=1024):
    tok = tokens.load(VOCABULARY)
    want = collections.defaultdict(list)
    for k, t in docs:
        want[k].append([*tok.ids([t or ""])[0], 0])
    windows = collections.defaultdict(list)
    covered = collections.Counter()
    for r in rows:
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in want[r.doc_id])
        covered[r.doc_id] += r.length
        windows[r.sequence_id].append((r.offset, r.length))
    assert covered == {k: sum(map(len, v)) for k, v in want.items()}
    padding = 0
    for w in windows.values():
        end = 0
        for a, n in sorted(w):
            assert a == end
            end += n
        assert end <= width
        padding += 0 if end & (end - 1) == 0 else width - end
    return padding / sum(covered.values())


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    rows = queries.packing.pack(docs, VOCABULARY).collect()
    assert check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()]) < 0.02
    check_pieces(packing.pack(frame(spark, ODD), VOCABULARY).collect(), [(k, t) for k, t, _ in ODD])
    assert packing.pack(frame(spark, ODD).limit(0), VOCABULARY).count() == 0


def test_packing_keeps_the_order_of_files(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, "word " * rng.randint(1, 900), "s") for k in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(9)
    df.orderBy("doc_id").write.parquet(f"{tmp_path}/sorted")
    spark.conf.set("spark.sql.files.openCostInBytes", 1024)
    read = spark.read.parquet(f"{tmp_path}/sorted")
    got = packing.pack(read, VOCABULARY, order=packing.file_order(read)).collect()
    spark.conf.unset("spark.sql.files.openCostInBytes")
    check_pieces(got, [(k, t) for k, t, _ in rows])
    ids = [r.doc_id for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))]
    assert ids == sorted(ids)
    assert packing.file_order(spark.range(3)) is None


def test_a_document_longer_than_a_block():
    packer = packing.Packer(VOCABULARY, 1024, 0, 0)
    ids = np.arange(packing.BLOCK * 2 + 100, dtype=np.uint32) % 50_000
    rows = [*packer.add("k", ids), *packer.flush()]
    assert sum(r[2] for r in rows) == len(ids) + 1 and {r[4] for r in rows} == {len(ids) + 1}
    assert sorted(r[1] for r in rows)[0] == 0


# --- sharding -------------------------------------------------------------------


def test_table_is_even_and_stable():
    names = [f"s{k}" for k in range(10)]
    table = sharding.fill_table(names, 1009)
    load = collections.Counter(table)
    assert max(load.values()) - min(load.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(names[a] != names[b] for a, b in zip(table, fewer) if names[a] != "s9")
    assert moved < 0.25 * 1009
    # the definition, slot by slot
    order = [[(sharding._number(s, "offset") % 1009 + j * (sharding._number(s, "step") % 1008 + 1)) % 1009 for j in range(1009)] for s in names]
    brute, at, k = [-1] * 1009, [0] * 10, 0
    while -1 in brute:
        while brute[order[k][at[k]]] >= 0:
            at[k] += 1
        brute[order[k][at[k]]], k = k, (k + 1) % 10
    assert brute == table
    with pytest.raises(ValueError):
        sharding.fill_table(names, 1000)


def test_sharding_is_native_and_whole(spark):
    df = sharding.shard(frame(spark, ODD), "doc_id", ["a", "b", "c"], 101)
    assert df.count() == len(ODD) and set(frame(spark, ODD).columns) <= set(df.columns)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert df.where("doc_id = 5").select("shard").distinct().count() == 1
    assert sharding.shard(frame(spark, ODD).limit(0), "doc_id", ["a"], 101).count() == 0


# --- mixing ---------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, open_, out = sum(sizes.values()), list(names), {}
    while True:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        out |= {s: 3 * sizes[s] for s in over}
        open_ = [s for s in open_ if s not in over]


def test_mixing(spark):
    rng = random.Random(1)
    rows = ODD + [(k, "w " * rng.randint(0, 30), rng.choice(["a", "b", "", None, "zz", "tiny"] if k % 50 else ["rare"])) for k in range(100, 700)]
    got = mixing.schedule(frame(spark, rows)).collect()
    words = lambda t: len((t or "").encode().split())
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    per = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        s = next(s for s in sizes if sizes[s] == r.source_size and math.isclose(want[s], r.target, rel_tol=1e-9, abs_tol=1e-9))
        per[s] = per.get(s, 0) + r.taken
    assert all(abs(per[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.schedule(frame(spark, rows)).collect()))
    mixed = mixing.mix(frame(spark, rows)).collect()
    assert sum(words(r.text) for r in mixed) == sum(r.taken for r in got)
    assert mixing.schedule(frame(spark, ODD).limit(0)).count() == 0


# --- WARC -----------------------------------------------------------------------

PAGES = [(1, "http://a/ b\r\n", "x" * 300_000), (2, None, None), (3, "é", ""), (None, "u", "q"), (5, "u", "q"), (5, "u", "q"), (6, "u", "ü<p>")]


def brute_pages(rows):
    by = collections.defaultdict(list)
    for k, _, h in rows:
        by[h or ""].append(k)
    out = collections.Counter()
    for k, _, h in rows:
        data = (h or "").encode()
        top = max((x for x in by[h or ""] if x is not None), default=None)
        out[k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if k == top else "revisit", None if k == top else top] += 1
    return out


def test_archive_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").unionByName(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    got = collections.Counter(map(tuple, warc.round_trip(pages.withColumn("payload", F.lit(1)).withColumn("sha", F.lit(1))).collect()))
    assert got == brute_pages([(r.page_id, r.url, r.html) for r in pages.collect()])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_filters_skip_payloads(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.archive_pages(pages, f"file://{tmp_path}/w")
    reader = warc.WarcReader({"path": f"file://{tmp_path}/w"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 1)]))
    assert len(rest) == 1 and {r[0] for p in reader.partitions() for r in reader.read(p)} == {"revisit"}
    slim = warc.read_archives(spark, f"file://{tmp_path}/w", payload=False).where("record_type = 'response'").collect()
    assert all(r.payload is None for r in slim) and max(r.payload_bytes for r in slim) == 300_000


class Counted:
    """A file that counts what is read."""

    def __init__(self, data):
        self.f, self.bytes, self.requests = io.BytesIO(data), 0, 0

    def size(self):
        return len(self.f.getbuffer())

    def seek(self, at):
        self.f.seek(at)

    def read(self, n):
        out = self.f.read(n)
        self.bytes, self.requests = self.bytes + len(out), self.requests + 1
        return out


@pytest.mark.parametrize("packed", [True, False])
def test_small_records_share_requests_and_large_ones_are_skipped(packed):
    rng = random.Random(1)
    bodies = [rng.randbytes(rng.choice([10, 900, 1300, 3000])) for _ in range(2000)]
    wrap = warc.member if packed else bytes
    own = Counted(b"".join(wrap(warc.record("response", f"<urn:page:{k}>", "http://x", b, "AA", None)) for k, b in enumerate(bodies)))
    assert [x(True).partition(b"\r\n\r\n")[2] for _, _, x in warc.records(own, packed)] == bodies
    assert own.bytes <= own.size() and own.requests < 12
    own = Counted(own.f.getvalue())
    assert sum(1 for _ in warc.records(own, packed)) == 2000 and own.bytes <= own.size()
    large = Counted(b"".join(wrap(warc.record("response", f"<urn:page:{k}>", "http://x", rng.randbytes(3_000_000), "AA", None)) for k in range(5)))
    assert [h["warc-record-id"] for h, _, _ in warc.records(large, packed)] == [f"<urn:page:{k}>" for k in range(5)]
    assert large.bytes < 0.2 * large.size()


def test_archives_of_others(tmp_path):
    import gzip

    data = warc.record("response", "<urn:page:1>", "http://x", b"hello", "AA", None)
    bare = data.replace(b"Content-Length: 5\r\n", b"").replace(b"Content-Length: %d" % len(data.split(b"\r\n\r\n", 1)[1][:-4]), b"Content-Length: %d" % (len(data.split(b"\r\n\r\n", 1)[1]) - 4 - 19))
    other = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/plain\r\nContent-Length: 9\r\n\r\n\r\n\r\nplain\r\n\r\n"
    long = b"HTTP/1.1 200 OK\r\nX: " + b"y" * 50_000 + b"\r\n\r\nhello"
    long = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(long) + long + b"\r\n\r\n"
    files = {"a.warc": data * 2 + bare + other, "b.warc.gz": gzip.compress(data) * 3, "c.warc.gz": gzip.compress(data + other + data) + gzip.compress(long), "d.warc": long + data[:-4]}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "torn.txt").write_bytes(b"?")
    reader = warc.WarcReader({"path": str(tmp_path)})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    plain = b"\r\n\r\nplain"
    assert [r[6] for r in rows] == [b"hello", b"hello", b"hello", plain] + [b"hello"] * 3 + [b"hello", plain, b"hello", b"hello"] + [b"hello", b"hello"]
    assert all(r[5] == len(r[6]) for r in rows)
    slim = warc.WarcReader({"path": str(tmp_path), "payload": "false"})
    assert [(r[5], r[6]) for p in slim.partitions() for r in slim.read(p)] == [(r[5], None) for r in rows]


def test_damaged_archives(tmp_path):
    data = warc.member(warc.record("response", "<urn:page:1>", "http://x", b"hello" * 9000, "AA", None))
    for name, raw in (("a", data * 2 + data[:200]), ("b", data + b"junk" * 50), ("c", data[:60] + b"\0" * 40 + data[100:])):
        (tmp_path / f"{name}.warc.gz").write_bytes(raw)
        reader = warc.WarcReader({"path": str(tmp_path)})
        with pytest.raises(ValueError, match=f"{name}.warc.gz is damaged"):
            list(reader.read(warc.Archive(f"{name}.warc.gz")))
    reader = warc.WarcReader({"path": str(tmp_path), "damaged": "skip"})
    assert [len(list(reader.read(p))) for p in reader.partitions()] == [2, 1, 0]


# --- SimHash ----------------------------------------------------------------------


def union_find(keys, pairs):
    top = {k: k for k in keys}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("distance,parts", [(3, 3), (3, 4), (2, 2), (5, 4)])
def test_links_are_exactly_the_near_pairs(spark, distance, parts):
    rng = random.Random(distance)
    fps = [rng.getrandbits(64) for _ in range(40)] + [0, 3, (1 << 64) - 1]
    for _ in range(150):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        fps.append(x)
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    want = {(max(a, b), min(a, b)) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    assert {tuple(r) for r in simhash.links(df, distance, parts).collect()} == want and len(want) > 50


def test_groups(spark):
    from xxhash import xxh64_intdigest

    rng = random.Random(3)
    base = [" ".join(rng.choice("ab cd ef gh ij kl mn".split()) for _ in range(400)) for _ in range(4)]
    rows = ODD + [(100 + k, f"{base[k % 4]} end{k // 8}".upper() if k % 2 else f"{base[k % 4]} end{k // 8}", "s") for k in range(40)]
    fp = {}
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxh64_intdigest(s, 42) for s in sh]
        fp[t] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    keys = set(fp.values())
    root = union_find(keys, [(a, b) for a in keys for b in keys if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[root[fp[t]]] = min(least.get(root[fp[t]], k), k)
    want = collections.Counter((k, f"{fp[t]:016x}", least.get(root[fp[t]])) for k, t, _ in rows)
    assert collections.Counter(map(tuple, simhash.groups(frame(spark, rows)).collect())) == want
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == len({root[x] for x in keys})
    assert simhash.groups(frame(spark, ODD).limit(0)).count() == 0


# --- nearest neighbours -------------------------------------------------------------


def test_nearest(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    bad = spark.createDataFrame([(100, None), (200_000, [0.0] * 64), (300_000, [float("nan")] * 64), (None, [1.0] * 64), (400_000, []), (500_000, [None] * 64), (600_001, [1.0, 2.0])], "vec_id long, embedding array<float>")
    v = v.select("vec_id", "embedding").where("vec_id <> 100").unionByName(bad)
    v = v.unionByName(v.where("vec_id % 100 = 0 OR vec_id % 7 = 0"))  # ids that repeat
    con.register("given", v.toPandas())
    want = sorted(con.sql(ann.nearest_sql().replace("FROM embeddings", "FROM given")).fetchall())
    for bytes_ in (ann.GROUP_BYTES, 40 * 64 * 8):  # one group, and groups of about 40 vectors
        got = sorted(map(tuple, ann.nearest(v, group_bytes=bytes_).collect()))
        assert got == want
    assert ann.nearest(v.limit(0)).count() == 0


def test_recall_over_many_groups(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20_000, 40))
    x[:8000] = x[rng.integers(0, 40, 8000)] + 0.2 * x[:8000]  # clusters
    x = np.round(x, 3)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(20_000), "embedding": list(x)}))
    got = collections.defaultdict(set)
    for r in ann.nearest(df, every=200, group_bytes=900 * 40 * 8).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 20_000, 200):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert len(got) == 100 and hits >= 0.99 * 1000


def test_bounds_hold_and_ties_go_to_smaller_ids():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 100)) + 2
    x[:600] = x[:600] * 0.05 + x[7]  # a cluster
    x[500:1500] = x[500]
    centre = x.mean(axis=0)
    codes, size, ideal = ann.encode(x, centre, ann.rotation(100))
    at = np.arange(3000)
    rows, _ = ann.search_block(at, at, x, codes, size, ideal, [(500, 500, x[500])], centre, 10)
    assert [r[2] for r in rows] == list(range(501, 511)) and all(r[3] == 0 for r in rows)
    rows, reranked = ann.search_block(at, at, x, codes, size, ideal, [(7, 7, x[7])], centre, 10)
    d = np.sqrt(((x - x[7]) ** 2).sum(axis=1))
    middle, error = ann.estimates(codes, size, ideal, (x[7] - centre) @ ann.rotation(100).T)
    assert (np.abs(d**2 - middle) <= error).mean() > 0.995
    d[7] = np.inf
    assert {r[2] for r in rows} == set(np.lexsort((at, d))[:10].tolist())
    assert reranked < 1600  # the cluster; codes rule out most of what lies elsewhere


# --- suffix arrays --------------------------------------------------------------------


def brute_repeats(texts, length=200):
    seen = collections.defaultdict(list)
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]].append((k, i))
    cover = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                cover[k][i : i + length] = b"\1" * length
    out = []
    for t, c in zip(texts, cover):
        kept = bytes(x for x, m in zip(t, c) if not m)
        out.append((len(t), sum(c), sum(1 for i, m in enumerate(c) if m and not (i and c[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limits", [{}, {"batch": 16}, {"pairs": 2}, {"pairs": 2, "hot_from": 3}])
def test_repeats(spark, limits):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh é.") for _ in range(n))
    shared = [word(rng.randint(150, 700)) for _ in range(10)]
    rows = list(ODD) + [(1000, "a" * 1000, ""), (1001, "ab" * 300, ""), (1004, "x" * 199, ""), (1006, "y" * 200, "")]
    for k in range(90):
        parts = [rng.choice([word(rng.randint(0, 300)), rng.choice(shared), rng.choice(shared)[: rng.randint(50, 400)]]) for _ in range(rng.randint(0, 6))]
        rows.append((2000 + k, "".join(parts), "s"))
    got = suffix.digest(suffix.remove_repeats(frame(spark, rows), **limits)).collect()
    want = collections.Counter((k, *x) for (k, _, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t, _ in rows])))
    assert collections.Counter(map(tuple, got)) == want


def test_batches_one_by_one_equal_one_run(spark, tmp_path):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh é.") for _ in range(n))
    shared = [word(rng.randint(210, 500)) for _ in range(6)]
    rows = [(k, "".join(rng.choice([word(rng.randint(0, 200)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 99) :]]) for _ in range(3)), "s") for k in range(42)]
    path = f"file://{tmp_path}/index"
    for at in range(0, 42, 6):
        index = suffix.Index(spark, path)  # what is stored is all that is kept between batches
        index.add(frame(spark, rows[at : at + 6]))
    levels = index.state["levels"]
    assert len(levels) <= math.log2(7) + 1 and all(a["suffixes"] > 2 * b["suffixes"] for a, b in zip(levels, levels[1:]))
    assert sorted(x.name for x in (tmp_path / "index").glob("level-*")) == sorted(x["name"] for x in levels)
    got = suffix.digest(suffix.removed(suffix.Index(spark, path))).collect()
    want = collections.Counter((k, *x) for (k, _, _), x in zip(rows, brute_repeats([t.encode() for _, t, _ in rows])))
    assert collections.Counter(map(tuple, got)) == want
    with pytest.raises(ValueError):
        suffix.Index(spark, path, 100)


def test_splits_may_change_between_stages(spark, sf, tmp_path, monkeypatch):
    """What the loss of executors does to a scan."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    docs.write.parquet(f"{tmp_path}/docs")
    rows = docs.collect()
    before = suffix.materialise
    count = iter(range(10**6))

    def shaken(*args):
        out = before(*args)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", 1 + next(count) % 3)
        return out

    for module in (suffix, simhash, near, rows_of):
        monkeypatch.setattr(module, "materialise", shaken)
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", 1024)
        read = spark.read.parquet(f"{tmp_path}/docs")
        got = suffix.digest(suffix.remove_repeats(read)).collect()
        want = collections.Counter((r.doc_id, *x) for r, x in zip(rows, brute_repeats([(r.text or "").encode() for r in rows])))
        assert collections.Counter(map(tuple, got)) == want
        kept = {r.doc_id for r in simhash.keep_one(read).collect()}
        groups = collections.defaultdict(set)
        for r in simhash.groups(docs).collect():
            groups[r.component_id].add(r.doc_id)
        assert kept == {min(x) for x in groups.values()}
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_levels_merge_geometrically():
    rng = np.random.default_rng(1)
    family = suffix.Family()
    for k in range(20):
        data = [rng.integers(97, 123, 300, dtype=np.uint8).tobytes() for _ in range(8)]
        family.add(data, np.full(8, 50), np.arange(8) + 8 * k)
    assert len(family.levels) <= 6 and sum(map(len, family.levels)) == 160


def test_stripping_keeps_columns(spark):
    df = frame(spark, [*ODD, (8, "z" * 400 + "tail", "s"), (9, "z" * 400, "s")]).withColumn("n_chars", F.length("text"))
    rows = suffix.strip_repeats(df)
    assert rows.columns == df.columns
    got = {r.doc_id: r for r in rows.collect()}
    assert 9 not in got and 8 in got and got[8].n_chars == len(got[8].text) < 10
    assert suffix.strip_repeats(df.limit(0)).count() == 0


# --- JPEG -----------------------------------------------------------------------------


@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(max_size=1500), min_size=1, max_size=5))
def test_stored_bytes_come_back(many):
    data = [jpeg.padded(x) for x in many]
    back = jpeg.decode_many(jpeg.encode_many(data))
    assert [b"".join(p.tobytes() for _, p in own) for own in back] == data


def test_large_payloads():
    data = [jpeg.padded(random.Random(1).randbytes(n)) for n in (250_000, 4_900_000)]
    back = jpeg.decode_many(jpeg.encode_many(data))
    assert [len(own) for own in back] == [1, 2] and [b"".join(p.tobytes() for _, p in own) for own in back] == data


AC_COUNTS, AC_SYMBOLS = (0, 2, 2) + (0,) * 13, (0x00, 0x01, 0xF0, 0x12)


class Bits:
    """Entropy-coded blocks, written bit by bit."""

    def __init__(self):
        self.bits, self.last = "", [0, 0, 0]

    def block(self, part, value, pairs=()):
        dc = {s: (c, n) for s, c, n in jpeg.canonical(jpeg.DC_COUNTS, jpeg.DC_SYMBOLS)}
        ac = {s: (c, n) for s, c, n in jpeg.canonical(AC_COUNTS, AC_SYMBOLS)}
        put = lambda code, n: f"{code:0{n}b}" if n else ""
        diff, self.last[part] = int(value) - self.last[part], int(value)
        s = abs(diff).bit_length()
        self.bits += put(*dc[s]) + put(diff if diff >= 0 else diff + (1 << s) - 1, s)
        for run, v in pairs:
            t = abs(v).bit_length()
            self.bits += put(*ac[run << 4 | t]) + put(v if v >= 0 else v + (1 << t) - 1, t)
        self.bits += put(*ac[0])

    def scan(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")


def jpeg_tables(sof, quantiser=8):
    seg = jpeg._segment
    data = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([quantiser]) * 64) + seg(0xC0, sof)
    return data + seg(0xC4, b"\0" + bytes(jpeg.DC_COUNTS) + bytes(range(9))) + seg(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS))


def test_foreign_jpeg():
    """Two components, subsampled, with AC coefficients and without restart markers."""
    want, out, rng = np.zeros((2, 4), int), Bits(), random.Random(5)
    for m in range(2):
        for v in range(2):
            for h in range(2):
                want[v, 2 * m + h] = rng.randint(-100, 100)
                out.block(0, want[v, 2 * m + h], [(0, 1), (1, 2)] if h else [])
        out.block(1, rng.randint(-50, 50))
    sos = jpeg._segment(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0]))
    data = jpeg_tables(bytes([8, 0, 16, 0, 32, 2, 1, 0x22, 0, 2, 0x11, 0])) + sos + out.scan() + b"\xff\xd9"
    # bytes behind the image, fill bytes before markers, a second image
    for own, n in ((data, 1), (data + b"junk", 1), (data + b"\0\xff\xd8", 1), (data.replace(b"\xff\xda", b"\xff\xff\xff\xda").replace(b"\xff\xc4", b"\xff\xff\xc4"), 1), (data[:-2] + b"\xff\xff\xff\xd9", 1), (data + b"\xff" + data, 2)):
        frames = jpeg.decode_many([own])[0]
        assert len(frames) == n
        for frame_, pixels in frames:
            assert (frame_.width, frame_.height) == (32, 16) and (pixels == want + 128).all()
    for bad in (b"not an image", data[:40], data.replace(b"\xff\xc0", b"\xff\xc2"), b""):
        with pytest.raises(ValueError):
            jpeg.decode_many([bad])


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 0, 2)])
def test_components_in_scans_of_their_own(order):
    """The luminance thumbnail, whatever the order of the scans; tables may change between them."""
    rng, seg = random.Random(2), jpeg._segment
    sof = bytes([8, 0, 16, 0, 24, 3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
    data, values = jpeg_tables(sof), {}
    for k, part in enumerate(order):
        out = Bits()
        values[part] = [rng.randint(-100, 100) for _ in range(6)]
        for v in values[part]:
            out.block(0, v)
        if k == 2:  # the same codes again
            data += seg(0xC4, b"\0" + bytes(jpeg.DC_COUNTS) + bytes(range(9)))
        data += seg(0xDA, bytes([1, part + 1, 0, 0, 63, 0])) + out.scan()
    (frame_, pixels), = jpeg.decode_many([data + b"\xff\xd9"])[0]
    assert (pixels == np.array(values[0]).reshape(2, 3) + 128).all()


def brute_hashes(p):
    """Means of fields, value by value."""
    rows, cols = len(p), len(p[0])

    def field(i, j, n, m):
        ys = [y for y in range(rows) if i * rows // n <= y < ((i + 1) * rows // n if i + 1 < n else rows)]
        xs = [x for x in range(cols) if j * cols // m <= x < ((j + 1) * cols // m if j + 1 < m else cols)]
        return sum(int(p[y][x]) for y in ys for x in xs) / (len(ys) * len(xs))

    f = [field(i, j, 8, 8) for i in range(8) for j in range(8)]
    mean = sum(f) / 64
    g = [[field(i, j, 8, 9) for j in range(9)] for i in range(8)]
    bits = lambda own: int("".join("01"[bool(x)] for x in own), 2)
    return bits(x > mean for x in f), bits(g[i][j + 1] > g[i][j] for i in range(8) for j in range(8))


def test_features_equal_a_plain_version(spark):
    rng = random.Random(8)
    rows = [(k, "".join(rng.choice("abc xyz~é") for _ in range(rng.randint(1, 4000))), "s") for k in range(12)]
    got = {r.doc_id: r.feature for r in jpeg.describe(jpeg.store(frame(spark, rows))).collect()}
    for k, t, _ in rows:
        payload = jpeg.padded(t.encode())
        p = [payload[i : i + 24] for i in range(0, len(payload), 24)]
        a, d = brute_hashes(p)
        assert got[k] == f"{24 * 8}x{len(p) * 8}:{a:016x}:{d:016x}"


def test_null_and_damaged_media_give_rows(spark):
    good = jpeg.encode_many([jpeg.padded(b"hello")])[0]
    df = spark.createDataFrame([(1, None), (2, b""), (3, good), (4, good[:-20]), (5, b"x" * 50)], "k long, media binary").withColumn("error", F.lit(1)).withColumn("feature", F.lit(2))
    got = {r.k: r for r in jpeg.describe(df).collect()}
    assert got[3].error is None and got[3].feature and got[3].payload_sha256 == hashlib.sha256(jpeg.padded(b"hello")).hexdigest()
    assert all(got[k].error and got[k].feature is None and got[k].payload_bytes is None for k in (1, 2, 4, 5))
    assert got[1].media_bytes is None and got[5].media_bytes == 50


def test_media(spark):
    got = jpeg.describe(jpeg.store(frame(spark, ODD))).collect()
    assert len(got) == len(ODD)
    by = collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got)
    pad = [(k, (t or "").encode(), jpeg.padded((t or "").encode())) for k, t, _ in ODD]
    assert by == collections.Counter((k, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for k, t, p in pad)
    assert jpeg.describe(jpeg.store(frame(spark, ODD).limit(0))).count() == 0


# --- registered queries ---------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    from tests.test_queries import compare

    compare(spark, sf, queries.queries()[name], queries.oracle_sql()[name])


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline

    docs = queries.read(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        assert all(r.n_chars == len(r.text) for r in seen[name])
    scored = {r.doc_id: r.predicted for r in queries.op7_toxicity(spark, sf).collect()}
    assert {r.doc_id for r in seen["toxicity"]} == {k for k, p in scored.items() if not p}
    assert {r.doc_id for r in seen["simhash"]} == {r.doc_id for r in near.keep_one(spark.read.parquet(f"{tmp_path}/toxicity")).collect()}
    rows = [(r.doc_id, r.text) for r in seen["simhash"]]
    want = {k: x[0] - x[1] for (k, _), x in zip(rows, brute_repeats([t.encode() for _, t in rows]))}
    assert all(len(r.text.encode()) <= want[r.doc_id] and (r.text == texts[r.doc_id] or want[r.doc_id] < len(texts[r.doc_id].encode())) for r in seen["suffix_array"])
    taken = {r.doc_id: r.taken for r in mixing.schedule(spark.read.parquet(f"{tmp_path}/suffix_array")).collect()}
    words = collections.Counter()
    for r in seen["mixing"]:
        words[r.doc_id] += len(r.text.encode().split())
    assert words == {k: n for k, n in taken.items() if n}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    tok = tokens.load(VOCABULARY)
    assert sum(r.length for r in pieces) == sum(len(tok.ids([r.text])[0]) + 1 for r in seen["mixing"])
    empty = queries.read(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
