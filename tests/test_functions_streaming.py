"""Scalar functions on odd inputs, guards, and the stream."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as tx
from loomgraph.functions import urls
from loomgraph.streaming.watch import ArcWatch, debounce


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, tx.display_safe, "a‮b\x01c") == "a\\u{202E}b\\u{0001}c"
    assert one(spark, tx.display_safe, "ok é") == "ok é"
    assert one(spark, tx.sanitize_label, "a\x00b" + "é" * 300) == "ab" + "é" * 254
    assert one(spark, tx.question_label, "  \x01 ") == "<unnamed>"
    assert one(spark, tx.file_stem, "a/b c\x01") == "a_b_c" and one(spark, tx.file_stem, "\x01") == "_"
    assert one(spark, tx.slug, "Ünï  Code—x!") == "ünï_code_x"
    assert one(spark, tx.method_id, "__") == "__" and one(spark, tx.stem_lower, "a/B.c.py") == "b.c"
    assert one(spark, tx.crate_of, "crates/x/y.rs") == "x" and one(spark, tx.crate_of, "/y.rs") == "root"


def test_url_guards(spark):
    for bad in ("http://127.0.0.1/", "https://[::1]/x", "http://10.1.2.3", "http://u@192.168.0.1:80/", "http://[::ffff:10.0.0.1]/", "http://169.254.1.1", "http://100.64.0.1\\@ok.org", "ftp://x", "http://localhost:80/"):
        assert urls.url_blocked(bad), bad
    assert urls.url_blocked("https://example.org/x") is None and urls.url_blocked("http://8.8.8.8:80/") is None
    assert urls.confine("/a/b", "c/../d") == "/a/b/d"
    with pytest.raises(ValueError):
        urls.confine("/a/b", "../c")
    assert one(spark, urls.url_violation, "http://a b") == "unsafe character" and one(spark, urls.url_violation, "https://") == "no host"
    assert one(spark, urls.url_violation, "http://" + "a" * 2100) == "too long" and one(spark, urls.url_violation, "https://a/b") is None
    assert one(spark, urls.url_extension, "https://example.com") == "rs"


def test_arc_watch(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    rows = lambda ids: spark.createDataFrame([(k, None, k, "view") for k in ids], schema)
    seen = []
    watch = ArcWatch(spark, lambda df, n: seen.append(sorted((r.producer, r.change) for r in df.collect())), f"file://{tmp_path}/watch")
    for ids in ((1, 2), (2, 3)):
        rows(ids).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        watch.start(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), once=True).awaitTermination()
    assert seen == [[("user:1", "healed"), ("user:2", "healed")], [("user:1", "severed"), ("user:3", "healed")]]


def test_debounce_in_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = debounce(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e"), "1 hour", late="1 minute")
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("bursts").collect()}
    assert got and got <= {tuple(r) for r in debounce(events, "1 hour").collect()}
