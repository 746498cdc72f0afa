"""The stored suffix index when writers die or meet."""

from __future__ import annotations

import json

import pytest

from loomgraph.llm import suffix
from loomgraph.model import SchemaError
from loomgraph.versions import Conflict

DOCS = "doc_id long, text string"


def test_no_state_of_a_dead_writer_loses_the_index(spark, tmp_path):
    line = "a passage that stands in two batches of the index " * 6
    batch = lambda k: spark.createDataFrame([(k, f"{k} first {line} last {k}"), (k + 1, f"nothing {k}")], DOCS)
    path = f"file://{tmp_path}/index"
    index = suffix.Index(spark, path)
    index.add(batch(10))
    held = sorted(tmp_path.glob("index/manifest-*.json"))
    assert len(held) == 1
    # a batch that died behind its tables, and one inside its manifest
    spark.range(2).write.parquet(f"{path}/texts-dead")
    (tmp_path / "index" / "manifest-00000001.json").write_text(json.dumps(index.state)[:-9])
    again, other = suffix.Index(spark, path), suffix.Index(spark, path)
    assert again.state == index.state
    again.add(batch(20))
    found = {r.doc_id: len(r.spans) for r in suffix.removed(suffix.Index(spark, path)).collect()}
    assert found == {10: 1, 11: 0, 20: 1, 21: 0}
    with pytest.raises(Conflict):  # began before the other's batch
        other.add(batch(30))
    assert suffix.Index(spark, path).state == again.state
    with pytest.raises(SchemaError):
        again.add(spark.createDataFrame([(1, "x", 2)], DOCS + ", more int"))
    for m in tmp_path.glob("index/manifest-*.json"):
        m.unlink()
    with pytest.raises(SchemaError):  # data without a manifest aren't an empty index
        suffix.Index(spark, path)
