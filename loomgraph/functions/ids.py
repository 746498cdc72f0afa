"""Identity of nodes: a content hash of the label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id(label: Column) -> Column:
    """60 bits of the label's SHA-256. 32 bits collide among some ten thousand labels, 60 do not below a billion."""
    return F.conv(F.substring(F.sha2(label, 256), 1, 15), 16, 10).cast("bigint")


def cache_key(stage: Column, inputs: Column, config: Column) -> Column:
    """Key of a memoised stage: a hash over length-prefixed parts. inputs: an array of strings."""
    part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(part(stage), F.lit("|"), F.array_join(F.transform(inputs, part), ""), F.lit("|"), part(config)), 256)
