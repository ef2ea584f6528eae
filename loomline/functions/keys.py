"""Hash keys: the split of threads and the key of a label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.config import DEFAULT, Settings


def split_side(thread_id: Column, s: Settings = DEFAULT) -> Column:
    """train or val by the first 32 bits of the id's SHA-256, so a whole thread lies on one side."""
    share = F.conv(F.substring(F.sha2(thread_id, 256), 1, 8), 16, 10).cast("double") / float(0xFFFFFFFF)
    return F.when(share < s.val_fraction, "val").otherwise("train")


def label_key(thread_id: Column, target: Column) -> Column:
    return F.concat(thread_id, F.lit(":"), F.substring(F.sha1(target), 1, 12))
