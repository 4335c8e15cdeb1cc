"""Exact substring deduplication: bytes of strings that occur elsewhere too.

Texts are parsed into overlapping phrases (see phrases.py). The dictionary is
the distinct phrases, the parse the sequence of them in each text; both stay
tables. A SPAN-byte string's equals all lie in phrases with the same trigger:

- A trigger that the corpus has once rules out all strings of its phrase.
- A phrase that the dictionary has twice or more repeats as a whole.
- What is left are distinct phrases that share a trigger, about four for each
  edit of a copy. The strings of each of these, once per dictionary entry, are
  hashed and equal pairs of trigger's and string's hash (64 bits each) counted.
  All strings of a phrase hold its trigger, so what repeats of it is one stretch,
  from first to last. A trigger in a great many contexts has its strings counted
  before they are shuffled, and the counts dealt back by a salt.

There is no suffix array, neither of the dictionary nor of the parse: to remove
repeats it takes which strings are equal and not their order, and equal hashes
meet by a plain hash shuffle where an order needs the strings themselves. The
price is that two different strings with one hash would count as equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_limit, join_one_row_per_key, keep_ids, materialize, ship_package, text_buffer, text_pieces
from .phrases import K, phrases, prefix_sums, substring_hashes

SPAN = 200
#: Bytes of text that are parsed at a time; a longer text is parsed in pieces.
PIECE = 512 << 10


def _parse(span: int):
    schema = pa.schema([("rid", pa.int64()), ("place", pa.int64()), ("h", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_pieces(batches, "text", PIECE):
            data, offsets = text_buffer(piece.column("text"))
            rid = piece.column("rid").to_numpy()
            long_text = len(rid) == 1
            for at in range(0, max(len(data) - span + 1, 1), PIECE) if long_text else [0]:
                part = data[at : at + PIECE + span - 1] if long_text else data
                text, first, last, trigger, h, v = phrases(part, np.array([0, len(part)]) if long_text else offsets, span)
                place = ((trigger + at) << 16) | ((trigger - first) << 8) | (trigger - last)
                yield pa.RecordBatch.from_arrays([pa.array(rid[text]), pa.array(place, pa.int64()), pa.array(h.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

    return run


def _strings(span: int):
    """A row for each string of the phrases listed with a text: the trigger's
    hash, its own, and the phrase's number with the distance to the trigger."""
    schema = pa.schema([("h", pa.int64()), ("w", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_pieces(batches, "text", PIECE):
            for i in range(piece.num_rows):
                data, _ = text_buffer(piece.column("text").slice(i, 1))
                listed = piece.column("spots").slice(i, 1).flatten()
                number, place, h = (listed.field(k).to_numpy() for k in (0, 1, 2))
                trigger, far, near = place >> 16, (place >> 8) & 255, place & 255
                count = far - near + 1
                which = np.repeat(np.arange(len(count)), count)
                back = far[which] - (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count))
                starts = trigger[which] - back
                lo = int(starts.min()) if len(starts) else 0
                sums = prefix_sums(data[lo : int(starts.max()) + span])
                yield pa.RecordBatch.from_arrays([pa.array(h[which]), pa.array(substring_hashes(sums, starts - lo, span).view(np.int64)), pa.array((number[which] << 8) | back)], schema=schema)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping or touching stretches of each text become one."""
    ints = pa.list_(pa.int64())
    schema = pa.schema([("rid", pa.int64()), ("starts", ints), ("ends", ints), ("n_removed", pa.int64()), ("n_spans", pa.int64())])
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            listed = batch.column("spans").slice(i, 1).flatten()
            s, e = (listed.field(k).to_numpy() for k in (0, 1))
            order = np.argsort(s, kind="stable")
            s, e = s[order], np.maximum.accumulate(e[order])
            new = np.append(True, s[1:] > e[:-1])
            s, e = s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]
            out.append((s, e, int((e - s).sum()), len(s)))
        yield pa.RecordBatch.from_arrays([batch.column("rid"), *[pa.array(list(c), f.type) for c, f in zip(zip(*out) if out else [[]] * 4, list(schema)[1:])]], schema=schema)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("rid", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])
    for batch in batches:
        kept = []
        for text, starts, ends in zip(batch.column("text"), batch.column("starts"), batch.column("ends")):
            raw = memoryview(text.as_buffer())
            cuts = [0, *(x for pair in zip(starts.as_py(), ends.as_py()) for x in pair), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], schema=schema)


def _again(docs: DataFrame, entries: DataFrame, span: int, hot: int) -> DataFrame:
    """(h, w, key) of the strings that the dictionary has more than once."""

    def strings(chosen: DataFrame) -> DataFrame:
        spots = chosen.groupBy("rid").agg(F.collect_list(F.struct("number", "place", "h")).alias("spots"))
        texts = keep_ids(docs, chosen, "rid").dropDuplicates(["rid"]).join(spots, "rid")
        return texts.select("text", "spots").mapInArrow(_strings(span), "h bigint, w bigint, key bigint")

    # at most total / hot triggers have so many entries
    crowded = materialize(entries.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("h"), "crowded")
    cold = strings(entries.join(F.broadcast(crowded), "h", "left_anti"))
    few = cold.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("h", "w"))).filter("c > 1").drop("c")
    if crowded.isEmpty():
        return few
    many = materialize(strings(entries.join(F.broadcast(crowded), "h", "left_semi")), "strings")
    counts = many.groupBy("w", "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return few.union(join_one_row_per_key(many, counts, ["w", "h"], "c", hot, "key").select("h", "w", "key"))


def repeated_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(rid, starts, ends, n_removed, n_spans) of the texts that repeat.

    ``docs`` has (rid bigint, text string), one row for each text; rows that
    share a rid must share the text, and count as so many texts.
    """
    if not K < span <= K + 255:
        raise ValueError(f"span must lie between {K + 1} and {K + 255}")
    size = F.octet_length("text").cast("bigint")
    hot = hot_limit((docs.agg(F.sum(size)).first()[0] or 0) // 64)
    parse = docs.filter(size >= span).mapInArrow(_parse(span), "rid bigint, place bigint, h bigint, v bigint")
    triggers = parse.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).filter("n > 1")
    found = materialize(join_one_row_per_key(parse, triggers, ["h"], "n", hot, "rid"), "phrases")
    mixed = found.filter("lo <> hi").drop("lo", "hi", "n")
    entries = mixed.groupBy("h", "v").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rid", "place")).alias("at"))
    entries = materialize(entries.select("h", "v", "c", "at.rid", "at.place", F.monotonically_increasing_id().alias("number")), "dictionary")

    again = _again(docs, entries, span, hot)
    stretch = again.groupBy(F.shiftright("key", 8).alias("number")).agg(F.max(F.col("key").bitwiseAND(255)).alias("far"), F.min(F.col("key").bitwiseAND(255)).alias("near"))
    trigger, far, near = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255), F.col("place").bitwiseAND(255)
    whole = lambda df: df.select("rid", (trigger - far).alias("start"), (trigger - near + span).alias("end"))
    single = entries.filter("c = 1").join(stretch, "number").select("rid", (trigger - F.col("far")).alias("start"), (trigger - F.col("near") + span).alias("end"))
    many = join_one_row_per_key(mixed, entries.filter("c > 1").select("h", "v", "c"), ["h", "v"], "c", hot, "rid")
    spans = whole(found.filter("lo = hi")).union(whole(many)).union(single)
    # rows that repeat a rid have the same spans, which are then kept once
    grouped = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return grouped.mapInArrow(_merge, "rid bigint, starts array<bigint>, ends array<bigint>, n_removed bigint, n_spans bigint")


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Which bytes of each text are repeated, and what is left without them.

    Takes (doc_id bigint, text, ...) and returns (doc_id, n_bytes, n_removed,
    n_spans, kept_sha256), one row for each row. A byte goes if a ``span``-byte
    string that covers it also starts anywhere else, the same text included.
    Texts are UTF-8 bytes, null ones empty; strings never cross texts. Rows that
    repeat an id and text repeat each other. Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    spans = materialize(repeated_spans(docs.select("rid", "text"), span), "spans")
    plain = docs.select("doc_id", "rid", F.monotonically_increasing_id().alias("place"), F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    plain = materialize(plain, "plain")
    rows, hot = plain.groupBy("rid").agg(F.count(F.lit(1)).alias("rows")), hot_limit(plain.count())
    marked = materialize(join_one_row_per_key(plain, spans.select("rid", "n_removed", "n_spans").join(rows, "rid"), ["rid"], "rows", hot, "place", how="left"), "marked")
    part = marked.filter("n_removed < n_bytes").select("rid").distinct()
    cut = keep_ids(docs.select("rid", "text"), part, "rid").dropDuplicates(["rid"]).join(spans.select("rid", "starts", "ends").join(part, "rid", "left_semi"), "rid")
    kept = cut.mapInArrow(_kept, "rid bigint, kept binary, kept_sha256 string").select("rid", "kept_sha256")
    out = join_one_row_per_key(marked, kept.join(rows, "rid"), ["rid"], "rows", hot, "place", how="left")
    sha = F.when(F.col("n_removed").isNull(), F.col("sha")).when(F.col("n_removed") == F.col("n_bytes"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256"))
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), sha.alias("kept_sha256"))
