"""Importance resampling towards a target distribution, by an external sort-count of hashed word features.

Each document's features (runs of consecutive words) become buckets, written once as packed uint16 streams, one row for
a run of documents with their offsets in the stream. Counting sorts bounded runs of these streams and run-length encodes
them; Spark adds the (bucket, count) pairs up. The target's streams are counted likewise. A bucket's gain is the log of
how much more frequent it is in the target; a second pass over the streams gathers gains and adds them up for each
document by np.add.reduceat. Gumbel noise from the id's hash turns the highest scores into a sample without replacement.

Only one number for each bucket goes through the driver. Ranks come from written ranges and one offset for each range.

Defined results: a null or empty text has no features and weight 0. Rows with the same id are rows of their own; rows
alike in score and id get consecutive ranks in any order; null ids come last among ties and hash as the empty text.
An empty target leaves all gains to smoothing; an empty table gives an empty result. Other columns are not touched.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, materialize, slices

#: Bytes of a text that are split into words at a time; entries of a stream that are sorted at a time.
PIECE, RUN = 1 << 20, 1 << 22
#: What is left of each byte: digits, a-z (A-Z as a-z) and bytes of other code points; all else separates words.
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some PIECE bytes at a time."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def features(raw: bytes, longest: int, buckets: int) -> tuple[np.ndarray, int]:
    """(bucket of every run of 1 to `longest` words, number of words) of a text in UTF-8."""
    parts, n_words, tail = [], 0, []
    for words in _pieces(raw.translate(_KEPT)):
        n_words += len(words)
        known, words = len(tail), tail + words
        for n in range(1, longest + 1):
            first = max(0, known - n + 1)  # runs that end in this piece
            runs = words[first:] if n == 1 else [b" ".join(words[i : i + n]) for i in range(first, len(words) - n + 1)]
            parts.append(np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)) % np.uint32(buckets))
        tail = words[len(words) - longest + 1 :] if longest > 1 else []
    return (np.concatenate(parts) if parts else np.zeros(0)).astype("<u2"), n_words


def _pack(longest: int, buckets: int, with_id: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].cast(pa.int64()) if with_id else pa.nulls(batch.num_rows, pa.int64())
            for i, j, data, offsets in slices(batch["text"]):
                raw, streams, words = data.tobytes(), [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    stream, n = features(raw[a:b], longest, buckets)
                    streams.append(stream)
                    words.append(n)
                one = lambda values, kind: pa.ListArray.from_arrays([0, j - i], pa.array(values, kind))
                columns = [one(ids[i:j], pa.int64()), one(words, pa.int64()), one(np.cumsum([len(s) for s in streams]), pa.int64()), pa.array([np.concatenate(streams).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "words", "ends", "stream"])

    return run


def pack_streams(docs: DataFrame, text: str = "text", doc_id: str | None = "doc_id", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """Write the packed streams: a row for each run of whole documents with ids, numbers of words and ends in the stream."""
    if not 0 < buckets <= 1 << 16 or longest < 1:
        raise ValueError("buckets must fit in 16 bits, and runs have a word at least")
    rows = docs.select(*([F.col(doc_id).alias("doc_id")] if doc_id else []), F.col(text).alias("text"))
    return materialize(map_arrow(rows, _pack(longest, buckets, doc_id is not None), "ids array<bigint>, words array<bigint>, ends array<bigint>, stream binary"), "streams")


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a stream, ascending, and how often each occurs: sorted and run-length encoded."""
    ordered = np.sort(stream)
    starts = np.flatnonzero(np.concatenate([[len(ordered) > 0], ordered[1:] != ordered[:-1]]))
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def _count(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch["stream"]:
                stream = np.frombuffer(value.as_buffer(), "<u2")
                for at in range(0, len(stream), RUN):
                    found, n = run_lengths(stream[at : at + RUN])
                    total[found] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return run


def count_buckets(streams: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all streams; the driver gets one number for each bucket."""
    found = map_arrow(streams.select("stream"), _count(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of target share over source share) of each bucket, counts smoothed by one."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * float(s_all + k) / ((s + 1) * float(t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _gather(gain: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, words, ends = (batch[c][k].values for c in ("ids", "words", "ends"))
                ends = ends.to_numpy(zero_copy_only=False).astype(np.int64)
                size = np.diff(ends, prepend=0)
                weight = np.zeros(len(ends), np.int64)
                if (full := np.flatnonzero(size)).size:  # reduceat gives an element, not 0, for an empty run
                    weight[full] = np.add.reduceat(gain[np.frombuffer(batch["stream"][k].as_buffer(), "<u2")], (ends - size)[full])
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(size), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def weigh(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of its features' gains) of each packed document."""
    return map_arrow(streams, _gather(gain), "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """Each row's doc_id, n_words, n_features, weight, score and rank (null: not drawn).

    Of the N documents with `least_words` words, floor(percent * N / 100) are drawn.
    """
    streams = pack_streams(docs, text, doc_id, longest, buckets)
    wanted = pack_streams(target, target_text, None, longest, buckets)
    weighed = weigh(streams, gains(count_buckets(streams, buckets), count_buckets(wanted, buckets)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    # Rows of one score and id are told apart by their place in the streams, so that ranges can cut between them.
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("able", F.col("n_words") >= least_words).withColumn("tie", F.monotonically_increasing_id())
    order = (F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "tie")
    ranged = materialize(scored.orderBy(*order).withColumn("at", F.monotonically_increasing_id()).drop("tie"), "ranges")
    part = F.shiftright("at", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("able"), 1)).alias("able")).sort("part").collect()  # one row for each range
    before = np.cumsum([0] + [r["n"] for r in sizes]).tolist()
    drawn = percent * sum(r["able"] for r in sizes) // 100
    offsets = docs.sparkSession.createDataFrame([(r["part"], n) for r, n in zip(sizes, before, strict=False)], "part long, before long")
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    placed = ranged.withColumn("part", part).join(F.broadcast(offsets), "part")
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))
