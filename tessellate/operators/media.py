"""Media bookkeeping as Spark jobs (MED-01 .. MED-03, MET-17).

Pixel and audio decoding are out of scope; what is kept is the per-sample
accounting: token budgets, frame-sampling plans, byte manifests and a WAV
header profile.  All but the WAV profile are column expressions; the WAV
profile parses bytes with the standard-library ``wave`` module inside
``mapInArrow`` (one small helper per row, Arrow batches, partition-parallel).
"""

from __future__ import annotations

import io
import wave

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S

# FIXED VALUES: frame cap of the sequential decode fallback and the audio
# clip used by the loader (10 s at 16 kHz).
MAX_DECODED_FRAMES = 512
CLIP_SECONDS = 10
TARGET_RATE = 16000


def media_budget(ids: Column, markers: dict[str, int], image_grid: Column, video_grid: Column,
                 audio: Column) -> Column:
    """MET-17: per-sample budget record.

    input_ids_len, placeholder counts by kind, text_tokens_est = ids minus
    placeholders, grid-based image/video token estimates, and audio seconds
    summed over ``audio`` (array<struct<n_samples, sr>>) rounded to 6 places.
    """
    counts = [S.count_id(ids, v).alias(k) for k, v in markers.items()]
    total_ph = None
    for k, v in markers.items():
        c = S.count_id(ids, v)
        total_ph = c if total_ph is None else total_ph + c
    secs = F.aggregate(audio, F.lit(0.0), lambda a, x: a + x["n_samples"].cast("double") / x["sr"].cast("double"))
    return F.struct(F.size(ids).alias("input_ids_len"), (F.size(ids) - total_ph).alias("text_tokens_est"),
                    *counts, S.grid_tokens(image_grid).alias("image_kv_tokens_est"),
                    S.grid_tokens(video_grid).alias("video_kv_tokens_est"), F.round(secs, 6).alias("audio_secs"))


def frame_plan(n: Column, duration: Column, start: Column, k: int, max_frames: int = MAX_DECODED_FRAMES) -> Column:
    """MED-02: struct(kind, plan) of which frames to take.

    seek: timestamps int(start + duration * i / k) when a duration is known
    and the clip has more than k frames; index: otherwise the decode stops at
    512 frames and, when more than k were decoded, takes linspace(0, m-1, k)
    truncated to integers; with m <= k all frames are kept.
    """
    seek = duration.isNotNull() & (duration > 0) & (n > k)
    i = F.sequence(F.lit(0), F.lit(k - 1))
    ts = F.transform(i, lambda x: F.floor(start + duration * x / F.lit(k)).cast("bigint"))
    m = F.least(n, F.lit(max_frames))
    lin = F.transform(i, lambda x: F.floor(x * (m - 1) / F.lit(k - 1)).cast("bigint"))
    allf = F.when(m > 0, F.sequence(F.lit(0).cast("bigint"), (m - 1).cast("bigint"))) \
            .otherwise(F.array().cast("array<bigint>"))
    plan = F.when(seek, ts).when(m > k, lin).otherwise(allf)
    return F.struct(F.when(seek, F.lit("seek")).otherwise(F.lit("index")).alias("kind"), plan.alias("plan"))


def media_manifest(df: DataFrame, cols: list[str]) -> DataFrame:
    """MED-03: per sample, count and byte length of each media list, empty
    entries ignored (strings count their UTF-8 bytes)."""
    out = df
    for c in cols:
        items = F.filter(F.coalesce(F.col(c), F.array()), lambda x: F.octet_length(x) > 0)
        out = out.withColumn(f"n_{c}", F.size(items)) \
                 .withColumn(f"{c[:-1]}_bytes",
                             F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x)))
    return out


AUDIO_PROFILE_SCHEMA = ("sample_id bigint, item int, sample_rate int, channels int, n_samples bigint, "
                        "seconds double, clipped_samples bigint, failed boolean")


_FACT_NAMES = [c.split()[0] for c in AUDIO_PROFILE_SCHEMA.split(", ")]
_FACTS = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()]
#: Bytes of an item that hold its header (the data chunk's size stands in it),
#: and the chunks before the data that are looked at there.
HEADER_BYTES, HEADER_CHUNKS = 4096, 16


def _header(b: Column) -> Column:
    """The first HEADER_BYTES of an item if its data chunk begins there, else the whole item."""
    head = F.substring(b, 1, HEADER_BYTES)
    byte = lambda at: F.conv(F.hex(F.substring(head, at, 1)), 16, 10).cast("bigint")

    def step(at, _):  # at: 1-based start of a chunk, 0 once past the prefix, below 0 at the data chunk
        size = byte(at + 4) + byte(at + 5) * 256 + byte(at + 6) * 65536 + byte(at + 7) * 16777216
        after = at + 8 + size + size % 2
        return F.when(at <= 0, at).when(at + 7 > HEADER_BYTES, 0).when(F.substring(head, at, 4) == F.lit(b"data"), -at).otherwise(F.coalesce(after, F.lit(0))).cast("bigint")

    found = F.aggregate(F.sequence(F.lit(1), F.lit(HEADER_CHUNKS)), F.lit(13).cast("bigint"), step) < 0
    return F.when((F.octet_length(b) <= HEADER_BYTES) | found, head).otherwise(b)


def _profile_one(b: bytes, rate: int, clip: float):
    try:
        with wave.open(io.BytesIO(b), "rb") as w:
            sr, ch, n = w.getframerate(), w.getnchannels(), w.getnframes()
    except Exception:  # noqa: BLE001 - any undecodable item is reported, not raised
        return None, None, None, None, None, True
    secs = n / float(sr) if sr else None
    # resampled to the target rate, then clipped
    resampled = int(round(n * rate / sr)) if sr else 0
    return sr, ch, n, secs, min(resampled, int(clip * rate)), False


def audio_profile(df: DataFrame, col: str = "audios", rate: int = TARGET_RATE, clip: float = CLIP_SECONDS) -> DataFrame:
    """MED-01: WAV header facts per audio item of a binary media column.

    Rows are exploded to (sample_id, item, first HEADER_BYTES bytes) in the JVM,
    so Python sees headers only; items whose data chunk begins later are read whole.
    """
    items = df.select(F.col("sample_id").cast("bigint").alias("sample_id"), F.posexplode(col).alias("item", "b")).select("sample_id", "item", _header(F.col("b")).alias("b"))

    def run(batches):
        for b in batches:
            rows = [_profile_one(x, rate, clip) if x is not None else (None,) * 5 + (True,) for x in b.column(2).to_pylist()]
            facts = [pa.array(c, t) for c, t in zip(zip(*rows), _FACTS)] if rows else [pa.array([], t) for t in _FACTS]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *facts], names=_FACT_NAMES)
    return items.mapInArrow(run, AUDIO_PROFILE_SCHEMA)
