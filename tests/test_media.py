import io
import struct
import wave

import pytest

from tessellate.operators import media as MD


def _wav(junk=b"", n=800):
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0\0" * n)
    b = buf.getvalue()
    out = b[:36] + junk + b[36:]
    return out[:4] + struct.pack("<I", len(out) - 8) + out[8:]


def _chunk(name, size):
    return name + struct.pack("<I", size) + b"data" * (size // 4) + b"x" * (size % 4) + b"\0" * (size % 2)


def test_metadata_before_the_data(spark):
    good = [_wav(), _wav(_chunk(b"JUNK", 6000)), _wav(_chunk(b"LIST", 51)), _wav(_chunk(b"bext", 4045)), _wav(_chunk(b"LIST", 4) * 700),
            _wav(_chunk(b"JUNK", 4044 - 0)), _wav(_chunk(b"iXML", 200_001)), _wav(n=50_000)]
    items = [*good, b"not a wav", b"", None, b"RIFF" + b"x" * 9000, _wav(_chunk(b"JUNK", 6000))[:5000]]
    got = {r["item"]: r for r in MD.audio_profile(spark.createDataFrame([(1, items)], "sample_id bigint, audios array<binary>")).collect()}
    assert len(got) == len(items)
    for i, b in enumerate(items):
        want = MD._profile_one(b, MD.TARGET_RATE, MD.CLIP_SECONDS) if b is not None else (None,) * 5 + (True,)
        r = got[i]
        assert r.failed == want[5] == (i >= len(good))
        if not r.failed:
            assert (r.sample_rate, r.channels, r.n_samples, r.clipped_samples) == (want[0], want[1], want[2], want[4])
            assert r.seconds == pytest.approx(want[3])
