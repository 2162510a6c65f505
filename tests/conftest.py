import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from mediacairn.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session()
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def table(spark):
    return lambda ddl, *rows: spark.createDataFrame(list(rows), ddl)


PROBE = ("path string, size bigint, mtime double, duration_seconds double, container string, video_codec string, "
         "height int, video_bitrate bigint, is_hdr boolean, dv_profile int, color_transfer string, color_primaries string")


@pytest.fixture
def probe(spark):
    """One probe row per dict, with the usual defaults."""
    def make(*rows):
        base = dict(path="/tmp/x.mkv", size=10_000_000_000, mtime=0.0, duration_seconds=3600.0, container="matroska",
                    video_codec="hevc", height=1080, video_bitrate=20_000_000, is_hdr=False, dv_profile=None,
                    color_transfer=None, color_primaries=None)
        names = [c.strip().split(" ")[0] for c in PROBE.split(",")]
        return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], PROBE)
    return make
