import pytest

from framewright.sources import hls


def one(spark, text):
    return spark.createDataFrame([("p", text)], "playlist_id string, text string")


LIVE = "#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:5\n#EXT-X-MEDIA-SEQUENCE:41\n#EXT-X-DISCONTINUITY-SEQUENCE:3\n#EXTINF:4.6,Intro; part one, cut\nx/intro.ts\n#EXTINF:5.25,\nx/talk.ts\n#EXT-X-DISCONTINUITY\n#EXTINF:2.5,Outro\r\nx/outro.ts\n"


def test_live_window(spark):
    rows = hls.segments(one(spark, LIVE)).orderBy("ordinal").collect()
    assert [r["sequence"] for r in rows] == [41, 42, 43]
    assert [r["title"] or "" for r in rows] == ["Intro; part one, cut", "", "Outro"]
    assert [r["discontinuity"] for r in rows] == [False, False, True]
    assert [r["discontinuity_sequence"] for r in rows] == [3, 3, 4]
    p = hls.playlists(one(spark, LIVE)).head()
    assert (p["kind"], p["error"], p["media_sequence"]) == ("media", None, 41)


def test_byte_ranges(spark):
    text = "#EXTM3U\n#EXT-X-VERSION:4\n#EXT-X-TARGETDURATION:6\n#EXTINF:5.5,\nplain.ts\n" + "".join(f"#EXT-X-BYTERANGE:{r}\n#EXTINF:3,\nall.ts\n" for r in ("700@64", "9", "1000"))
    rows = hls.segments(one(spark, text)).orderBy("ordinal").collect()
    assert [(r["offset"], r["length"]) for r in rows] == [(None, None), (64, 700), (764, 9), (773, 1000)]
    assert all(r["valid"] for r in rows)
    bad = text.replace("700@64", "700")
    assert hls.playlists(one(spark, bad)).head()["error"]["code"] == "InvalidData"


def test_master(spark):
    text = '#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="g",NAME="x",URI="a.m3u8",DEFAULT=YES\n#EXT-X-STREAM-INF:BANDWIDTH=1280000,CODECS="avc1.4d,mp4a.40.2",RESOLUTION=640x360,FRAME-RATE=29.97,AUDIO="g"\nlow\n#EXT-X-STREAM-INF:BANDWIDTH=640000\nlower\n'
    rows = hls.variants(one(spark, text)).orderBy("ordinal").collect()
    assert [r["bandwidth"] for r in rows] == [1280000, 640000]
    assert rows[0]["codecs"] == ["avc1.4d", "mp4a.40.2"] and rows[0]["frame_rate"] == 29.97 and rows[0]["width"] == 640
    assert [r["external_audio"] for r in rows] == [True, False]
    assert hls.playlists(one(spark, text)).head()["error"] is None
    missing = text.replace('AUDIO="g"', 'AUDIO="h"')
    assert hls.playlists(one(spark, missing)).head()["error"]["message"] == "no such rendition group"


@pytest.mark.parametrize(
    ("change", "code"),
    [
        (("#EXTM3U\n", "#EXTM3\n"), "InvalidData"),
        (("#EXT-X-TARGETDURATION:5\n", ""), "InvalidData"),
        (("#EXT-X-TARGETDURATION:5\n", "#EXT-X-TARGETDURATION:4\n"), "InvalidData"),
        (("#EXT-X-VERSION:3\n", ""), "InvalidData"),
        (("#EXT-X-VERSION:3\n", "#EXT-X-VERSION:8\n"), "Unsupported"),
        (("x/intro.ts\n", "x/intro.ts\n#EXT-X-KEY:METHOD=AES-128,URI=\"k\"\n"), "Unsupported"),
        (("x/intro.ts\n", "x/intro.ts\n#EXT-X-KEY:METHOD=NONE\n"), None),
        (("x/intro.ts\n", "x/intro.ts\n#EXT-X-PART:DURATION=1\n"), "Unsupported"),
        (("x/intro.ts\n", "x/intro.ts\n#EXT-X-UNKNOWN:1\n# comment\n"), None),
        (("x/outro.ts\n", ""), "InvalidData"),
        (("#EXTINF:2.5,Outro\r\n", ""), "InvalidData"),
    ],
)
def test_validation(spark, change, code):
    error = hls.playlists(one(spark, LIVE.replace(*change))).head()["error"]
    assert (error and error["code"]) == code
