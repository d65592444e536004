import struct
import zlib

import numpy as np
import pytest

from framewright.functions import integer
from framewright.sources import bits, bitstreams, containers, fonts, images, mpegts, readers

SIZES = (1, 3, 17, 257)


def element(number: int, body: bytes) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + (1 << 56 | len(body)).to_bytes(8, "big") + body


def uint(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def webm_file(audio_flags: int = 0x80, lace: bytes = b"AA") -> bytes:
    video = element(containers.TRACK, element(containers.NUMBER, uint(1)) + element(containers.KIND, uint(1)) + element(containers.CODEC, b"V_VP8") + element(containers.VIDEO, element(containers.WIDTH, uint(320)) + element(containers.HEIGHT, uint(180))))
    audio = element(containers.TRACK, element(containers.NUMBER, uint(2)) + element(containers.KIND, uint(2)) + element(containers.CODEC, b"A_OPUS") + element(containers.AUDIO, element(containers.RATE, struct.pack(">f", 44100)) + element(containers.CHANNELS, uint(2))))
    cluster = element(containers.CLUSTER, element(containers.TIME, uint(10)) + element(containers.SIMPLE, b"\x81" + struct.pack(">hB", 5, 0x80) + b"VVV") + element(containers.GROUP, element(containers.BLOCK, b"\x82" + struct.pack(">hB", 7, audio_flags & 0x7F) + lace) + element(containers.PADDING, struct.pack(">h", -500))))
    return element(containers.EBML, element(containers.DOCTYPE, b"webm")) + element(containers.SEGMENT, element(containers.INFO, element(containers.SCALE, uint(1000000))) + element(containers.TRACKS, video + audio) + cluster)


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", bytearray(c)) for i, c in enumerate(contents)], "file_id string, content binary")


def test_webm(spark):
    tracks = readers.webm_tracks(files(spark, webm_file())).orderBy("number").collect()
    assert [(t["kind"], t["codec"], t["width"], t["sampling_frequency"], t["channels"]) for t in tracks] == [("video", "V_VP8", 320, None, None), ("audio", "A_OPUS", None, 48000.0, 2)]
    blocks = readers.webm_blocks(files(spark, webm_file())).orderBy("n").collect()
    assert [(b["kind"], b["timestamp_ns"], b["key_frame"], [bytes(p) for p in b["packets"]], b["discard_padding_ns"]) for b in blocks] == [("video", 15000000, True, [b"VVV"], 0), ("audio", 17000000, False, [b"AA"], -500)]
    assert readers.webm_blocks(files(spark, webm_file()), audio=False).count() == 1
    broken = readers.webm_blocks(files(spark, webm_file()[:-3]), errors="row").collect()
    assert broken[0]["error"].startswith("Incomplete")


def test_lacing():
    assert containers.split_lace(b"\x02" + b"\x01\xff\x01" + b"a" + b"b" * 256 + b"cc", 0x02) == [b"a", b"b" * 256, b"cc"]
    assert containers.split_lace(b"\x02aabbcc", 0x04) == [b"aa", b"bb", b"cc"]
    assert containers.split_lace(b"\x02\x82\xc0aabbbc", 0x06) == [b"aa", b"bbb", b"c"]
    for bad in (b"\x00aa", b"\x02aabb"):
        with pytest.raises(bits.Invalid):
            containers.split_lace(bad, 0x04)


def box(kind: str, body: bytes) -> bytes:
    return struct.pack(">I", 8 + len(body)) + kind.encode() + body


def full(kind: str, body: bytes, version: int = 0) -> bytes:
    return box(kind, bytes([version, 0, 0, 0]) + body)


def mp4_file() -> bytes:
    entry = box("avc1", b"\0" * 24 + struct.pack(">HH", 2, 2) + b"\0" * 50)
    stbl = full("stsd", struct.pack(">I", 1) + entry) + full("stts", struct.pack(">III", 1, 2, 100)) + full("ctts", struct.pack(">IIIII", 2, 1, 150, 1, 0)) + full("stss", struct.pack(">II", 1, 2))
    stbl += full("stsc", struct.pack(">IIII", 1, 1, 2, 1)) + full("stsz", struct.pack(">IIII", 0, 2, 6, 6)) + full("stco", struct.pack(">II", 1, 4000))
    mdia = full("mdhd", struct.pack(">IIII", 0, 0, 1000, 200) + b"\0" * 4) + full("hdlr", b"\0" * 4 + b"vide" + b"\0" * 12) + box("minf", box("stbl", stbl))
    return box("ftyp", b"isom") + box("moov", box("trak", box("mdia", mdia))) + box("mdat", b"x" * 12)


def fragmented(tracks=(3,), run_flags=0x201, run=b"", header=b"", header_flags=0, time=None):
    trex = b"".join(full("trex", struct.pack(">5I", t, 1, 20, 9, 0x10000)) for t in tracks)
    head = box("tfhd", struct.pack(">I", header_flags) + struct.pack(">I", 3) + header)
    times = b"" if time is None else full("tfdt", struct.pack(">Q", time), 1)
    trun = box("trun", struct.pack(">I", run_flags) + run)
    moof = box("moof", full("mfhd", struct.pack(">I", 1)) + box("traf", head + times + trun))
    return box("moov", box("mvex", trex)) + moof, len(box("moov", box("mvex", trex)))


def test_mp4_fragments(spark):
    data, start = fragmented(run=struct.pack(">IiII", 2, 100, 5, 6), time=1 << 33)
    rows = containers.fragment_samples(data)
    assert [(r["offset"], r["size"], r["decode_time"], r["keyframe"]) for r in rows] == [(start + 100, 5, 1 << 33, False), (start + 105, 6, (1 << 33) + 20, False)]
    data, start = fragmented(run_flags=0x5, run=struct.pack(">IiI", 3, 8, 0))
    rows = containers.fragment_samples(data + data[start:])  # the second fragment has no time either
    assert [r["keyframe"] for r in rows] == [True, False, False] * 2 and [r["size"] for r in rows] == [9] * 6
    assert [r["decode_time"] for r in rows] == list(range(0, 120, 20)) and rows[3]["offset"] == len(data) + 8
    data, _ = fragmented(run_flags=0x800, run=struct.pack(">II", 1, 3), header_flags=0x1, header=struct.pack(">Q", 7000))
    assert containers.fragment_samples(data) == [{"fragment": 0, "track": 3, "n": 0, "offset": 7000, "size": 9, "decode_time": 0, "presentation_time": 3, "keyframe": False}]
    broken = [fragmented(tracks=(4,), run=struct.pack(">Ii", 0, 0))[0], fragmented(tracks=(3, 3), run=struct.pack(">Ii", 0, 0))[0], fragmented(run_flags=0x405, run=struct.pack(">IiII", 1, 0, 0, 0))[0], fragmented(run=struct.pack(">Ii", 9, 0))[0]]
    for data in broken:
        with pytest.raises(bits.Invalid):
            containers.fragment_samples(data)
    rows = readers.mp4_fragments(files(spark, broken[0])).collect()
    assert len(rows) == 1 and "without defaults" in rows[0]["error"]
    whole, start = fragmented(run=struct.pack(">IiII", 2, 100, 5, 6), time=5)
    for cut in range(start + 1, len(whole)):
        with pytest.raises(bits.Invalid):
            containers.fragment_samples(whole[:cut])


def test_mp4_samples(spark):
    rows = readers.mp4_samples(files(spark, mp4_file())).orderBy("n").collect()
    assert [(r["offset"], r["size"], r["decode_time"], r["presentation_time"], r["keyframe"]) for r in rows] == [(4000, 6, 0, 150, False), (4006, 6, 100, 100, True)]
    t = readers.mp4_table(files(spark, mp4_file()), "tracks").head()
    assert (t["timescale"], t["codec"], t["width"]) == (1000, "avc1", 2)
    for cut in range(20, len(mp4_file()) - 20, 37):
        try:
            containers.mp4_tables(mp4_file()[:cut])
        except bits.Invalid:
            continue
        raise AssertionError(cut)


def wav_file(tag: int, bits_: int, channels: int, data: bytes) -> bytes:
    align = channels * bits_ // 8
    body = b"WAVE" + b"JUNK" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<IHHIIHH", 16, tag, channels, 8000, 8000 * align, align, bits_) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wav(spark):
    rows = readers.wav_packets(files(spark, wav_file(1, 8, 1, bytes([0, 128, 255]))), frames=2).orderBy("packet").collect()
    assert [r["samples"] for r in rows] == [[-1.0, 0.0], [np.float32(127 / 128)]]
    assert [r["timestamp_ns"] for r in rows] == [0, 250000]
    assert readers.wav_packets(files(spark, wav_file(7, 8, 1, b"")), errors="row").head()["error"].startswith("Unsupported")
    for b in (16, 24, 32):
        low = (1 << (b - 1)).to_bytes(b // 8, "little")
        assert readers.pcm(low + b"\0" * (b // 8), b).tolist() == [-1.0, 0.0]
        assert readers.pcm(low[::-1] + b"\0" * (b // 8), b, big=True).tolist() == [-1.0, 0.0]
    assert readers.pcm(struct.pack("<4f", -2, -0.5, 0, 2), 32, floating=True).tolist() == [-1, -0.5, 0, 1]
    with pytest.raises(bits.Invalid):
        readers.pcm(struct.pack("<f", float("nan")), 32, floating=True)


Y4M = b"YUV4MPEG2 W2 H2 F25:1 C420jpeg\nFRAME\n" + bytes([16] * 4 + [128] * 2) + b"FRAME\n" + bytes([235] * 4 + [128] * 2)


def test_y4m(spark):
    rows = readers.y4m_frames(files(spark, Y4M)).orderBy("frame_index").collect()
    assert [bytes(r["rgba"])[:4] for r in rows] == [b"\0\0\0\xff", b"\xff\xff\xff\xff"]
    assert rows[1]["timestamp"] == np.float32(0.04)
    for c, n in (("420", 7), ("422", 7), ("444", 9), ("mono", 3)):
        raw = f"YUV4MPEG2 W3 H1 F25:1 C{c}\nFRAME\n".encode() + bytes([128] * n)
        assert len(readers.y4m_frames(files(spark, raw)).head()["rgba"]) == 12
    for bad in (Y4M[:-1], Y4M.replace(b"W2 H2", b"W99999 H99999"), Y4M.replace(b"F25:1", b"F0:1")):
        with pytest.raises(bits.Invalid):
            containers.y4m(bad)


@pytest.mark.parametrize("size", SIZES)
def test_any_chunks_give_the_same(spark, size):
    whole = files(spark, Y4M, webm_file())
    again = readers.from_chunks(readers.in_chunks(whole, size))
    assert sorted((r[0], bytes(r[1])) for r in again.collect()) == sorted((r[0], bytes(r[1])) for r in whole.collect())


def section(table: int, body: bytes) -> bytes:
    s = bytes([table]) + struct.pack(">H", 0xB000 | len(body) + 9) + b"\0\1\xc1\0\0" + body
    return s + containers.crc32_mpeg(s).to_bytes(4, "big")


def packet(pid: int, counter: int, payload: bytes, starts: bool = False, discontinuity: bool = False) -> bytes:
    room = 184 - len(payload)
    head = struct.pack(">BHB", 0x47, pid | (0x4000 if starts else 0), (0x30 if room else 0x10) | counter)
    if room:
        head += bytes([room - 1]) + (bytes([0x80 if discontinuity else 0]) + b"\xff" * (room - 2) if room > 1 else b"")
    return head + payload


def stamp(prefix: int, t: int) -> bytes:
    return bytes([prefix << 4 | (t >> 30) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def pes(data: bytes, pts: int, sized: bool = False) -> bytes:
    head = b"\x80\x80\x05" + stamp(2, pts)
    return b"\0\0\1\xe0" + struct.pack(">H", len(head) + len(data) if sized else 0) + head + data


def transport(lose: bool = False) -> bytes:
    pat = b"\0" + section(0, struct.pack(">HH", 1, 0xE100))
    pmt = b"\0" + section(2, struct.pack(">HH", 0xE101, 0xF000) + struct.pack(">BHH", 0x1B, 0xE101, 0xF000) + struct.pack(">BHH", 0x06, 0xE105, 0xF000))
    first, second, third = pes(b"a" * 300, 90000), pes(b"b" * 100, (1 << 33) - 1), pes(b"c" * 100, 5)
    out = [packet(0, 0, pat, True), packet(0x100, 0, pmt, True), packet(0x101, 14, first[:184], True), packet(0x101, 15, first[184:]), packet(0x101, 15, first[184:]), packet(0x1FFF, 0, b"z" * 184), packet(0x101, 0, second, True), packet(0x101, 1, third, True)]
    if lose:
        out.pop(3)
        out.pop(3)
    return b"".join(out)


def test_transport(spark):
    rows = mpegts.decode(mpegts.packets(files(spark, transport())))
    assert rows.where("not valid").count() == 0
    streams = mpegts.elementary_streams(rows)
    assert [(r["pid"], r["codec"]) for r in streams.collect()] == [(0x101, "h264")]
    got = mpegts.elementary_packets(rows, streams).orderBy("unit").collect()
    assert [(r["pts"], bytes(r["data"]), r["discontinuity"]) for r in got] == [(90000, b"a" * 300, False), ((1 << 33) - 1, b"b" * 100, False), (5, b"c" * 100, False)]


def test_transport_loss(spark):
    rows = mpegts.decode(mpegts.packets(files(spark, transport(lose=True))))
    got = mpegts.elementary_packets(rows, mpegts.elementary_streams(rows)).orderBy("unit").collect()
    assert [r["discontinuity"] for r in got][-2:] == [True, False]


def test_transport_faults(spark):
    good = transport()
    for name, change in (("sync byte", {0: 0x46}), ("scrambled", {3: 0xC0}), ("adaptation field", {3: 0x30, 4: 200})):
        data = bytearray(good)
        for i, b in change.items():
            data[3 * 188 + i] = b  # the second packet of the first unit
        rows = mpegts.decode(mpegts.packets(files(spark, data)))
        assert [(r["n"], r["error"]) for r in mpegts.faults(rows).collect()] == [(3, name)]
        got = mpegts.elementary_packets(rows, mpegts.elementary_streams(rows)).orderBy("unit").collect()
        assert [r["error"] is None for r in got] == [False, True, True] and got[1]["discontinuity"]


def test_transport_tables(spark):
    def streams(*parts):
        data = b"".join(packet(pid, i % 16, b"\0" + s, True) for i, (pid, s) in enumerate(parts))
        rows = mpegts.decode(mpegts.packets(files(spark, data)))
        return [(r["pid"], r["error"]) for r in mpegts.programs(rows).collect()], mpegts.elementary_streams(rows).count()

    one, two = section(0, struct.pack(">HH", 1, 0xE100)), section(0, struct.pack(">HHHH", 1, 0xE100, 2, 0xE110))
    pmt = section(2, struct.pack(">HH", 0xE101, 0xF000) + struct.pack(">BHH", 0x1B, 0xE101, 0xF000))
    assert streams((0, one), (0x100, pmt)) == ([(0x100, None)], 1)
    assert streams((0, two), (0x100, pmt)) == ([(0x100, "several programs")], 0)
    other = section(0, struct.pack(">HH", 1, 0xE120))
    assert streams((0, one), (0, one), (0, other), (0x100, pmt)) == ([(None, "conflicting sections")], 0)
    for body in (struct.pack(">BHH", 0x1B, 0xE101, 0xF002) + b"\x05\x09", struct.pack(">BHH", 0x1B, 0xE101, 0xF000) * 2, struct.pack(">BHH", 0x1B, 0xE001, 0xF000)):
        with pytest.raises(bits.Invalid):
            containers.program_streams(section(2, struct.pack(">HH", 0xE101, 0xF000) + body))
    with pytest.raises(bits.Unsupported):
        containers.program_streams(section(2, struct.pack(">HH", 0xE101, 0xF004) + b"\x09\x02ab"))


def test_crc(spark):
    assert containers.crc32_mpeg(b"123456789") == 0x0376E6E7
    df = spark.createDataFrame([(bytearray(b"123456789"),)], "b binary")
    assert df.select(integer.crc32_mpeg(df.b)).head()[0] == 0x0376E6E7


def test_bits():
    assert bits.ebml_id(b"\x1a\x45\xdf\xa3") == (0x1A45DFA3, 4)
    assert bits.ebml_size(b"\x81") == (1, 1) and bits.ebml_size(b"\xff") == (None, 1) and bits.ebml_size(b"\x40\x02") == (2, 2)
    assert bits.base128(b"\x3f") == (63, 1) and bits.base128(b"\x81\x00") == (128, 2)
    assert bits.u255(b"\xfd\x01\x00") == (256, 3) and bits.u255(b"\xff\x01") == (254, 2) and bits.u255(b"\xfe\x00") == (506, 2)
    b = bits.Bits(bytes([0b10100110, 0b01000010]))
    assert [b.ue(), b.ue(), b.se(), b.ue()] == [0, 1, -1, 3]
    assert bits.Bits(b"\xe5\x8e\x26").leb128() == 624485
    assert bits.LowBits(b"\x05").read(3) == 5
    for bad in (b"", b"\x00"):
        with pytest.raises(bits.Invalid):
            bits.ebml_id(bad)


def test_opus():
    assert bitstreams.opus_packet(bytes([31 << 3]) + b"x")["samples"] == 960
    p = bitstreams.opus_packet(bytes([0 << 3 | 3, 0x80 | 2, 1]) + b"abc")
    assert p["frames"] == [b"a", b"bc"] and p["samples"] == 960
    assert bitstreams.opus_packet(bytes([1]) + b"abcd")["frames"] == [b"ab", b"cd"]
    with pytest.raises(bits.Invalid):
        bitstreams.opus_packet(bytes([1]) + b"abc")


def test_units(spark):
    obu = bytes([0x12, 0x00]) + bytes([0x0A, 0x03]) + b"abc"
    assert [(r["kind"], bytes(r["payload"])) for r in readers.units(files(spark, obu), "av1").orderBy("n").collect()] == [(2, b""), (1, b"abc")]
    nals = struct.pack(">I", 2) + b"\x67a" + struct.pack(">I", 3) + b"\x65bc"
    assert [r["kind"] for r in readers.units(files(spark, nals), "avc4").orderBy("n").collect()] == [7, 5]
    stream = b"\0\0\0\1\x09\xf0\0\0\1\x67a\0\0\1\x68b\0\0\1\x65c\0\0\1\x09\xf0\0\0\1\x41d"
    groups = bitstreams.annex_b_units(stream)
    assert [len(g) for g in groups] == [4, 2]
    assert [bitstreams.independent(g) for g in groups] == [True, False]
    frames = b"aaabb"
    index = bytes([0xC1, 3, 2, 0xC1])
    assert bitstreams.superframe(frames + index) == [b"aaa", b"bb"]
    assert bitstreams.unescaped(b"\x67\0\0\3\1") == b"\0\0\1"


def test_headers(spark):
    adts = bytes([0xFF, 0xF1, 0x50, 0x80, 0x02, 0x1F, 0xFC]) + b"\0" * 9
    h = bitstreams.adts_header(adts)
    assert (h["object_type"], h["rate"], h["channels"], h["frame_length"], h["header_length"]) == (2, 44100, 2, 16, 7)
    assert bitstreams.aac_config(b"\x12\x10") == {"object_type": 2, "rate": 44100, "channels": 2, "frame_length": 1024}
    vp8 = bytes([0x10, 0, 0, 0x9D, 1, 0x2A]) + struct.pack("<HH", 320 | 1 << 14, 180)
    v = bitstreams.vp8_header(vp8)
    assert (v["key"], v["shown"], v["width"], v["x_scale"]) == (True, True, 320, 1)
    r = readers.headers(files(spark, adts, b"nothing at all"), "adts").orderBy("file_id").collect()
    assert r[0]["rate"] == 44100 and r[1]["error"].startswith("Invalid")


def test_codes():
    assert bitstreams.huffman_codes([2, 4, 4, 4, 4, 2, 3, 3]) == [0b00, 0b0100, 0b0101, 0b0110, 0b0111, 0b10, 0b110, 0b111]
    for bad in ([1, 1, 1], [2, 2]):
        with pytest.raises(bits.Invalid):
            bitstreams.huffman_codes(bad)
    n, k = 4, 3
    total = bitstreams.pvq_counts(n, k)[k]
    seen = {tuple(bitstreams.pvq_unrank(n, k, i)) for i in range(total)}
    assert len(seen) == total and all(sum(map(abs, v)) == k for v in seen)


def png(w: int, h: int, kind: int, rows: list[bytes]) -> bytes:
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_images(spark):
    plain = png(1, 1, 6, [b"\0" + bytes([200, 100, 50, 128])])
    assert images.png_rgba(plain) == (1, 1, bytes([100, 50, 25, 128]))
    px = np.random.default_rng(1).integers(0, 256, (5, 4, 3), dtype=np.uint8)
    flat = np.concatenate([np.zeros((5, 12), np.uint8)[:1], px.reshape(5, 12)])
    rows = []
    for y in range(5):
        line, up = flat[y + 1].astype(int), flat[y].astype(int)
        left, corner = np.concatenate([[0] * 3, line[:-3]]), np.concatenate([[0] * 3, up[:-3]])
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0 * line, left, up, (left + up) // 2, paeth][y]
        rows.append(bytes([y]) + ((line - guess) % 256).astype(np.uint8).tobytes())
    w, h, rgba = images.png_rgba(png(4, 5, 2, rows))
    assert np.array_equal(np.frombuffer(rgba, np.uint8).reshape(5, 4, 4)[..., :3], px)
    gif, bmp = b"GIF89a" + struct.pack("<HH", 7, 9), b"BM" + b"\0" * 16 + struct.pack("<ii", 3, -4)
    both = files(spark, plain, gif, bmp, b"?")
    assert [(r["format"], r["width"], r["height"]) for r in readers.image_info(both).orderBy("file_id").collect()] == [("png", 1, 1), ("gif", 7, 9), ("bmp", 3, 4), (None, None, None)]
    assert readers.native_headers(files(spark, plain, gif)).orderBy("file_id").collect()[1]["width"] == 7


def avif_file(rotation: int = 1) -> bytes:
    ispe, irot = full("ispe", struct.pack(">II", 320, 180)), box("irot", bytes([rotation]))
    ipma = full("ipma", struct.pack(">IHB", 1, 1, 2) + bytes([0x81, 2]))
    infe = full("infe", struct.pack(">HH4s", 1, 0, b"av01") + b"\0", 2)
    iloc = full("iloc", bytes([0x44, 0]) + struct.pack(">HHHHII", 1, 1, 0, 1, 8, 4))
    meta = full("meta", full("pitm", struct.pack(">H", 1)) + full("iinf", struct.pack(">H", 1) + infe) + iloc + box("iprp", box("ipco", ispe + irot) + ipma))
    return box("ftyp", b"avif" + b"\0" * 4 + b"mif1") + meta


def test_avif(spark):
    assert images.is_avif(avif_file()) and images.dimensions(avif_file()) == (180, 320) and images.dimensions(avif_file(2)) == (320, 180)
    r = readers.avif_items(files(spark, avif_file())).head()
    assert (r["item"], r["type"], r["is_primary"], r["properties"]) == (1, "av01", True, ["ispe", "irot"])
    assert images.avif_payload(avif_file(), images.avif_items(avif_file()), 1) == avif_file()[8:12]


def test_fonts(spark):
    tables = [(t, bytes(range(20)) * 3) for t in ("head", "cmap", "hhea", "hmtx", "glyf")]
    font = fonts.build_sfnt(0x10000, tables)
    fonts.validate_sfnt(font)
    rows, body = b"", b""
    for tag, _, offset, length in fonts.sfnt_directory(font):
        raw = font[offset : offset + length]
        packed = zlib.compress(raw)
        packed = packed if len(packed) < len(raw) else raw
        rows += struct.pack(">4sIIII", tag.encode(), 44 + 20 * len(tables) + len(body), len(packed), len(raw), fonts.checksum(raw))
        body += packed + b"\0" * (-len(packed) % 4)
    head = b"wOFF" + struct.pack(">IIHHI", 0x10000, 44 + len(rows) + len(body), len(tables), 0, len(font)) + b"\0" * 24
    assert fonts.woff1(head + rows + body) == font
    assert readers.font_tables(files(spark, head + rows + body)).count() == 5
    with pytest.raises(bits.Invalid):
        fonts.validate_sfnt(font[:-1] + b"\1")
    assert fonts.permitted_embedding(0) and fonts.permitted_embedding(8) and not fonts.permitted_embedding(2) and not fonts.permitted_embedding(0x200)
    assert fonts.root_permits(["http://a.test/x"], "http://a.test/x/y") and not fonts.root_permits(["http://a.test/x"], "http://a.test/xy")
    assert fonts.cvt_values(b"\0\3" + bytes([5, 238, 0xFF, 0x00, 250, 1])) == [5, -251, 464]


def bmp(w: int, h: int, bits_: int, rows: list[bytes], palette: bytes = b"", down: bool = False) -> bytes:
    body = b"".join(r + b"\0" * (-len(r) % 4) for r in (rows if down else rows[::-1]))
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", start + len(body), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, -h if down else h, 1, bits_, 0, len(body), 0, 0, len(palette) // 4, 0) + palette + body


def gif(w: int, h: int, pixels: bytes, palette: bytes, place=None, interlaced: bool = False, clear: int | None = None) -> bytes:
    """Codes of one width only: the dictionary is cleared before it grows."""
    size = max(2, (len(palette) // 3 - 1).bit_length())
    x, y, pw, ph = place or (0, 0, w, h)
    held = bits_ = 0
    packed = bytearray()
    for i, p in enumerate(pixels):
        for code in ([1 << size] if i % (1 << size >> 1) == 0 else []) + [p] + ([(1 << size) + 1] if i + 1 == len(pixels) else []):
            held |= code << bits_
            bits_ += size + 1
            while bits_ >= 8:
                packed.append(held & 255)
                held, bits_ = held >> 8, bits_ - 8
    packed.append(held)
    blocks = b"".join(bytes([len(packed[i : i + 255])]) + packed[i : i + 255] for i in range(0, len(packed), 255)) + b"\0"
    extension = b"" if clear is None else b"\x21\xf9\x04\x01\0\0" + bytes([clear]) + b"\0"
    table = palette + bytes(3 * (1 << size) - len(palette))
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | (size - 1), 0, 0) + table + extension + b"\x2c" + struct.pack("<HHHHB", x, y, pw, ph, 0x40 if interlaced else 0) + bytes([size]) + blocks + b"\x3b"


def test_bmp_pixels(spark):
    w, h, rgba = images.bmp_rgba(bmp(3, 2, 24, [bytes(range(9)), bytes(range(20, 29))]))
    assert (w, h) == (3, 2) and rgba[:8] == bytes([2, 1, 0, 255, 5, 4, 3, 255]) and rgba[12:16] == bytes([22, 21, 20, 255])
    assert images.bmp_rgba(bmp(3, 2, 24, [bytes(range(9)), bytes(range(20, 29))], down=True))[2] == rgba
    palette = bytes([1, 2, 3, 0, 9, 8, 7, 0])
    assert images.bmp_rgba(bmp(10, 1, 1, [b"\x80\x40"], palette))[2] == bytes([7, 8, 9, 255]) + bytes([3, 2, 1, 255]) * 8 + bytes([7, 8, 9, 255])
    assert images.bmp_rgba(bmp(3, 1, 4, [b"\x10\x10"], palette))[2][:8] == bytes([7, 8, 9, 255, 3, 2, 1, 255])
    whole = bmp(2, 2, 32, [bytes(8), bytes(8)])
    for cut in range(2, len(whole)):
        with pytest.raises(bits.Invalid):
            images.bmp_rgba(whole[:cut])
    with pytest.raises(bits.Invalid):
        images.bmp_rgba(bmp(4, 1, 8, [b"\0\1\2\0"], palette))


def test_gif_pixels(spark):
    rng = np.random.default_rng(0)
    palette = bytes(rng.integers(0, 256, 48, np.uint8))
    pixels = rng.integers(0, 16, (9, 7), np.uint8)
    colours = np.frombuffer(palette, np.uint8).reshape(-1, 3)
    w, h, rgba = images.gif_rgba(gif(7, 9, pixels.tobytes(), palette))
    got = np.frombuffer(rgba, np.uint8).reshape(9, 7, 4)
    assert (w, h) == (7, 9) and (got[..., :3] == colours[pixels]).all() and (got[..., 3] == 255).all()
    order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, 9, step)]
    assert images.gif_rgba(gif(7, 9, pixels[order].tobytes(), palette, interlaced=True))[2] == rgba
    part = np.frombuffer(images.gif_rgba(gif(10, 12, pixels.tobytes(), palette, place=(2, 3, 7, 9), clear=5))[2], np.uint8).reshape(12, 10, 4)
    assert (part[3:, 2:9, 3] == np.where(pixels == 5, 0, 255)).all() and not part[:3].any()
    # a code that stands for what is just being added, by hand: clear, 1, 6 (1 1), 7 (1 1 1), end
    codes = sum(c << (3 * i) for i, c in enumerate((4, 1, 6))) | 7 << 9 | 5 << 12
    assert images._unpacked(codes.to_bytes(4, "little"), 2, 6) == b"\1" * 6
    whole = gif(7, 9, pixels.tobytes(), palette)
    for cut in range(6, len(whole) - 3, 5):
        with pytest.raises(bits.Invalid):
            images.gif_rgba(whole[:cut])
    rows = readers.image_pixels(files(spark, whole, bmp(1, 1, 24, [b"abc"]), b"\xff\xd8\xff")).orderBy("file_id").collect()
    assert [(r["width"], r["height"]) for r in rows] == [(7, 9), (1, 1), (None, None)] and rows[2]["error"].startswith("Unsupported")


def test_font_facts(spark):
    os2, head = bytes(8) + b"\0\x08" + bytes(70), bytes(50) + b"\0\1" + bytes(2)
    font = fonts.build_sfnt(0x10000, [("OS/2", os2), ("head", head)])
    row = readers.font_facts(files(spark, font)).head()
    assert (row["fs_type"], row["wide_offsets"], row["error"]) == (8, True, None)
    bare = readers.font_facts(files(spark, fonts.build_sfnt(0x10000, [("name", b"abcd")]))).head()
    assert (bare["fs_type"], bare["wide_offsets"]) == (None, None)


def test_woff2_trailer():
    def file(metadata=(0, 0), private=(0, 0), body=b""):
        head = b"wOF2" + bytes(4) + struct.pack(">I", 48 + len(body)) + bytes(16) + struct.pack(">II", *metadata) + bytes(4) + struct.pack(">II", *private)
        return head + body

    assert fonts.woff2_trailer(file()) == {"metadata": None, "private": None}
    assert fonts.woff2_trailer(file((48, 5), (56, 3), b"abcde\0\0\0xyz")) == {"metadata": (48, 53), "private": (56, 59)}
    for bad in (file((49, 3), body=b"abcd"), file((48, 5), (56, 3), b"abcde\0!\0xyz"), file((48, 5), (60, 1), b"abcde" + bytes(8)), file((48, 9), body=b"abcd"), file((48, 0), body=b"abcd"), file((48, 4), body=b"abcdXYZ!")):
        with pytest.raises(bits.Invalid):
            fonts.woff2_trailer(bad)


def test_sections_of_many_files_spread_over_tasks(spark):
    """Sections of small files are put together in as many tasks as there are shuffle partitions, not in one."""
    data = transport()
    rows = mpegts.decode(mpegts.packets(spark.createDataFrame([(f"f{i}", data) for i in range(64)], "file_id string, content binary")))
    assert mpegts.sections(rows.where("pid = 0")).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = mpegts.elementary_streams(mpegts.decode(mpegts.packets(files(spark, data)))).count()
    assert mpegts.elementary_streams(rows).count() == 64 * one > 0
