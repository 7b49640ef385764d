"""Transforms, formats, decoding and streaming."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrel.functions import tables as T
from quadrel.operators import blocks, decoder, formats, motion, scan, streams
from quadrel.operators.readers import DecodeError
from quadrel.plans import catalog, decode_queries
from quadrel.sources import carriers, synth
from quadrel.streaming.decode import decode_stream

TABLES = synth.made_up_tables()


def payload(k, n=120):
    return random.Random(k).randbytes(n)


def test_inverse_transform_vectors():
    c = np.zeros((2, 64), np.int64)
    c[0, 0] = 800
    c[1, [0, 1, 8]] = 800, -100, 60
    out = blocks.idct_numpy(c)
    assert (out[0] == 25).all()
    assert out[1, :8].tolist() == [23, 24, 25, 27, 28, 30, 31, 32] and out[1, 56:].tolist() == [18, 19, 20, 22, 23, 25, 26, 27]


def test_transform_forms_agree(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3000, 3000, 64).tolist()) for i in range(50)] + [(99, [30000] * 64)]
    df = spark.createDataFrame(rows, "block_id long, coeffs array<long>")
    broken = spark.createDataFrame([(7, None), (8, [1]), (9, [None] * 64), (10, [])], df.schema)
    for form in (lambda d: blocks.idct_batch(d), lambda d: d.select("block_id", blocks.idct(F.col("coeffs")).alias("out"))):
        assert {(r["block_id"], r["out"]) for r in form(broken).collect()} == {(k, None) for k in (7, 8, 9, 10)}
    cols = {r["block_id"]: r["out"] for r in df.select("block_id", blocks.idct(F.col("coeffs")).alias("out")).collect()}
    batch = {r["block_id"]: r["out"] for r in blocks.idct_batch(df.union(broken)).where("out is not null").collect()}
    assert batch == cols
    dc = df.select("block_id", blocks.idct_dc(F.get("coeffs", F.lit(0))).alias("dc")).collect()
    only = np.zeros((len(rows), 64), np.int64)
    only[:, 0] = [r[1][0] for r in rows]
    assert [r["dc"] for r in dc] == blocks.idct_numpy(only)[:, 0].tolist()


def test_prediction_forms_agree(spark):
    rng = np.random.default_rng(2)
    plane = rng.integers(0, 256, (8, 8))
    df = spark.createDataFrame([(plane.reshape(-1).tolist(),)], "pixels array<long>")
    area = plane[np.ix_(*[np.clip(np.arange(-2, 10), 0, 7)] * 2)].astype(np.int64)
    taps = TABLES.taps[5]
    for mx, my in ((0, 3), (5, 0), (3, 6)):
        got = df.select(motion.interpolate(F.col("pixels"), mx, my).alias("o")).first()["o"]
        assert got == decoder.two_tap(area, mx, my).reshape(-1).tolist()
        got = df.select(motion.interpolate(F.col("pixels"), mx, my, (taps[mx], taps[my])).alias("o")).first()["o"]
        assert got == decoder.four_tap(area, taps[mx], taps[my]).reshape(-1).tolist()
    for mx, my, chosen in ((3, 0, None), (0, 3, None), (5, 6, None), (3, 0, (taps[3], taps[0])), (0, 6, (taps[0], taps[6])), (3, 6, (taps[3], taps[6])), (0, 0, (taps[0], taps[0]))):
        got = motion.interpolate_batch(df.select(F.lit(1).cast("long").alias("block_id"), "pixels"), mx, my, chosen).first()["out"]
        assert got == df.select(motion.interpolate(F.col("pixels"), mx, my, chosen).alias("o")).first()["o"]
    odd = spark.createDataFrame([(1, None), (2, [1])], "block_id long, pixels array<long>")
    assert [r["out"] for r in motion.interpolate_batch(odd, 1, 1).collect()] == [None, None]
    assert df.select(motion.edge_block(F.col("pixels"), -2, -2).alias("o")).first()["o"] == area.reshape(-1).tolist()


def test_neighbour_vectors_equal_the_decoder(spark):
    rng = random.Random(4)
    rows = [(p, x, y, rng.randrange(3), rng.choice((0, 0, 1, -2)), rng.choice((0, 3))) for p in range(3) for y in range(5) for x in range(6)]
    rows += [(9, 0, 0, 1, 4, 4), (9, 1, None, 1, 4, 4), (9, 1, 0, 1, None, 4), (9, 0, 1, 1, 0, 0)]
    grid = spark.createDataFrame(rows, "pkt_no long, mb_x long, mb_y long, ref_id long, mv_x long, mv_y long")
    out = {(r["pkt_no"], r["mb_x"], r["mb_y"]): tuple(r)[3:] for r in motion.neighbour_vectors(grid).collect()}
    assert len(out) == len(rows) and out[9, 0, 1] == (1, 4, 4, 0, 0, 4, 4) and out[9, 1, 0] == (0,) * 7
    d = decoder.Decoder(TABLES)
    d.mb_w, d.mb_h = 6, 5
    mode_of = {0: 0, 1: 1, 2: 6}
    for p in range(3):
        d.info = [(mode_of[r[3]], (r[4], r[5])) for r in rows if r[0] == p]
        for _, x, y, ref, *_ in (r for r in rows if r[0] == p):
            n, nearest, near, predicted = d._neighbours(x, y, ref)
            assert out[p, x, y] == (n, *nearest, *near, *predicted)


def test_format_names(spark):
    names = {r["name"]: r["s"] for r in formats.pixel_formats(spark).select("name", formats.short_name(F.col).alias("s")).collect()}
    assert names["rgb565"] == "bgr565le" and names["pal8"] == "pal8" and names["yuv420"] == "yuv422p" and names["yuva410"] == "yuva410p"


def test_scan_orders(spark):
    df = spark.createDataFrame([(list(T.SCAN_BANDS),), (list(T.INTERLACED_SCAN_BANDS),)], "b array<long>")
    plain, interlaced = (r["s"] for r in df.select(scan.scan_from_bands(F.col("b")).alias("s")).collect())
    assert plain == list(range(64)) and interlaced[:10] == [0, 2, 1, 3, 4, 5, 8, 9, 10, 11]


def status_of(packets, **kw):
    d = decoder.Decoder(TABLES, **kw)
    return [streams.decode_row(d, "s", i, p)[2] for i, p in enumerate(packets)]


def test_packet_statuses():
    intra, inter = synth.header(True, 20, payload=payload(1)), synth.header(False, 20, payload=payload(2))
    assert status_of([intra, inter]) == ["OK", "OK"]
    assert status_of([inter]) == ["MissingReference"]
    assert status_of([b"", b"abc", None, b"\0" * 3]) == ["InvalidData"] * 4
    for second in (5 << 3, 9 << 3, 7 << 3 | 1 << 1):
        assert status_of([bytes([40, second]) + intra[2:]]) == ["InvalidData"]
    assert status_of([intra[:2] + b"\0\6" + intra[4:]]) == ["InvalidData"]
    assert status_of([synth.header(True, 20, mb_w=0, payload=payload(1))]) == ["InvalidData"]
    assert status_of([synth.header(True, 20, mb_w=9, payload=payload(1))], most_blocks=4) == ["InvalidData"]


def test_status_query_decodes_packets_of_many_blocks(spark, tmp_path):
    """A text that is a valid intra packet of over 4 macroblocks."""
    rng = random.Random(3)
    small, large = decoder.Decoder(TABLES, most_blocks=4), decoder.Decoder(TABLES, most_blocks=60)
    while True:
        text = bytes([41, 7 << 3, 0, 60, *(rng.randrange(1, 128) for _ in range(300))])
        if large.starts_group(text, len(text)) and not small.starts_group(text, len(text)):
            if status_of([text]) == ["OK"]:
                break
    rows = [(1, 0, text.decode()), (2, 0, "no packet")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {(r["status"], r["frame_type"]): r["n"] for r in decode_queries.decode_status(spark, str(tmp_path)).collect()}
    assert out[("OK", "I")] == 1 and sum(out.values()) == 2


def test_truncated_packets():
    intra = synth.header(True, 20, payload=payload(3))
    # Range-coded data goes on with zeros past its end; Huffman codes do not.
    assert status_of([intra[: len(intra) - 100]]) == ["OK"]
    coded = synth.header(True, 20, mb_w=4, mb_h=4, payload=b"\xa5\x5a", huffman=True)
    assert status_of([coded]) in (["ShortData"], ["InvalidData"])


def test_failed_intra_frame_clears_the_references():
    intra, inter = synth.header(True, 20, payload=payload(1)), synth.header(False, 20, payload=payload(2))
    broken = synth.header(True, 20, mb_w=4, mb_h=4, payload=b"\xa5\x5a", huffman=True)
    assert status_of([intra, broken, inter])[2] == "MissingReference"


def test_inter_frame_without_residual_repeats_the_last():
    """With an all-zero model choice, a frame of unmoved macroblocks and no coefficients is its reference."""
    d = decoder.Decoder(TABLES)
    _, first = d.decode(synth.header(True, 20, 2, 2, payload=payload(5)))
    frame = {p: np.zeros_like(v) for p, v in first.items()}
    for y in range(2):
        for x in range(2):
            d._predict(frame, first, x, y, [(0, 0)] * 4, False, 8, False)
    assert all((frame[p] == first[p]).all() for p in first)


def test_dimension_change_and_flush():
    d = decoder.Decoder(TABLES)
    for w, h in ((1, 1), (3, 2), (1, 2)):
        _, frame = d.decode(synth.header(True, 9, w, h, payload=payload(w)))
        assert frame[0].shape == (16 * h, 16 * w) and frame[1].shape == (8 * h, 8 * w)
    d.flush()
    with pytest.raises(DecodeError) as error:
        d.decode(synth.header(False, 9, payload=payload(1)))
    assert error.value.status == "MissingReference"


def test_alpha_layer_and_golden_merge():
    """Each layer's golden planes are its own: all four cases of inter frames."""
    d = decoder.Decoder(TABLES, has_alpha=True)
    layer = lambda k, intra=True, golden=False: synth.header(intra, 9, 1, 1, payload=payload(k), golden=golden)
    _, frame = d.decode(synth.with_alpha(layer(1), layer(2)))
    assert set(frame) == {0, 1, 2, 3} and d.golden[3] is frame[3] and d.golden[0] is frame[0]
    alone = decoder.Decoder(TABLES)
    _, colour = alone.decode(layer(1))
    assert (frame[1] == colour[1]).all()
    assert status_of([b"\0\0\0" + layer(1)], has_alpha=True) == ["InvalidData"]
    seen, k = set(), 3
    while len(seen) < 4:
        k += 1
        golden = k % 2 == 0, k // 2 % 2 == 0
        before = dict(d.golden)
        try:
            _, frame = d.decode(synth.with_alpha(layer(k, False, golden[0]), layer(k + 500, False, golden[1])))
        except DecodeError:
            continue
        for plane in range(4):
            assert d.golden[plane] is (frame[plane] if golden[plane == 3] else before[plane])
            assert d.last[plane] is frame[plane]
        seen.add(golden)


def test_batch_decoding_is_sequential_decoding(spark):
    events = spark.createDataFrame([(i, i % 3) for i in range(60)], "event_id long, user_id long")
    packets = synth.packets(events)
    frames = streams.decode_streams(packets, TABLES)
    got = {(r["stream_id"], r["pkt_no"]): (r["status"], r["frame_type"], r["y"], r["v"]) for r in frames.collect()}
    by_stream = {}
    for r in sorted(packets.collect(), key=lambda r: r["pkt_no"]):
        d = by_stream.setdefault(r["stream_id"], decoder.Decoder(TABLES))
        row = streams.decode_row(d, str(r["stream_id"]), r["pkt_no"], r["data"])
        assert got[row[0], row[1]] == (row[2], row[3], row[6], row[8])
    assert sum(s == "OK" for s, *_ in got.values()) > 20
    planes = streams.planes(frames)
    assert planes.where("octet_length(data) != width * height").count() == 0


def test_formats_are_subclasses(spark):
    """A format of its own: one interpolator for all, and no filtered edges."""
    used = []

    class Plain(decoder.Decoder):
        interpolators = dict.fromkeys(decoder.INTERPOLATORS, lambda area, mx, my, taps: used.append((mx, my)) or np.full((8, 8), 77))

    d = Plain(TABLES)
    source = np.zeros((16, 16), np.uint8)
    target = source.copy()
    for mv in ((0, 0), (3, 1), (64, -9)):
        d.compensate(target, source, 8, 0, mv, 8, True)
    assert used == [(0, 0), (6, 2), (0, 6)] and (target[:8, 8:] == 77).all() and not target[:, :8].any()

    class Grey(decoder.Decoder):
        def read_block(self, r, values, models, scan, plane, flags):
            values[0] = 0

        def parse(self, data):
            h, r = super().parse(data)
            h.use_huffman = False
            return h, r

    packets = spark.createDataFrame([("s", 0, synth.header(True, 20, 1, 1, payload=payload(1)))], carriers.PACKETS)
    frame = streams.decode_streams(packets, TABLES, kind=Grey).first()
    # The chroma planes start from 128 units of the quantiser, luma from none.
    assert frame["status"] == "OK" and set(frame["y"]) == {128} and len(set(frame["u"])) == 1


def test_groups_in_parallel_equal_streams_in_order(spark):
    rng = random.Random(7)
    rows = []
    for stream in ("a", "b", None):
        for n in range(40):
            data = synth.header(n % 7 == 3, rng.randrange(64), 1 + n % 2, 1, version=6 + n % 3, payload=payload(n), huffman=n % 5 == 0)
            if n % 6 == 5:
                data = rng.choice([b"", data[:3], bytes([data[0]]) + rng.randbytes(9), data[:20]])
            rows.append((stream, n, data))
    rng.shuffle(rows)
    packets = spark.createDataFrame(rows, carriers.PACKETS)
    key = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert key(streams.decode_groups(packets, TABLES)) == key(streams.decode_streams(packets, TABLES))


def test_streaming_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 2) for i in range(24)], "event_id long, user_id long")
    packets = synth.packets(events).select(F.col("stream_id").cast("string").alias("stream_id"), "pkt_no", "data").orderBy("pkt_no")
    rows = packets.collect()
    for k in range(3):
        spark.createDataFrame(rows[k * 8 : k * 8 + 8], packets.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    spark.createDataFrame(rows[:1], packets.schema).coalesce(1).write.parquet(str(tmp_path / "in" / "part=9"))
    source = spark.readStream.schema(carriers.PACKETS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = decode_stream(source, TABLES).writeStream.format("memory").queryName("frames").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["stream_id"], r["pkt_no"], r["status"], r["y"]) for r in spark.table("frames").collect()}
    expected = {(r["stream_id"], r["pkt_no"], r["status"], r["y"]) for r in streams.decode_streams(packets, TABLES).collect()}
    assert len([g for g in got if g[2] == "OutOfOrder"]) == 1
    assert {g for g in got if g[2] != "OutOfOrder"} == expected


def test_stream_and_alpha_queries(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 3) for i in range(40)] + [(None, 1), (90, None)], "event_id long, user_id long")
    events.write.parquet(str(tmp_path / "events.parquet"))
    rows = lambda name: sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
    assert rows("stream_decode") == rows("decode_gop") == rows("decode_gop_parallel") and len(rows("decode_gop")) == 40
    alpha = rows("decode_alpha")
    assert len(alpha) == 40 and sum(r[2] == "OK" for r in alpha) > 5


def test_packet_files(spark, tmp_path):
    for stream in ("a", "b"):
        (tmp_path / stream).mkdir()
        for n in (1, 2):
            (tmp_path / stream / f"{n}.bin").write_bytes(f"{stream}{n}".encode())
    out = {(r["stream_id"], r["pkt_no"], bytes(r["data"])) for r in carriers.read_packet_files(spark, str(tmp_path)).collect()}
    assert out == {(s, n, f"{s}{n}".encode()) for s in "ab" for n in (1, 2)}


def test_catalog_names():
    assert len(catalog.QUERIES) > 35 and set(catalog.ORACLES) <= set(catalog.QUERIES)
