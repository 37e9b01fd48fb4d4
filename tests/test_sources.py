import json
import os
import struct
import sys
import zlib

import numpy as np
import pytest
import test_extract
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cardloom.functions import kernels, text
from cardloom.operators import correction
from cardloom.operators.picture_functions import register_detector
from cardloom.sources import decoding, pictures
from cardloom.streaming import cards, numbers

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def png(x, filters=(0,), colour=2, bits=8, palette=None):
    """A PNG file of rows filtered in turn."""
    h, w = x.shape[:2]
    data = x.reshape(h, -1).astype(">u2" if bits == 16 else np.uint8)
    flat = np.frombuffer(data.tobytes(), np.uint8).reshape(h, -1).astype(int)
    step = flat.shape[1] // w
    lines, above = [], np.zeros(flat.shape[1], int)
    for y, line in enumerate(flat):
        left = np.concatenate([np.zeros(step, int), line[:-step]])
        corner = np.concatenate([np.zeros(step, int), above[:-step]])
        p = left + above - corner
        nearest = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        kind = filters[y % len(filters)]
        lines.append(bytes([kind]) + ((line - (0, left, above, (left + above) // 2, nearest)[kind]) % 256).astype(np.uint8).tobytes())
        above = line

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0)) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def noise(*shape):
    return np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)


def test_png_of_all_kinds():
    x = noise(11, 7, 3)
    for filters in ((0,), (1,), (2,), (3,), (4,), (4, 3, 2, 1, 0)):
        assert (decoding.decode(png(x, filters)) == x[..., ::-1]).all()
    assert (decoding.decode(png(noise(5, 4, 4), (4, 1), colour=6)) == noise(5, 4, 4)[..., 2::-1]).all()
    assert (decoding.decode(png(noise(5, 4), colour=0)) == noise(5, 4)[..., None]).all()
    assert (decoding.decode(png(noise(5, 4).astype(int) * 257, (1, 2), colour=0, bits=16)) == noise(5, 4)[..., None]).all()
    palette = noise(9, 3)
    assert (decoding.decode(png(noise(5, 4) % 9, colour=3, palette=palette)) == palette[noise(5, 4) % 9][..., ::-1]).all()


@pytest.mark.parametrize("data", [None, b"", b"%PDF", b"BM", png(noise(3, 3, 3))[:60], b"\x89PNG\r\n\x1a\n"])
def test_what_is_no_picture(data):
    with pytest.raises(decoding.PictureError, match="empty" if not data else "Could not decode"):
        decoding.decode(data)


def test_shapes_that_are_no_pictures():
    for shape in ((3, 3, 2), (3, 3, 5), (3,)):
        with pytest.raises(ValueError, match="Unsupported image shape"):
            kernels.to_bgr(np.zeros(shape, np.uint8))


def test_rows_for_every_input(spark, tmp_path):
    (tmp_path / "in" / "sub.png").mkdir(parents=True)
    good = noise(6, 5, 3)
    (tmp_path / "in" / "b.PNG").write_bytes(png(good))
    (tmp_path / "in" / "a.jpg").write_bytes(b"")
    (tmp_path / "in" / "c.png").write_bytes(b"not a picture")
    (tmp_path / "in" / "notes.txt").write_text("not looked at")
    (tmp_path / "odd.bin").write_bytes(png(good))
    pictures.register(spark)
    paths = [str(tmp_path / "in"), str(tmp_path / "odd.bin"), str(tmp_path / "absent.png"), str(tmp_path / "in" / "[bs]*"), str(tmp_path / "*.none")]
    df = spark.read.format("cardloom_pictures").option("paths", json.dumps(paths)).option("partitionBytes", "9000").load()
    assert df.rdd.getNumPartitions() > 2
    rows = [(r.source, r.error, r.image and (r.image.height, r.image.width, bytes(r.image.data)) == (6, 5, good[..., ::-1].tobytes())) for r in df.collect()]
    where = str(tmp_path)
    assert rows == [
        ("a.jpg", decoding.EMPTY, None), ("b.PNG", None, True), ("c.png", decoding.UNDECODABLE, None), ("odd.bin", None, True), ("absent.png", f"File not found: {where}/absent.png", None),
        ("b.PNG", None, True), ("sub.png", f"Not a file: {where}/in/sub.png", None), ("*.none", f"File not found: {where}/*.none", None),
    ]
    assert spark.read.format("cardloom_pictures").load(where + "/in").count() == 3


def test_bytes_of_a_column(spark):
    df = spark.createDataFrame([(1, png(noise(4, 4, 3)), "mine"), (2, None, "b"), (3, b"x", None)], "id int, body binary, decoded string")
    rows = {r.id: r for r in decoding.with_images(df, "body", "id").collect()}
    assert rows[1].image.origin == "1" and rows[1].error is None and rows[1].decoded == "mine"
    assert (rows[2].error, rows[3].error, rows[2].image) == (decoding.EMPTY, decoding.UNDECODABLE, None)


def documents(folder):
    return [json.loads((folder / f).read_text()) for f in sorted(os.listdir(folder))]


def test_json_documents(spark, tmp_path):
    pictures.register(spark)
    rows = spark.createDataFrame([("محمد", None, (1, [0.5]), "a.png"), ("b", 2.5, None, "b.png")], "name string, sure double, part struct<x:int,y:array<double>>, source string").coalesce(1)
    rows.write.format("cardloom_json").mode("append").save(str(tmp_path / "many"))
    assert documents(tmp_path / "many") == [[{"name": "محمد", "sure": None, "part": {"x": 1, "y": [0.5]}, "source": "a.png"}, {"name": "b", "sure": 2.5, "part": None, "source": "b.png"}]]
    assert "محمد" in (tmp_path / "many" / os.listdir(tmp_path / "many")[0]).read_text()
    rows.limit(1).write.format("cardloom_json").mode("append").save(str(tmp_path / "one"))
    assert documents(tmp_path / "one")[0]["source"] == "a.png"
    rows.limit(1).write.format("cardloom_json").mode("overwrite").save(str(tmp_path / "many"))
    assert [d["name"] for d in documents(tmp_path / "many")] == ["محمد"]
    rows.limit(0).write.format("cardloom_json").mode("append").save(str(tmp_path / "none"))
    assert documents(tmp_path / "none") == []


def test_killed_writers_leave_nothing(spark, tmp_path):
    pictures.register(spark)
    broken = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 990, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("a"))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("cardloom_json").mode("append").save(str(tmp_path / "out"))
    # tasks that were still at work when the job was given up may leave what they wrote aside, but no document
    left = os.listdir(tmp_path / "out") if (tmp_path / "out").exists() else []
    assert all(name.startswith("_temporary-") for name in left)
    assert spark.read.text(str(tmp_path / "out")).count() == 0 if left else True


def test_detector_as_a_table_function(spark):
    register_detector(spark, "find_cards", test_extract.load_card, 0.5)
    test_extract.images(spark, ("a", test_extract.card()), ("b", None)).createOrReplaceTempView("pictures_at_hand")
    rows = spark.sql("SELECT p.card, b.* FROM pictures_at_hand p, LATERAL find_cards(p.image) b").collect()
    want = [b for b in test_extract.CardModel()(test_extract.card()) if b[1] >= 0.5]
    assert [(r.card, r.cls, r.confidence, r.x2) for r in rows] == [("a", b[0], b[1], b[4]) for b in want]


def test_restarted_streams_neither_lose_nor_repeat(spark, tmp_path):
    (tmp_path / "in").mkdir()
    as_of = F.lit("2026-01-01").cast("date")

    def arrive(*names):
        for n in names:
            (tmp_path / "in" / n).write_bytes(png(test_extract.card()[..., ::-1]) if n != "bad.png" else b"x")

    def run():
        stream = cards.picture_stream(spark, str(tmp_path / "in"), files_at_a_time=2)
        cards.record_stream(stream, test_extract.STUB, test_extract.SETTINGS, as_of, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination(120)
        return sorted((r.path.rpartition("/")[2], r.national_id.value, r.error) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    arrive("a.png", "bad.png", "c.png")
    good = "29001010100017"
    assert run() == [("a.png", good, None), ("bad.png", None, decoding.UNDECODABLE), ("c.png", good, None)]
    arrive("d.png")
    assert [r[0] for r in run()] == ["a.png", "bad.png", "c.png", "d.png"]


def test_each_word_is_corrected_once(spark):
    said = ["الزقازيف x احمد", None, "", "only latin", "  محمد   الزقازيف\tالزقازيف ", "xالزقازيفx محمدد", "ا" * 500]
    df = spark.createDataFrame([(k, t, "mine") for k, t in enumerate(said)] + [(0, said[0], "mine"), (None, "الزقازيف", "mine")], "id int, t string, fixes string")
    rows = correction.corrected(df, "t", F.lit("address"), "id", 85.0).collect()
    assert len(rows) == len(said) + 2 and all(r.fixes == "mine" for r in rows)
    for r in rows:
        assert r.corrected == (None if r.t is None else " ".join(text.suggest(w, "address", 85.0) for w in r.t.split()))
    assert any("الزقازيق" in (r.corrected or "") for r in rows)


def test_common_length_by_bits():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("abc"), int(rng.integers(0, 12)))) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert text._common_length(a, b) == table[-1, -1]


def test_numbers_of_a_stream(spark, tmp_path):
    rows = [("29001010100017", "a"), ("٢٩٠٠١٠١٠١٠٠٠١٧", "b"), (None, "c"), ("123", "d")]
    spark.createDataFrame(rows, "number string, digits string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("number string, digits string").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    numbers.validated(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(out).awaitTermination(60)
    got = {r.digits: r for r in spark.read.parquet(out).collect()}
    assert got["a"]._digits == got["b"]._digits == "29001010100017" and got["a"].decoded == got["b"].decoded and got["a"].validation.valid
    assert got["c"].validation.errors == ["no_digits"] and got["d"].validation.errors == ["expected 14 digits, found 3"] and got["d"].decoded is None
