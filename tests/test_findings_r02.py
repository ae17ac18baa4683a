"""What the second round's findings named, against SQL or plain versions."""

import gc
import hashlib
import math
import random
import weakref

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barline.llm import media
from barline.operators import stats
from barline.plans import relational, sequential, studies
from barline.streaming import streams


def test_forecasts_round_as_sql_does(spark):
    """One share on sf0.01 is 323 / 640, whose double lies below the half that its decimals show."""
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet'")
    want = {(s, str(day)): tuple(rest) for s, day, *rest in con.execute(studies.ORACLE_SQL["baseline_forecasts"]).fetchall()}
    got = {(r["symbol"], str(r["day"])): (r["expanding"], r["last50"], r["majority"]) for r in studies.QUERIES["baseline_forecasts"](spark, folder).collect()}
    assert got == want


def test_fills_meet_by_spans_of_time_and_lose_none(spark, tmp_path):
    """The join's keys hold a span of time, and events at the ends of the interval and of a span count as in SQL."""
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_100) + s)
    steps = F.when(F.col("id") % 3 == 0, F.col("id") * 100).otherwise(F.col("id") * 300)  # many at whole quarters of an hour
    e = spark.range(400).select(F.col("id").alias("event_id"), at(steps).cast("timestamp_ntz").alias("ts"), F.when(F.col("id") % 7 > 0, F.format_string("k%d", F.col("id") % 2)).alias("event_type"), F.col("id").cast("double").alias("value"))
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(sequential.ORACLE_SQL["stream_interval_fills"]).fetchall())
    assert want and sorted(map(tuple, sequential.QUERIES["stream_interval_fills"](spark, str(tmp_path)).collect())) == want
    rows = spark.read.parquet(f"{tmp_path}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    plan = streams.fills(rows.where("event_id % 10 = 0"), rows.where("event_id % 10 <> 0"), "event_type")._jdf.queryExecution().optimizedPlan().toString()
    assert "_s#" in plan.split("Join Inner", 1)[1].split("\n", 1)[0]


def test_block_means_by_chunks_are_plain_means(spark, monkeypatch):
    """Blocks that run on in the next chunk and past the end, slices of draws, groups smaller than a block, a value that is not finite."""
    monkeypatch.setattr(stats, "SPAN", 16)
    monkeypatch.setattr(stats, "DRAWS", 7)
    rng = random.Random(3)
    groups = {g: [rng.uniform(-9, 9) for _ in range(n)] for g, n in (("a", 100), ("b", 33), ("c", 5), ("d", 1))}
    groups["b"][20] = math.inf
    x = spark.createDataFrame([(g, i, v) for g, vs in groups.items() for i, v in enumerate(vs)], "g string, i int, v double")
    for block, circular in ((8, True), (8, False), (1, True), (20, True)):
        got = {(r["g"], r["sample"]): r["mean"] for r in stats.block_means(x, ["g"], "v", ["i"], 3, block, circular).collect()}
        want = {}
        for g, vs in groups.items():
            n, b = len(vs), min(block, len(vs))
            for sample in range(3):
                start = lambda k: int(hashlib.md5(f"42:{sample}:{k}".encode()).hexdigest()[:8], 16) % (n if circular else n - b + 1)  # noqa: B023, E731
                want[g, sample] = sum(vs[(start(k) + o) % n] for k in range(-(-n // b)) for o in range(min(b, n - k * b))) / n
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_cosine_search_of_copies_nulls_and_zero_vectors(spark, tmp_path):
    """Equal vectors tie by id also across blocks; zero vectors (nan) come first and null ones last, as in SQL."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(7)]) for i in range(420)]
    rows = [(i, rows[3][1] if i % 5 == 0 else [2 * v for v in rows[7][1]] if i % 11 == 0 else e) for i, e in rows]
    rows = [(i, [0.0] * 7 if i in (17, 200) else None if i in (18, 300) else e) for i, e in rows] + [(100, rows[6][1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    text = lambda rows: sorted((int(a), int(b), str(s)) for a, b, s in rows)
    want = text(con.execute(relational.ORACLE_SQL["cosine_topk"]).fetchall())
    assert text(relational.QUERIES["cosine_topk"](spark, str(tmp_path)).collect()) == want


def test_pictures_come_in_small_batches(spark):
    """A batch of vectors makes pictures that take 18 times its bytes, so they leave in parts, in order; null vectors too."""
    rows = pa.record_batch({"vec_id": pa.array(range(700)), "embedding": pa.array([None if i == 300 else [i / 64.0] * 8 for i in range(700)], pa.list_(pa.float64()))})
    parts = list(media._pictures(96)(iter([rows])))
    assert max(p.num_rows for p in parts) <= media.DRAWN < 700
    told = pa.Table.from_batches(parts)
    assert told.column("image_id").to_pylist() == list(range(700)) and told.column("pixels").null_count == 1
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert media.copies(spark.createDataFrame([], "image_id long, width int, height int, pixels binary")).count() == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_images_that_share_only_crowded_words_are_linked(spark, monkeypatch):
    """Every 32-bit word of a table is in entries of far over CROWD images, and copies share no longer key: they meet in no
    entry, and are linked by the round over all pairs, whether it takes one block or several."""
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 32, 8, dtype=np.uint64).astype(np.uint32)
    images = {}
    for i in range(60):
        place = np.column_stack([rng.uniform(10, 90, (40, 2)), rng.uniform(0, 360, 40), np.ones(40)]).astype("<f4")
        word = rng.integers(0, 1 << 32, (40, 8), dtype=np.uint64).astype(np.uint32)
        word[:, ::2] = rng.choice(pool, (40, 4))
        images[i] = place, word
    for i in range(6):  # every second word differs by a bit: copies to the verification, not to keys of 64 bits or more
        place, word = images[i]
        other = word.copy()
        other[:, 1::2] ^= np.uint32(1) << rng.integers(0, 32, (40, 4), dtype=np.uint32)
        images[100 + i] = place[:30] + np.float32([5, -3, 0, 0]), other[:30]
    rows = [(i, len(p), p.tobytes(), w.tobytes(), media.neighbours(p).tobytes()) for i, (p, w) in images.items()]
    found = spark.createDataFrame(rows, "image_id long, n_points long, places binary, bits binary, near binary").repartition(3).cache()
    pairs, crowded = media.candidates(found)
    assert crowded and not {(r["a"], r["b"]) for r in pairs.collect()} & {(i, 100 + i) for i in range(6)}
    none = spark.createDataFrame([], "node long, component_id long")
    for block in (media.BLOCK, 700):
        monkeypatch.setattr(media, "BLOCK", block)
        links = [(r["a"], r["b"]) for r in media.rest(found, none).collect()]
        assert sorted((min(x), max(x)) for x in links) == [(i, 100 + i) for i in range(6)]
    joined = spark.createDataFrame([(100, 0), (0, 0)], "node long, component_id long")
    assert sorted((min(r), max(r)) for r in media.rest(found, joined).collect()) == [(i, 100 + i) for i in range(1, 6)]


def test_a_block_finds_edited_copies_whatever_the_groups_size():
    """All pairs of drawn pictures, which share corners, with edits of them; a group of 40 near copies becomes one component."""
    rng = np.random.default_rng(21)
    vectors = pa.record_batch({"vec_id": pa.array(range(60)), "embedding": pa.array(rng.normal(0, 1, (60, 64)).tolist(), pa.list_(pa.float64()))})
    drawn = [np.frombuffer(p, np.uint8).reshape(96, 96) for b in media._pictures(96)(iter([vectors])) for p in b.column(3).to_pylist()]
    clip = lambda x: np.clip(np.rint(x), 0, 255).astype(np.uint8)
    edits = [drawn[i][10:87, 9:86] for i in range(15)] + [clip(drawn[i] * 0.7 + 20) for i in range(15)] + [clip(drawn[i] + rng.normal(0, 6, (96, 96))) for i in range(15)]
    group = [clip(drawn[59] + rng.normal(0, 2, (96, 96))) for _ in range(40)]
    rows = []
    for at, p in enumerate([*drawn, *edits, *group]):
        place, bits = media.describe(p[None])[0]
        rows.append({"image_id": at, "root": at, "block": at % 2, "n_points": len(place), "places": place.astype("<f4").tobytes(), "bits": bits.tobytes(), "near": media.neighbours(place.astype("<f4")).tobytes()})
    links = []
    for number in range(2):
        block = pa.Table.from_pylist([r for r in rows if r["block"] == number])
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, block.schema) as writer:
            writer.write_table(block)
        told = media._against(f"test-{number}", type("Sent", (), {"value": out.getvalue().to_pybytes()}), number)
        links += [(r["a"], r["b"]) for b in told(iter(pa.Table.from_pylist([r for r in rows if r["block"] >= number]).to_batches(max_chunksize=25))) for r in b.to_pylist()]
    of = {60 + k: k % 15 for k in range(45)} | {105 + k: 59 for k in range(40)}
    assert all(of.get(a, a) == of.get(b, b) for a, b in links) and len(links) <= 2 * (len(rows) - 60)
    joined = {i: i for i in range(len(rows))}
    for _ in rows:
        for a, b in links:
            joined[a] = joined[b] = min(joined[a], joined[b])
    assert sum(joined[a] == joined[i] for a, i in of.items() if a < 105) >= 0.95 * 45 and all(joined[a] == 59 for a in of if a >= 105)


def _blob(table):
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _described(count, copies, seed):
    """Rows of drawn pictures and so many noisy copies of the first."""
    rng, rows = np.random.default_rng(seed), []
    vectors = pa.record_batch({"vec_id": pa.array(range(count)), "embedding": pa.array(rng.normal(0, 1, (count, 64)).tolist(), pa.list_(pa.float64()))})
    drawn = [np.frombuffer(p, np.uint8).reshape(96, 96) for b in media._pictures(96)(iter([vectors])) for p in b.column(3).to_pylist()]
    drawn += [np.clip(np.rint(drawn[0] + rng.normal(0, 2, (96, 96))), 0, 255).astype(np.uint8) for _ in range(copies)]
    for at, p in enumerate(drawn):
        place, bits = media.describe(p[None])[0]
        place = place.astype("<f4")
        rows.append({"image_id": at, "root": at, "block": 0, "n_points": len(place), "places": place.tobytes(), "bits": bits.tobytes(), "near": media.neighbours(place).tobytes()})
    return pa.Table.from_pylist(rows)


def test_a_worker_keeps_no_block_after_its_task():
    """Spark keeps more workers than tasks run and takes them in turn: a block that each keeps filled an executor."""
    rows, made = _described(8, 2, 3), []
    told = media._against("kept", type("Sent", (), {"value": _blob(rows)}), 0)
    build = media._Block.__init__

    def noted(self, *args):
        build(self, *args)
        made.append(weakref.ref(self))

    media._Block.__init__ = noted
    try:
        assert sum(b.num_rows for b in told(iter(rows.to_batches())))
    finally:
        media._Block.__init__ = build
    gc.collect()
    assert len(made) == 1 and made[0]() is None


def test_meetings_of_one_image_with_a_large_group_come_in_parts(monkeypatch):
    """An image that meets a large group in more than MEETINGS points is met in parts of the group, each pair in one part, and the
    same pairs are found."""
    rows = _described(20, 60, 4)
    block, others = media._Block(rows), media._Images(rows.combine_chunks().to_batches()[0])
    whole = sorted((int(i), int(j)) for i, j in block.candidates(others, 0))
    monkeypatch.setattr(media, "MEETINGS", 4000)
    seen, most = set(), 0
    for p, q in block.meetings(others):
        pairs = set(zip(block.images.image[p].tolist(), others.image[q].tolist(), strict=True))
        assert not pairs & seen
        seen |= pairs
        most = max(most, len(p))
    assert most < 3 * 4000 and len(whole) > 60 * 50 / 2
    assert sorted((int(i), int(j)) for i, j in block.candidates(others, 0)) == whole
