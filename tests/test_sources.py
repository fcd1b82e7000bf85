"""The fixed-width reader, content pins and the store."""

from __future__ import annotations

import gzip
import hashlib
import shutil

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from returnwise import schemas
from returnwise.operators.transactions import load_summary
from returnwise.sources import checksum, fixed_width, publication, store as stored
from returnwise.sources.fixed_width import Field, FixedWidthFormatError, Layout
from returnwise.sources.publication import Publication
from returnwise.sources.store import MissingStage, Store

GOOD = [
    " 00001 19970101  1   11.77",
    " 00002 19970112  1   12.00",
    " 00002 19970112  5   77.00",
    " 00002 19970112  5   77.00",
    " 00003 19970102  2    0.00",
]


def write(tmp_path, text, name="lines.txt"):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_good_lines_keep_duplicates_zeroes_and_line_numbers(spark, tmp_path):
    parsed = fixed_width.read_transactions(spark, write(tmp_path, "\n".join(GOOD) + "\n"))
    rows = parsed.orderBy("_line_number").collect()
    assert [r["_line_number"] for r in rows] == [1, 2, 3, 4, 5]
    assert [r["customer_id"] for r in rows] == [1, 2, 2, 2, 3]
    assert [str(r["gross_amount"]) for r in rows] == ["11.77", "12.00", "77.00", "77.00", "0.00"]
    assert str(rows[0]["order_date"]) == "1997-01-01" and rows[4]["quantity"] == 2
    assert rows[0]["_source_file"] == "lines.txt"
    raw = fixed_width.raw_transactions(parsed)
    assert [(f.name, f.dataType) for f in raw.schema] == [
        (f.name, f.dataType) for f in schemas.RAW_TRANSACTIONS
    ]
    summary = load_summary(raw.withColumn("source", F.lit("x"))).first()
    assert (summary["rows"], summary["customers"]) == (5, 3)


@pytest.mark.parametrize(
    "line,message",
    [
        (GOOD[0][:20], "width 20 instead of 26"),
        ("", "width 0 instead of 26"),
        (GOOD[0] + " ", "width 27 instead of 26"),
        ("X" + GOOD[0][1:], "column 0 should be blank"),
        (GOOD[0][:15] + "7" + GOOD[0][16:], "column 15 should be blank"),
        (GOOD[0][:3] + "x" + GOOD[0][4:], "could not read customer_id"),
        (GOOD[0].replace(" 1 ", " z "), "could not read quantity"),
        (GOOD[0].replace("11.77", "1.1.7"), "could not read gross_amount"),
        (GOOD[0].replace("19970101", "19971332"), "could not read order_date"),
        (GOOD[0].replace("19970101", "1997 101"), "could not read order_date"),
        (GOOD[0].replace("11.77", "é1.77"), "non-ASCII"),
    ],
)
def test_a_malformed_line_fails_the_load_by_number(spark, tmp_path, line, message):
    text = "\n".join([GOOD[0], GOOD[1], line, GOOD[2]]) + "\n"
    with pytest.raises(FixedWidthFormatError, match=f"line 3: .*{message}"):
        fixed_width.read_transactions(spark, write(tmp_path, text))


def test_an_empty_file_is_refused(spark, tmp_path):
    with pytest.raises(FixedWidthFormatError, match="empty"):
        fixed_width.read_transactions(spark, write(tmp_path, ""))


def test_permissive_mode_separates_rejects(spark, tmp_path):
    path = write(tmp_path, "\n".join([GOOD[0], "short", GOOD[1]]) + "\n")
    good, rejects = fixed_width.read_transactions_permissive(spark, path)
    assert [r["_line_number"] for r in good.orderBy("_line_number").collect()] == [1, 3]
    row = rejects.first()
    assert (row["_line_number"], row["value"]) == (2, "short")


def test_line_numbers_survive_splits_and_several_files(spark, tmp_path):
    body = [f" {c:05d} 19970101  1 {c / 100:7.2f}" for c in range(1, 4001)]
    write(tmp_path, "\n".join(body) + "\n", "one.txt")
    write(tmp_path, "\n".join(body[:700]) + "\n", "two.txt")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        lines = fixed_width.read_numbered_lines(spark, str(tmp_path))
        wrong = fixed_width.parse_lines(lines).where("customer_id <> _line_number").count()
        assert wrong == 0 and lines.count() == 4700
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_numbering_lines_moves_none_of_them(spark, tmp_path):
    write(tmp_path, " 00001 19970101  1   11.77\n", "one.txt")
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        lines = fixed_width.read_numbered_lines(spark, str(tmp_path))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set(setting, before)


@pytest.mark.parametrize(
    "separators,fields",
    [
        ((0,), (Field("a", 1, 3, "int"), Field("b", 2, 5, "int"))),
        ((0,), (Field("a", 1, 3, "int"),)),
        ((0, 1), (Field("a", 1, 5, "int"),)),
    ],
)
def test_a_layout_must_tile_the_line(separators, fields):
    with pytest.raises(ValueError, match="tile"):
        Layout(5, separators, fields)


def test_rendered_lines_read_back(spark, random_lines):
    tx, frame = random_lines
    path_rows = fixed_width.render_lines(tx).withColumns(
        {"_source_file": F.lit("f"), "_line_number": F.lit(1)}
    )
    parsed = fixed_width.parse_lines(path_rows)
    assert parsed.where("error is not null").count() == 0
    total = parsed.agg(F.sum("gross_amount")).first()[0]
    assert int(total * 100) == frame["cents"].sum()


def test_content_pins(spark, tmp_path):
    path = write(tmp_path, "abc", "a.txt")
    good = hashlib.sha256(b"abc").hexdigest()
    checksum.require_pinned(spark, path, {"a.txt": good})
    with pytest.raises(checksum.ChecksumMismatch, match="a.txt"):
        checksum.require_pinned(spark, path, {"a.txt": "0" * 64})
    with pytest.raises(checksum.ChecksumMismatch, match="missing.txt"):
        checksum.require_pinned(spark, path, {"a.txt": good, "missing.txt": good})
    with pytest.raises(checksum.ChecksumMismatch):
        checksum.require_pinned(spark, path, {})


def predictions(spark, source, value, customers=3):
    rows = [
        (source, c, h, value, 0.5, 10.0, value * 10, None, None, "conditional", True, "map")
        for c in range(customers)
        for h in (273, 365)
    ]
    return spark.createDataFrame(rows, schemas.PREDICTIONS)


def test_a_refit_replaces_its_source_and_leaves_the_other(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    both = predictions(spark, "a", 1.0).unionByName(predictions(spark, "b", 2.0))
    assert stored.write_predictions(store, both) == 12
    assert stored.write_predictions(store, predictions(spark, "a", 5.0, customers=2)) == 4
    got = store.read(stored.PREDICTIONS).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.max("expected_purchases").alias("v")
    )
    assert {(r["source"], r["n"], r["v"]) for r in got.collect()} == {("a", 4, 5.0), ("b", 6, 2.0)}


def fitted(spark, source, value):
    parameters = [(source, "map", "bg_nbd", "r", value)]
    return spark.createDataFrame(parameters, schemas.MODEL_PARAMETERS)


def held(store):
    """What a reader sees of each source: the forecast and the parameter."""
    rows = store.read(stored.PREDICTIONS).groupBy("source").agg(F.max("expected_purchases").alias("v")).collect()
    return {r["source"]: (r["v"], stored.read_parameters(store, r["source"], "map", "bg_nbd")["r"]) for r in rows}


def test_a_publication_is_seen_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for source in ("007", "7"):
        with Publication(store) as made:
            stored.write_predictions(store, predictions(spark, source, 1.0), made)
            stored.write_parameters(store, fitted(spark, source, 1.0), made)
            assert made.read(stored.PREDICTIONS).count() == 6
    assert held(store) == {"007": (1.0, 1.0), "7": (1.0, 1.0)}
    before = store.read(stored.PREDICTIONS, "7")
    with pytest.raises(ZeroDivisionError), Publication(store) as made:
        stored.write_predictions(store, predictions(spark, "7", 2.0), made)
        assert held(store)["7"] == (1.0, 1.0)
        1 / 0
    assert held(store) == {"007": (1.0, 1.0), "7": (1.0, 1.0)}
    with Publication(store) as made:
        stored.write_predictions(store, predictions(spark, "7", 3.0), made)
        stored.write_parameters(store, fitted(spark, "7", 3.0), made)
        with pytest.raises(ValueError, match="already part"):
            stored.write_predictions(store, predictions(spark, "7", 4.0), made)
        with pytest.raises(ValueError, match="stored as"):
            Publication(store).stage(stored.PREDICTIONS, fitted(spark, "7", 4.0))
    assert held(store) == {"007": (1.0, 1.0), "7": (3.0, 3.0)}
    # A reader that began before the switch still reads what it saw.
    assert before.agg(F.max("expected_purchases")).first()[0] == 1.0
    plan = store.read(stored.PREDICTIONS, "7")._jdf.queryExecution().executedPlan().toString()
    assert "array_join(array(" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_overlapping_publications_do_not_mix(spark, tmp_path):
    """Both commit in the same turn: one of them wins for every part."""
    store = Store(spark, str(tmp_path / "store"))
    one, two = Publication(store), Publication(store)
    for made, value in ((one, 1.0), (two, 2.0)):
        stored.write_predictions(store, predictions(spark, "a", value), made)
        stored.write_parameters(store, fitted(spark, "a", value), made)
    two.commit()
    one.commit()
    assert held(store) == {"a": (1.0, 1.0)}
    log = publication.manifest(store).withColumn("turn", F.lit(1).cast("long"))
    tied = Store(spark, str(tmp_path / "tied"))
    for relation in (stored.PREDICTIONS, stored.PARAMETERS):
        shutil.copytree(publication.folder(store, relation), publication.folder(tied, relation))
    log.write.parquet(publication.folder(tied, "manifest"))
    winner = 1.0 if one.version > two.version else 2.0
    assert held(tied) == {"a": (winner, winner)}


def test_a_full_refresh_takes_parts_away(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    stored.write_parameters(store, fitted(spark, "a", 1.0).union(fitted(spark, "b", 2.0)))
    store.overwrite(stored.PARAMETERS, fitted(spark, "b", 3.0))
    assert [tuple(r) for r in store.read(stored.PARAMETERS).select("source", "value").collect()] == [("b", 3.0)]
    stored.write_parameters(store, fitted(spark, "a", 4.0))
    assert store.read(stored.PARAMETERS).count() == 2


def test_superseded_versions_are_retired(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for value in (1.0, 2.0, 3.0):
        stored.write_predictions(store, predictions(spark, "a", value))
    stored.write_predictions(store, predictions(spark, "b", 9.0))
    assert publication.retire(store) == 0
    assert publication.retire(store, hours=-1) == 2
    got = store.read(stored.PREDICTIONS).groupBy("source").agg(F.max("expected_purchases").alias("v"))
    assert {tuple(r) for r in got.collect()} == {("a", 3.0), ("b", 9.0)}


def test_a_changed_shape_is_refused_before_writing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    df = predictions(spark, "a", 1.0)
    store.replace_sources("model.x", df)
    with pytest.raises(ValueError, match="stored as"):
        store.replace_sources("model.x", df.drop("fit_method"))
    with pytest.raises(ValueError, match="fit_method"):
        stored.write_predictions(store, df.drop("fit_method"))
    assert store.read("model.x").count() == 6


def test_missing_stages_are_named(spark, tmp_path):
    store = Store(spark, str(tmp_path / "nothing"))
    with pytest.raises(MissingStage, match="run the fit stage first"):
        stored.require_predictions(store)
    with pytest.raises(MissingStage, match="run the transform stage first"):
        stored.load_calibration(store, "a")
    with pytest.raises(MissingStage, match="run the fit stage"):
        stored.write_fit_run(store, predictions(spark, "a", 1.0))


def test_parameters_are_kept_per_method(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))

    def rows(method, value):
        return spark.createDataFrame(
            [("s", method, "bg_nbd", "r", value)], schemas.MODEL_PARAMETERS
        )

    stored.write_parameters(store, rows("laplace_sir", 1.0))
    stored.write_parameters(store, rows("map", 2.0))
    stored.write_parameters(store, rows("map", 3.0))
    assert stored.read_parameters(store, "s", "laplace_sir", "bg_nbd") == {"r": 1.0}
    assert stored.read_parameters(store, "s", "map", "bg_nbd") == {"r": 3.0}
    with pytest.raises(MissingStage, match="no stored"):
        stored.read_parameters(store, "s", "map", "pareto_nbd")


def test_a_full_refresh_drops_sources_it_no_longer_has(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    both = predictions(spark, "a", 1.0).unionByName(predictions(spark, "7", 2.0))
    store.overwrite("main.x", both)
    assert {r["source"] for r in store.read("main.x").collect()} == {"a", "7"}
    store.overwrite("main.x", predictions(spark, "7", 3.0))
    kept = store.read("main.x", "7")
    assert kept.count() == store.read("main.x").count() == 6
    assert kept.schema["source"].dataType.simpleString() == "string"
    plan = store.read("main.x", "7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan


def test_large_files_are_hashed_as_they_are_read(spark, tmp_path, monkeypatch):
    generator = np.random.default_rng(4)
    mark, noise = b"\xef\xbb\xbf", generator.bytes(300_000)
    contents = {
        "noise.parquet": noise, "noise_ends.parquet": noise + b"\n", "marked.csv": mark + noise,
        "marked_ends.csv": mark + noise + b"\r\n\n", "two_marks.csv": mark + mark + b"\n" * 5000,
        "one_line.bin": b"\0" * 200_000, "feeds.bin": b"\n" * 3000, "short.txt": b"ab\n",
        "odd [1] name%20.txt": b"\r\n\xff" * 900, "packed.gz": gzip.compress(noise),
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(checksum, "STREAMED", 1000)
    monkeypatch.setattr(checksum, "LINES", 7)
    expected = {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}
    found = checksum.file_checksums(spark, f"{tmp_path}/*").collect()
    assert {r.file_name: (r.size_bytes, r.sha256) for r in found} == expected and len(found) == len(contents)
    # None but the short files and the packed one are ever held whole.
    whole = spark.read.format("binaryFile").load(f"{tmp_path}/*").where(checksum._held_whole())
    assert {r.path.rsplit("/", 1)[1] for r in whole.select("path").collect()} == {"short.txt", "packed.gz"}
    # A file dealt to several tasks is an error, never a digest of a part.
    run = checksum._line_digests()
    part = pa.RecordBatch.from_pydict({"path": ["d/p"], "size": [90], "line": [b"abc\n"]})
    with pytest.raises(ValueError, match="one task"):
        list(run([part]))
    both = pa.concat_batches([part.slice(0, 1), pa.RecordBatch.from_pydict(
        {"path": ["d/q"], "size": [3], "line": [b"xyz\n"]})])
    small = both.set_column(1, "size", pa.array([4, 3]))
    assert [r["file_name"] for b in run([small]) for r in b.to_pylist()] == ["p", "q"]
