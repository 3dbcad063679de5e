import gzip
import hashlib
import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from muster.operators.digest import file_digests
from muster.sinks.documents import write_json
from muster.sinks.text import write_lines, write_normalized_lines
from muster.sources import tree
from muster.sources.documents import read_json_documents, read_json_values
from muster.sources.files import list_files
from muster.sources.lines import as_lists, invalid_lines, line_order, part_number, read_lines


def lines_of(df):
    return [row.value for row in df.orderBy("file", "ord").collect()]


@pytest.mark.parametrize("strip", [True, False])
@pytest.mark.parametrize("skip", [True, False])
def test_lines_end_as_in_python(spark, tmp_path, strip, skip):
    path = tmp_path / "lines.txt"
    path.write_bytes("a\r\nb\rc\nd e\u000bf\n\n g \n  \nlast\u0085".encode())
    with open(path, encoding="utf-8", newline=None) as file:
        expected = [line.strip() if strip else line.rstrip("\r\n") for line in file.readlines()]
    expected = [line for line in expected if line or not skip]
    assert lines_of(read_lines(spark, str(path), strip_lines=strip, skip_empty_lines=skip)) == expected


def test_empty_file_has_no_lines(spark, tmp_path):
    (tmp_path / "empty.txt").write_bytes(b"")
    assert lines_of(read_lines(spark, str(tmp_path), skip_empty_lines=False)) == []


def test_byte_order_mark_stays(spark, tmp_path):
    (tmp_path / "bom.txt").write_bytes("﻿a\nb\n".encode())
    assert lines_of(read_lines(spark, str(tmp_path))) == ["﻿a", "b"]


def test_bad_utf8_raises_unless_asked(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"good\n\xff\xfe\n")
    with pytest.raises(PySparkException, match="INVALID_UTF8"):
        lines_of(read_lines(spark, str(tmp_path)))
    assert read_lines(spark, str(tmp_path), strict=False).count() == 2
    assert [bytes(row.value) for row in invalid_lines(spark, str(tmp_path)).collect()] == [b"\xff\xfe"]


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1", "utf-16-le", "utf-16-be", "utf-16"])
def test_encodings(spark, tmp_path, encoding):
    name = {"utf-16-le": "utf-16le", "utf-16-be": "utf-16be"}.get(encoding, encoding)
    text = "é\nb\r\n\n c\rlast"
    (tmp_path / "f.txt").write_bytes(text.encode(encoding))
    read = read_lines(spark, str(tmp_path), encoding=name, strip_lines=False, skip_empty_lines=False)
    assert lines_of(read) == ["é", "b", "", " c", "last"]


def test_order_over_many_splits(spark, tmp_path):
    content = [str(i) if i % 3 else "" for i in range(60_000)]
    (tmp_path / "many.txt").write_text("\n".join(content) + "\n")
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "5000b")
    try:
        read = read_lines(spark, str(tmp_path), skip_empty_lines=False, strip_lines=False)
        assert read.rdd.getNumPartitions() > 20
        assert lines_of(read) == content
        empty = tmp_path / "empty-lines.txt"
        empty.write_text("\n" * 50_000)
        places = spark.read.text(str(empty)).select(line_order(spark).alias("ord"))
        assert places.distinct().count() == 50_000
    finally:
        for key, value in saved.items():
            spark.conf.set(key, value)


def ids_frame(spark, lists):
    rows = [(name, place, value) for name, items in lists.items() for place, value in enumerate(items)]
    return spark.createDataFrame(rows, "dataset_id string, ord bigint, id string")


def parts_of(path, name):
    folder = path / f"dataset_id={name}"
    return b"".join(p.read_bytes() for p in sorted(folder.glob("part-*")))


def test_text_sink(spark, tmp_path):
    lists = {"007": ["b", " a", "b", " ", "10", "9"], "x": ["é"]}
    path = tmp_path / "out"
    for canonical, expected in ((False, "b\na\n10\n9\n"), (True, "10\n9\na\nb\n")):
        write_normalized_lines(ids_frame(spark, lists), str(path), "id", canonical_sort=canonical)
        assert parts_of(path, "007") == expected.encode()
    write_lines(ids_frame(spark, lists), str(path), line_ending="\r\n")
    assert parts_of(path, "007") == "b\r\n a\r\nb\r\n \r\n10\r\n9\r\n".encode()
    write_lines(ids_frame(spark, lists), str(path), encoding="latin-1")
    assert parts_of(path, "x") == b"\xe9\n"
    for encoding in ("latin-1", "utf-16le"):
        read = read_lines(spark, str(path), encoding=encoding, partitions="dataset_id string", skip_empty_lines=False)
        assert {row.dataset_id for row in read.collect()} == {"007", "x"}
    with pytest.raises(PySparkException, match="line break"):
        write_lines(ids_frame(spark, {"y": ["a\nb"]}), str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        write_lines(ids_frame(spark, lists), str(path), encoding="utf-16")


def test_one_list_per_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2\n1\n")
    (tmp_path / "b.txt").write_text("3\n")
    lists = as_lists(read_lines(spark, str(tmp_path)))
    assert lists.select("dataset_id").distinct().count() == 2
    assert lists.columns == ["dataset_id", "ord", "value"]


def test_json_sink_keeps_nulls_and_sorts_keys(spark, tmp_path):
    rows = spark.createDataFrame([("é", None, 1)], "z string, a string, m int")
    write_json(rows.coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text(encoding="utf-8") == '{"a":null,"m":1,"z":"é"}\n'


def test_json_documents(spark, tmp_path):
    for name, value in (("one", {"k": 1, "s": "é"}), ("two", {"k": 2, "s": None})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    rows = read_json_documents(spark, str(tmp_path), "k bigint, s string").orderBy("k").collect()
    assert [(row.k, row.s) for row in rows] == [(1, "é"), (2, None)]
    read = read_json_values(spark, str(tmp_path)).select(F.variant_get("value", "$.k", "int").alias("k"))
    assert sorted(row.k for row in read.collect()) == [1, 2]
    (tmp_path / "three.json").write_text("{broken")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_json_documents(spark, str(tmp_path), "k bigint, s string").collect()


def test_file_digests(spark, tmp_path):
    random.seed(1)
    text = b"line\n" * 400
    files = {
        "small": b"abc",
        "none": b"",
        "noise": bytes(random.randrange(256) for _ in range(5000)),
        "bom": b"\xef\xbb\xbf" + b"z\n" * 400,
        "flat": b"q" * (9 << 20),
        "packed.gz": gzip.compress(text),
        "a name/with %20 é.txt": text,
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "_SUCCESS").write_bytes(b"x")
    rows = file_digests(spark, str(tmp_path)).collect()
    found = {r.path.removeprefix(f"file:{tmp_path}/"): (r.length, r.sha256) for r in rows}
    assert found == {name: (len(content), hashlib.sha256(content).hexdigest()) for name, content in files.items()}
    only = file_digests(spark, f"file://{tmp_path}", pattern="*.gz").collect()
    assert [r.sha256 for r in only] == [hashlib.sha256(files["packed.gz"]).hexdigest()]


def test_files_are_listed_level_by_level(spark, tmp_path):
    """As a walk finds them, over uneven depths, a crowded folder and roots of every kind; hidden names and what is below them stay out."""
    expected = {}
    for n in range(300):
        folder = tmp_path / f"d{n % 7}" / "/".join(f"e {k}" for k in range(n % 4))
        for place in (folder / f"f{n}.txt", *([folder / f"_h{n}" / "x.txt", folder / f".h{n}.txt"] if n % 50 == 0 else [])):
            place.parent.mkdir(parents=True, exist_ok=True)
            place.write_bytes(b"z" * (n % 5))
        expected[str(folder / f"f{n}.txt")] = n % 5
    (tmp_path / "empty" / "er").mkdir(parents=True)

    def found(*roots, **options):
        rows = list_files(spark, list(roots), **options).collect()
        return {r.path.removeprefix("file:"): r.length for r in rows}, len(rows)

    assert found(str(tmp_path)) == (expected, 300)
    one = str(tmp_path / "d1" / "e 0" / "f1.txt")
    few = {p: n for p, n in expected.items() if p.startswith(f"{tmp_path}/d2/")} | {one: 1}
    assert found(f"file://{tmp_path}/d2", one, str(tmp_path / "empty")) == (few, len(few))
    assert found(str(tmp_path), pattern="f2?.txt")[1] == 10
    assert found(str(tmp_path / "empty")) == ({}, 0)
    with pytest.raises(FileNotFoundError):
        list_files(spark, str(tmp_path / "none"))


def test_a_failed_write_leaves_the_old_result(spark, tmp_path):
    path = tmp_path / "out"
    write_lines(ids_frame(spark, {"a": ["old"], "b": ["kept"]}), str(path))
    with pytest.raises(PySparkException, match="line break"):
        write_lines(ids_frame(spark, {"a": ["new", "x\ny"]}), str(path))
    assert parts_of(path, "a") == b"old\n"
    write_lines(ids_frame(spark, {"a": ["new"]}), str(path))
    assert (parts_of(path, "a"), parts_of(path, "b")) == (b"new\n", b"kept\n")
    write_normalized_lines(ids_frame(spark, {"a": [" "], "c": ["1"]}), str(path), "id")
    assert (parts_of(path, "a"), parts_of(path, "b"), parts_of(path, "c")) == (b"", b"kept\n", b"1\n")
    assert len(list((path / "dataset_id=a").glob("part-*"))) == 1
    documents = tmp_path / "json"
    write_json(spark.range(3), str(documents))
    with pytest.raises(Exception):
        write_json(spark.range(5).select(F.raise_error(F.lit("no")).alias("id")), str(documents))
    assert spark.read.json(str(documents)).count() == 3
    write_json(spark.range(5), str(documents))
    assert spark.read.json(str(documents)).count() == 5
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith("json.")) == ["json", "out"]


def test_part_files_in_order_of_their_numbers(spark):
    names = spark.createDataFrame([("/x/part-100000-a.txt",), ("/x/part-99999-a.txt",), ("/x/other",)], "file string")
    assert [r[0] for r in names.select(part_number()).collect()] == [100000, 99999, None]


def test_reading_one_dataset_reads_its_directory(spark, tmp_path):
    path = str(tmp_path / "out")
    write_lines(ids_frame(spark, {"a": ["1"], "b": ["2", "3"], "c d": ["\ufeff4"]}), path)
    read = read_lines(spark, path, partitions="dataset_id string", where="dataset_id = 'b'")
    assert lines_of(read) == ["2", "3"]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "dataset_id" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    marked = read_lines(spark, path, partitions="dataset_id string", where="dataset_id = 'c d'")
    assert lines_of(marked) == ["\ufeff4"]


def test_snapshot_directories_of_other_tools(spark, tmp_path):
    def put(place, manifest=None, ids=None):
        folder = tmp_path / place
        folder.mkdir(parents=True)
        if manifest is not None:
            (folder / "manifest.json").write_text(json.dumps(manifest, indent=2))
        if ids is not None:
            (folder / "list.txt").write_text(ids)

    put("one/latest", {"search_query": "q"}, "b\na\n")
    put("one/snapshots/2024-01-01T00-00-00Z__q_0", {"search_query": "p"}, " a\n\n")
    put("two+ä/latest", {"search_query": "r"})
    put("three/latest", None, "x\n")
    root = str(tmp_path)
    files = tree.tree_files(spark, root, ids_file="list.txt")
    state = {r.dataset_id: (r.has_manifest, r.has_ids, r.available) for r in tree.tree_state(files).collect()}
    assert state == {"one": (True, True, True), "two+ä": (True, False, False), "three": (False, True, False)}
    assert files.count() == 4
    queries = tree.tree_manifests(spark, root, "search_query string").collect()
    assert {(r.dataset_id, r.snapshot, r.search_query) for r in queries} == {
        ("one", "", "q"),
        ("one", "2024-01-01T00-00-00Z__q_0", "p"),
        ("two+ä", "", "r"),
    }
    ids = tree.tree_identifiers(spark, root, ids_file="list.txt").orderBy("dataset_id", "snapshot", "ord").collect()
    assert [(r.dataset_id, r.snapshot, r.id) for r in ids] == [
        ("one", "", "b"),
        ("one", "", "a"),
        ("one", "2024-01-01T00-00-00Z__q_0", "a"),
        ("three", "", "x"),
    ]
    with pytest.raises(FileNotFoundError, match="three"):
        tree.load_tree(spark, root, "search_query string", ids_file="list.txt")
    paths = {r.ids_path for r in tree.tree_paths(files, "/r").collect()}
    assert "/r/one/latest/ids.txt" in paths and "/r/one/snapshots/2024-01-01T00-00-00Z__q_0/ids.txt" in paths
