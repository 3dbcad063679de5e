import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from muster.operators import catalog as C
from muster.operators import pages as P
from muster.operators.manifest import assign_shards
from muster.plans import store
from muster.plans.commit import commit_pages, commit_snapshots
from muster.plans.resolve import activate, resolve

EARLY, LATE = "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"


def searches(spark, lists, stamp=EARLY, query="q", reported=None):
    rows = [(name, query, len(items) if reported is None else reported, stamp, "w", "1") for name, items in lists.items()]
    return spark.createDataFrame(
        rows,
        "dataset_id string, search_query string, reported_count bigint, retrieved_at_utc string, "
        "history_web_env string, history_query_key string",
    )


def frame(spark, lists):
    rows = [(name, place, value) for name, items in lists.items() for place, value in enumerate(items)]
    return spark.createDataFrame(rows, "dataset_id string, ord bigint, id string")


def name_of(stamp, query="q"):
    return stamp.replace(":", "-") + "__q_" + hashlib.sha256(query.encode()).hexdigest()[:12]


def lists_of(ids):
    found = {}
    for row in ids.orderBy("dataset_id", "snapshot", "id").collect():
        found.setdefault((row.dataset_id, row.snapshot), []).append(row.id)
    return found


def files_under(root):
    return sorted(str(p) for p in Path(root).rglob("*")) if Path(root).exists() else []


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def test_empty_store(spark, root):
    assert store.manifests(spark, root).count() == 0
    assert store.listing(spark, root).count() == 0
    assert C.most_recent_snapshot(store.listing(spark, root)).count() == 0
    with pytest.raises(FileNotFoundError):
        store.load_latest(spark, root, spark.createDataFrame([("d",)], "dataset_id string"))


def test_commit_and_load(spark, root):
    lists = {"007": [" b", "a", "b", "10", "9", " "], "none": [], "odd/na:me=[é] %": ["x\ny", "é"], "x": ["b", "a"]}
    made = commit_snapshots(spark, root, searches(spark, lists), frame(spark, lists))
    found, ids = store.load_latest(spark, root)
    snapshot = name_of(EARLY)
    assert lists_of(ids) == {
        ("007", snapshot): ["10", "9", "a", "b"],
        ("odd/na:me=[é] %", snapshot): ["x\ny", "é"],
        ("x", snapshot): ["a", "b"],
    }
    rows = {row.dataset_id: row for row in found.collect()}
    assert rows["007"].raw_count == 6 and rows["007"].normalized_count == 4
    assert rows["007"].ids_sha256 == hashlib.sha256(b"10\n9\na\nb").hexdigest()
    assert rows["none"].normalized_count == 0 and rows["none"].ids_sha256 == hashlib.sha256(b"").hexdigest()
    for name in lists:
        assert list(Path(rows[name].snapshot_directory).glob("part-*.parquet")), name
        assert Path(rows[name].manifest_path).is_dir()
    assert sorted(made.columns) == sorted(store.manifests(spark, root).columns)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    one = store.identifiers(spark, root, "x", snapshot).where("id = 'a'")
    assert one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("PushedFilters: ")
    assert "commit_seq" in filters[0] and "shard" in filters[0]
    assert "EqualTo(id,a)" in filters[1] and "EqualTo(dataset_id,x)" in filters[1]
    assert "dynamicpruning" in ids._jdf.queryExecution().executedPlan().toString()
    assert store.identifiers(spark, root, "none").count() == 0
    assert store.identifiers(spark, root, "x", "y").count() == 0


def test_long_lists_get_directories_of_their_own(spark, root, monkeypatch):
    lists = {"long/list=[é] %": [str(i) for i in range(100)], "short": ["1"], "007": ["2"], "none": []}
    monkeypatch.setitem(assign_shards.__kwdefaults__, "shard_bytes", 100)
    commit_snapshots(spark, root, searches(spark, lists), frame(spark, lists))
    found, ids = store.load_latest(spark, root)
    directories = {row.dataset_id: row.snapshot_directory for row in found.collect()}
    assert directories["short"] == directories["007"] != directories["long/list=[é] %"]
    for directory in set(directories.values()):
        assert list(Path(directory).glob("part-*.parquet")), directory
    assert {name: len(items) for (name, _), items in lists_of(ids).items()} == {
        "long/list=[é] %": 100,
        "short": 1,
        "007": 1,
    }
    assert store.identifiers(spark, root, "long/list=[é] %").count() == 100
    assert {r.dataset_id for r in store.listing(spark, root).where("complete").collect()} == set(lists)


def test_a_search_without_results_is_a_snapshot(spark, root):
    lists = {"none": []}
    commit_snapshots(spark, root, searches(spark, lists), frame(spark, {"x": ["a"]}).where("false"))
    found, ids = store.load_latest(spark, root)
    row = found.first()
    assert (row.raw_count, row.normalized_count) == (0, 0) and row.ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert ids.count() == 0 and store.listing(spark, root).first().complete
    assert [r.n_ids for r in C.snapshot_report(found, ids).collect()] == [0]


def test_list_order_and_policy_are_kept(spark, root):
    lists = {"d": ["b", "a", "b"]}
    commit_snapshots(spark, root, searches(spark, lists), frame(spark, lists), dedup=False, canonical_sort=False)
    found, ids = store.load_latest(spark, root)
    assert [row.id for row in ids.orderBy("ord").collect()] == ["b", "a", "b"]
    row = found.first()
    assert (row.dedup, row.canonical_sort) == (False, False)
    assert row.ids_sha256 == hashlib.sha256(b"b\na\nb").hexdigest()


def test_taken_names_raise_and_change_nothing(spark, root):
    lists = {"d": ["a"], "e": ["b"]}
    commit_snapshots(spark, root, searches(spark, lists), frame(spark, lists))
    before = files_under(root)
    with pytest.raises(FileExistsError):
        commit_snapshots(spark, root, searches(spark, {"e": ["c"]}), frame(spark, {"e": ["c"]}))
    twice = searches(spark, {"f": ["c"]}).unionAll(searches(spark, {"f": ["c"]}))
    with pytest.raises(FileExistsError):
        commit_snapshots(spark, root, twice, frame(spark, {"f": ["c"]}))
    two = searches(spark, {"f": ["c"]}).unionAll(searches(spark, {"f": ["c"]}, LATE))
    with pytest.raises(ValueError, match="several searches"):
        commit_snapshots(spark, root, two, frame(spark, {"f": ["c"]}))
    with pytest.raises(ValueError, match="without a search"):
        commit_snapshots(spark, root, searches(spark, {"f": ["c"]}), frame(spark, {"g": ["c"]}))
    with pytest.raises(ValueError, match="dataset_id"):
        commit_snapshots(spark, root, searches(spark, {"": ["c"]}), frame(spark, {"": ["c"]}))
    broken = searches(spark, {"f": ["c"]}).withColumn("history_web_env", F.lit(""))
    with pytest.raises(RuntimeError, match="session"):
        commit_snapshots(spark, root, broken, frame(spark, {"f": ["c"]}))
    assert files_under(root) == before


def test_latest_is_the_last_saved_as_latest(spark, root):
    for stamp, items, update in ((LATE, ["a"], True), (EARLY, ["b"], True), ("2024-01-03T00:00:00Z", ["c"], False)):
        commit_snapshots(spark, root, searches(spark, {"d": items}, stamp), frame(spark, {"d": items}), update_latest=update)
    assert lists_of(store.load_latest(spark, root)[1]) == {("d", name_of(EARLY)): ["b"]}
    recent = C.most_recent_snapshot(store.listing(spark, root)).first()
    assert recent.snapshot == name_of("2024-01-03T00:00:00Z")
    report = C.snapshot_report(*store.load_snapshots(spark, root, C.most_recent_snapshot(store.listing(spark, root))))
    assert [(r.n_ids, r.search_query) for r in report.collect()] == [(1, "q")]
    store.register_views(spark, root)
    assert spark.sql("SELECT snapshot FROM snapshot_catalog WHERE is_latest").first().snapshot == name_of(EARLY)
    assert spark.sql("SELECT count(*) AS n FROM identifiers").first().n == 3


def test_a_job_that_died_leaves_an_incomplete_snapshot(spark, root, monkeypatch):
    commit_snapshots(spark, root, searches(spark, {"d": ["a"]}), frame(spark, {"d": ["a"]}))

    def die(*args, **kwargs):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr("muster.plans.commit.write_json", die)
        with pytest.raises(KeyboardInterrupt):
            commit_snapshots(spark, root, searches(spark, {"d": ["b"]}, LATE), frame(spark, {"d": ["b"]}))
    state = {r.snapshot: (r.has_ids, r.has_manifest, r.complete) for r in store.listing(spark, root).collect()}
    assert state == {name_of(EARLY): (True, True, True), name_of(LATE): (True, False, False)}
    assert lists_of(store.load_latest(spark, root)[1]) == {("d", name_of(EARLY)): ["a"]}
    listing = store.listing(spark, root)
    assert C.most_recent_snapshot(listing).first().snapshot == name_of(LATE)
    assert C.most_recent_snapshot(listing, complete_only=True).first().snapshot == name_of(EARLY)
    with pytest.raises(FileNotFoundError):
        store.load_snapshots(spark, root, spark.createDataFrame([("d", name_of(LATE))], "dataset_id string, snapshot string"))
    with pytest.raises(FileExistsError):
        commit_snapshots(spark, root, searches(spark, {"d": ["b"]}, LATE), frame(spark, {"d": ["b"]}))
    after = "2024-01-04T00:00:00Z"
    made = commit_snapshots(spark, root, searches(spark, {"d": ["b"]}, after), frame(spark, {"d": ["b"]}))
    assert made.first().commit_seq == 3


def requests(spark, *rows):
    return spark.createDataFrame(rows, "dataset_id string, mode string, email string, search_query string")


def test_requests_of_every_kind(spark, root):
    def put(name, **options):
        commit_snapshots(spark, root, searches(spark, {name: ["a"]}), frame(spark, {name: ["a"]}), **options)

    put("whole")
    put("unmarked", update_latest=False)
    modes = ("create_new", "reuse_latest", "reuse_latest_or_create", "Reuse_Latest", None)
    rows = [(name, mode, email, "q") for name in ("whole", "unmarked") for mode in modes for email in ("e", None)]
    found = {(r.dataset_id, r.mode, r.email): r.outcome for r in resolve(spark, root, requests(spark, *rows)).collect()}
    for name, mode, email, _ in rows:
        if mode not in ("create_new", "reuse_latest", "reuse_latest_or_create"):
            expected = "invalid_mode"
        elif mode != "create_new" and name == "whole":
            expected = "reuse"
        elif mode == "reuse_latest":
            expected = "no_latest"
        else:
            expected = "create" if email else "email_required"
        assert found[(name, mode, email)] == expected
    stale = C.with_staleness(
        resolve(spark, root, requests(spark, ("whole", "reuse_latest", "", "q"), ("whole", "reuse_latest", "", "p"))),
        store.manifests(spark, root),
    )
    assert {r.search_query: r.stale for r in stale.collect()} == {"q": False, "p": True}


def test_states_of_a_damaged_store(spark):
    state = spark.createDataFrame(
        [
            ("whole", "s", True, True, True, True),
            ("no_manifest", "s", True, False, True, False),
            ("no_ids", "s", True, True, False, False),
            ("neither", "s", True, False, False, False),
        ],
        "dataset_id string, snapshot string, has_latest boolean, has_manifest boolean, has_ids boolean, available boolean",
    )
    names, modes = ("whole", "no_manifest", "no_ids", "neither", "none"), ("reuse_latest", "reuse_latest_or_create")
    asked = [(name, mode, True) for name in names for mode in modes]
    rows = C.resolve_requests(spark.createDataFrame(asked, "dataset_id string, mode string, has_email boolean"), state).collect()
    found = {(r.dataset_id, r.mode): r.outcome for r in rows}
    assert [found[(name, "reuse_latest")] for name in names] == [
        "reuse",
        "no_manifest",
        "no_ids",
        "no_manifest",
        "no_latest",
    ]
    assert {found[(name, "reuse_latest_or_create")] for name in names[1:]} == {"create"}


def pages(spark, *rows):
    return spark.createDataFrame(rows, P.PAGE_SCHEMA)


def test_activate(spark, root):
    whole = pages(
        spark,
        ("a", 0, 0, None, "timeout"),
        ("a", 0, 1, ["2", "1"], None),
        ("a", 2, 0, ["2", "3"], None),
        ("a", 9, 0, ["stray"], None),
        ("b", 0, 0, ["5"], None),
        ("c", 0, 0, ["never read"], None),
    )
    asked = searches(spark, {"a": "123", "b": "5", "zero": ""})
    both = requests(
        spark,
        ("a", "reuse_latest_or_create", "e", "q"),
        ("b", "create_new", "e", "q"),
        ("zero", "create_new", "e", "q"),
    )
    found, ids = activate(spark, root, both, asked, whole)
    expected = {("a", name_of(EARLY)): ["1", "2", "3"], ("b", name_of(EARLY)): ["5"]}
    assert lists_of(ids) == expected
    assert {r.dataset_id: r.raw_count for r in found.collect()} == {"a": 4, "b": 1, "zero": 0}
    again = requests(spark, ("a", "reuse_latest", None, "other"), ("b", "reuse_latest_or_create", None, "q"))
    assert lists_of(activate(spark, root, again)[1]) == expected
    before = files_under(root)
    for row, kind in (
        (("a", "nonsense", "e", "q"), ValueError),
        (("new", "reuse_latest", "e", "q"), FileNotFoundError),
        (("new", "create_new", "", "q"), ValueError),
        (("new", "create_new", "e", "q"), ValueError),
        (("zero", "create_new", "e", " \t"), ValueError),
    ):
        with pytest.raises(kind):
            activate(spark, root, requests(spark, row), asked, whole)
    with pytest.raises(FileExistsError):
        activate(spark, root, requests(spark, ("b", "create_new", "e", "q")), asked, whole)
    assert files_under(root) == before


def test_broken_pages_are_not_frozen(spark, root):
    short = pages(spark, ("a", 0, 0, ["1"], None))
    with pytest.raises(RuntimeError, match="incomplete"):
        commit_pages(spark, root, searches(spark, {"a": "12"}), short)
    assert files_under(root) == []


def test_a_list_that_was_not_counted_is_not_frozen(spark, root):
    landed = pages(spark, ("a", 0, 0, ["1", "2"], None))
    for count in (None, -1):
        asked = searches(spark, {"a": "12"}).withColumn("reported_count", F.lit(count).cast("bigint"))
        with pytest.raises(ValueError, match="not known"):
            commit_pages(spark, root, asked, landed)
        with pytest.raises(ValueError, match="not known"):
            commit_snapshots(spark, root, asked, frame(spark, {"a": ["1"]}))
        with pytest.raises(ValueError, match="not known"):
            activate(spark, root, requests(spark, ("a", "create_new", "e", "q")), asked, landed)
    with pytest.raises(ValueError, match="without a search"):
        commit_pages(spark, root, searches(spark, {"b": "1"}), landed)
    assert files_under(root) == []


def test_the_error_says_where_reading_stopped(spark, root):
    landed = pages(
        spark, ("a", 0, 0, ["1"], None), ("a", 1, 0, None, "reset"), ("a", 1, 1, None, "timeout"), ("a", 2, 0, ["3"], None)
    )
    with pytest.raises(RuntimeError, match="gap.*offset 1.*2 attempts.*timeout"):
        commit_pages(spark, root, searches(spark, {"a": "123"}), landed, max_attempts=2)
    assert files_under(root) == []


def test_a_damaged_manifest_raises(spark, root):
    commit_snapshots(spark, root, searches(spark, {"d": ["a"]}), frame(spark, {"d": ["a"]}))
    (document,) = Path(store.manifests_path(root)).rglob("part-*.json")
    document.write_text(document.read_text()[:40])
    document.with_name(f".{document.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        store.listing(spark, root).collect()


def test_settings_of_requests_reach_the_manifest(spark, root):
    schema = (
        "dataset_id string, mode string, email string, search_query string, page_size int, max_retry_attempts int, "
        "request_delay_seconds double, api_key string"
    )
    asked = spark.createDataFrame(
        [
            ("a", "create_new", "e", "q", 50, 2, None, "k"),
            ("b", "create_new", "e", "q", 60, 7, 1.5, None),
            ("c", "create_new", "e", None, 70, 1, None, None),
        ],
        schema,
    ).fillna("q", ["search_query"])
    landed = pages(
        spark, ("a", 0, 0, None, "x"), ("a", 0, 1, ["1"], None), ("b", 0, 6, ["2"], None), ("c", 0, 0, ["3"], None), ("c", 0, 1, ["4"], None)
    )
    given = searches(spark, {"a": "1", "b": "2", "c": "3"})
    found, ids = activate(spark, root, asked, given, landed)
    rows = {r.dataset_id: (r.page_size, r.max_retry_attempts, r.request_delay_seconds) for r in found.collect()}
    assert rows == {"a": (50, 2, 0.1), "b": (60, 7, 1.5), "c": (70, 1, 0.34)}
    assert sorted(r.id for r in ids.collect()) == ["1", "2", "3"]
    few = asked.withColumn("max_retry_attempts", F.lit(1))
    with pytest.raises(RuntimeError, match="not whole"):
        activate(spark, root, few, searches(spark, {"a": "1", "b": "2", "c": "3"}, LATE), landed)
    with pytest.raises(ValueError, match="another query"):
        activate(spark, root, asked.withColumn("search_query", F.lit("other")), given, landed)
    null_settings = given.withColumn("page_size", F.lit(None).cast("int")).withColumn("retrieved_at_utc", F.lit(LATE))
    made = commit_snapshots(spark, root, null_settings, frame(spark, {"a": ["1"]}))
    assert {r.page_size for r in made.collect()} == {1000}


def test_staged_tables_are_removed(spark, root):
    shared = Path(spark.conf.get("spark.checkpoint.dir")) / "muster" / spark.sparkContext.applicationId
    shared.mkdir(parents=True, exist_ok=True)
    asked = searches(spark, {"a": "1"})
    before = {p.name for p in shared.iterdir()}
    with pytest.raises(RuntimeError):
        commit_pages(spark, root, asked, pages(spark, ("a", 3, 0, ["1"], None)))
    commit_pages(spark, root, asked, pages(spark, ("a", 0, 0, ["1"], None)))
    assert {p.name for p in shared.iterdir()} == before
    landed = pages(spark, ("b", 0, 0, ["1"], None))
    activate(spark, root, requests(spark, ("b", "create_new", "e", "q")), searches(spark, {"b": "1"}), landed)
    left = {p.name.split("-")[0] for p in shared.iterdir()} - {n.split("-")[0] for n in before}
    assert left <= {"active", "wanted", "places"}
