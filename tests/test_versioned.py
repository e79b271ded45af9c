"""Operators over versioned datasets, against SQL, fixed vectors and small cases worked by hand."""

import hashlib
import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import codec, grammar, hashing
from palimpsest.operators import diff, history, merge, objects, segment, store
from palimpsest.plans.catalog import Conflict, Repository, Schema
from palimpsest.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def rows_of(columns, rows):
    plain = lambda v: round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else v
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    wanted = duck.sql(ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    expected = [dict(zip(wanted.columns, r, strict=True)) for r in wanted.fetchall()]
    assert rows_of(columns, found.collect()) == rows_of(columns, expected)


@pytest.fixture(scope="module")
def many_conflicts(spark, tmp_path_factory):
    """Orders that nearly all conflict, over 100,000 of them: ours deletes every key, theirs edits it."""
    folder = tmp_path_factory.mktemp("many")
    spark.range(125_000).selectExpr("id * 119 o_orderkey", "id o_custkey", "'O' o_orderstatus", "cast(id as double) o_totalprice").write.parquet(str(folder / "orders.parquet"))
    connection = duckdb.connect()
    connection.execute(f"create view orders as select * from '{folder}/orders.parquet/*.parquet'")
    return str(folder), connection


@pytest.mark.parametrize("name", ["m05_merge_opaque", "m06_merge_per_cell", "m07_user_resolver", "m08_merge_counter"])
def test_merges_take_any_number_of_conflicts(spark, many_conflicts, name):
    folder, connection = many_conflicts
    wanted = connection.sql(ORACLE_SQL[name])
    assert sorted(map(tuple, QUERIES[name](spark, folder).select(*wanted.columns).collect())) == sorted(wanted.fetchall())


def test_branch_classes_have_the_known_counts(spark):
    counts = {r["class"]: r["n"] for r in QUERIES["m02_merge_classes"](spark, SF).collect()}
    assert counts == {
        "ours": 284, "theirs_added": 13, "theirs_removed": 46, "theirs_modified": 223, "both_deleted": 3, "convergent": 19,
        "delete_edit": 32, "add_add": 7, "model_change": 5, "combined": 20, "both_changed": 21,
    }


def test_node_ends_have_the_known_digest(spark):
    entries = spark.range(50_000).select(
        F.lit(0).alias("g"), F.col("id").alias("o"), (40 + F.col("id") % 60).alias("size"), hashing.window(hashing.content_hash(F.concat(F.lit("key-"), "id")), 0).alias("w")
    )
    ends = segment.node_ends(entries, "g", "o", "size", "w").first()["ends"]
    assert len(ends) == 834
    assert hashlib.sha256(b"".join(i.to_bytes(4, "big") for i in ends)).hexdigest() == "a5fdc1c9157bd7fa7edff3ddb23fd12bf74448c3a200d70e533f8f779b359464"


def test_chunks_cover_the_stream_and_resume_after_an_insert():
    data = b"".join(hashlib.sha256(i.to_bytes(4, "big")).digest() for i in range(8000))
    ends = segment.cut_points(data, 1024, 16384, 0x7FF, "s")
    assert ends == sorted(set(ends)) and ends[-1] == len(data) and max(b - a for a, b in itertools.pairwise([0, *ends])) <= 16384
    moved = segment.cut_points(data[:1000] + b"x" + data[1000:], 1024, 16384, 0x7FF, "s")
    assert len({e + 1 for e in ends} & set(moved)) > 0.8 * len(ends)
    assert segment.cut_points(b"", 1024, 16384, 0x7FF, "s") == []


def test_codecs(spark):
    values = [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**53]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", codec.uvarint(F.col("v")).alias("u"), codec.uvarint_size(F.col("v")).alias("n"), codec.little_endian(F.col("v"), 8).alias("le")).collect()

    def varint(v):
        out = bytearray()
        while v > 127:
            out.append(v % 128 + 128)
            v //= 128
        return bytes(out + bytes([v]))

    for r in got:
        assert bytes(r["u"]) == varint(r["v"]) and r["n"] == len(varint(r["v"])) and bytes(r["le"]) == r["v"].to_bytes(8, "little")


@pytest.mark.parametrize(
    ("name", "valid"),
    [("dev", 1), ("feature/x", 1), ("v1.2", 1), ("a_b-c", 1), ("a" * 128, 1), ("../x", 0), ("a..b", 0), ("a" * 129, 0), ("", 0), ("x.lock", 0), ("x/", 0), ("a//b", 0), ("-x", 0), (".x", 0), ("a b", 0), ("\0", 0), (None, 0)],
)
def test_ref_names(spark, name, valid):
    assert spark.createDataFrame([(name,)], "n string").select(grammar.valid_ref(F.col("n"))).first()[0] == bool(valid)


def test_merge_is_symmetric_but_for_conflicts_and_keeps_identity(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k long, m int, s string, c long")
    base = frame([(i, 7, "a", i) for i in range(20)])
    ours, theirs = frame([(i, 7, "b" if i < 5 else "a", i) for i in range(18)]), frame([(i, 7, "a", i + (i > 10)) for i in range(1, 20)])
    run = lambda b, o, t: sorted(map(tuple, merge.merge(b, o, t, "k", ["m", "s", "c"], "m", merge.PER_CELL)[0].collect()))
    assert run(base, base, theirs) == sorted(map(tuple, theirs.collect()))
    assert run(base, ours, base) == sorted(map(tuple, ours.collect()))
    assert [r for r in run(base, ours, theirs) if r[0] not in (0, 18, 19)] == [r for r in run(base, theirs, ours) if r[0] not in (0, 18, 19)]
    with pytest.raises(ValueError):
        merge.merge(base, ours, theirs, "k", ["m", "s", "c"], "m", merge.PER_CELL, max_conflicts=0)


def test_diff_and_its_application_are_inverse_with_nulls(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    a, b = frame([(1, None), (2, "x"), (3, "")]), frame([(1, ""), (3, None), (4, "y")])
    changes = diff.diff(a, b, "k", ["v"])
    assert sorted((r["kind"], r["key"]) for r in changes.collect()) == [(1, 4), (2, 2), (3, 1), (3, 3)]
    assert sorted(map(tuple, diff.apply_changes(a, changes, "k", ["v"]).collect())) == sorted(map(tuple, b.collect()))
    assert diff.diff(a, a, "k", ["v"]).count() == 0 == diff.pruned_diff(a, a, "k", ["v"], 2).count()


def test_merge_base_of_crossed_branches(spark):
    graph = [("root", [], 0), ("a1", ["root"], 1), ("a2", ["a1"], 2), ("b1", ["root"], 1), ("b2", ["b1"], 2), ("m1", ["a2", "b2"], 3), ("m2", ["b2", "a2"], 3)]
    commits = spark.createDataFrame(graph, "id string, parents array<string>, height long")
    reached = history.closure(commits, commits.select(F.col("id").alias("start"), "id"))
    pairs = spark.createDataFrame([("a2", "a1"), ("a2", "a2"), ("a2", "b2"), ("m1", "m2")], "a string, b string")
    assert {(r["a"], r["b"]): r["base"] for r in history.merge_bases(reached, pairs).collect()} == {("a2", "a1"): "a1", ("a2", "a2"): "a2", ("a2", "b2"): "root", ("m1", "m2"): "a2"}
    for limit in (0, -1, 10_001):
        with pytest.raises(ValueError):
            history.log(reached, limit)


def test_running_sum_over_several_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("o"), (F.col("id") % 5 + 1).alias("v"))
    got = {r["o"]: r["s"] for r in store.running_sum(rows, [F.col("o")], "v", "s", 7).collect()}
    total = 0
    for o, v in sorted((r["o"], r["v"]) for r in rows.collect()):
        assert got[o] == total
        total += v


@pytest.fixture
def repository(spark, tmp_path):
    clock = itertools.count(1_000, 1)
    repo = Repository(spark, str(tmp_path / "repo"), Schema("k", ("m", "s", "c"), "m"), clock=lambda: next(clock))
    frame = lambda rows: spark.createDataFrame(rows, "k long, m int, s string, c long")
    repo.init(frame([(i, 7, "a", i) for i in range(10)]), "user:a")
    return repo, frame


def test_repository_branches_merges_and_collects(repository):
    repo, frame = repository
    repo.branch("feature/x", "main")
    repo.stage("main", frame([(i, 7, "b" if i == 1 else "a", i) for i in range(10)]))
    first = repo.commit("main", "user:a", "ours")
    repo.stage("feature/x", frame([(i, 7, "c" if i in (1, 2) else "a", i) for i in range(11)]))
    repo.commit("feature/x", "user:b", "theirs")
    repo.tag("v1", first, "user:a")
    with pytest.raises(Conflict):
        repo.tag("v1", first, "user:a")
    assert repo.merge("main", "feature/x", merge.PER_CELL) == [[1, "both_changed"]]
    with pytest.raises(Conflict):
        repo.commit("main", "user:a", "too early")
    repo.resolve("main", 1, frame([(1, 7, "z", 1)]))
    repo.commit("main", "user:a", "merged")
    assert {r["k"]: r["s"] for r in repo.read("main").collect()} == {**dict.fromkeys(range(11), "a"), 1: "z", 2: "c"}
    assert {r["key"] for r in repo.diff("v1", "main").collect()} == {1, 2, 10}
    assert repo.diff("v1", first).count() == 0
    assert len(repo.log("main", 10)) == 4 and repo.merge_base("main", "feature/x") == repo.resolve_ref("feature/x")
    assert repo.garbage() == []  # too young
    assert len(repo.garbage(grace=-5)) == 1  # the merged snapshot before the conflict was settled
    assert repo.collect() == [] and len(repo.collect(grace=-5)) == 1
    assert repo.garbage(grace=-5) == [] and repo.read("v1").count() == 10 and repo.read("main").count() == 11
    with pytest.raises(ValueError):
        repo.branch("x.lock", "main")


def test_equal_rows_make_equal_snapshots_and_writers_lose_cleanly(repository, tmp_path):
    repo, frame = repository
    number, state = repo.state()
    assert repo.write(frame([(i, 7, "a", i) for i in reversed(range(10))])) == state["work"]["main"]["snapshot"]
    assert repo._swap(number, state) and not repo._swap(number, state)
    (tmp_path / "repo" / "state" / "left-over").write_text("{")  # of a writer that stopped
    repo.branch("b", "main")
    repo.stage("b", frame([(1, 7, "q", 1)]))
    repo.commit("b", "u", "less")
    repo.merge("main", "b", merge.OPAQUE)
    repo.abort("main")
    assert repo.working("main").count() == 10


def test_stream_commits_once(repository, spark, tmp_path):
    from palimpsest.streaming.journal import commit_stream

    repo, _ = repository
    source = str(tmp_path / "edits")
    spark.createDataFrame([(1, "put", 7, "n", 5, 1), (1, "delete", 7, "n", 5, 2), (2, "put", 7, "n", 5, 3)], "k long, op string, m int, s string, c long, seq long").coalesce(1).write.parquet(source)
    edits = spark.readStream.schema("k long, op string, m int, s string, c long, seq long").parquet(source)
    for _ in range(2):
        commit_stream(edits, repo, "main", "seq", "user:s", str(tmp_path / "wal")).awaitTermination(120)
    assert len(repo.log("main", 10)) == 2
    assert {r["k"]: r["s"] for r in repo.read("main").collect()} == {**dict.fromkeys([0, *range(3, 10)], "a"), 2: "n"}


def test_streams_to_one_branch_each_commit_their_own_batches(repository, spark, tmp_path):
    from palimpsest.streaming.journal import commit_stream

    repo, _ = repository
    schema = "k long, op string, m int, s string, c long, seq long"
    for name, key in (("x", 101), ("y", 102)):
        spark.createDataFrame([(key, "put", 7, name, 5, 1)], schema).coalesce(1).write.parquet(str(tmp_path / name))
        commit_stream(spark.readStream.schema(schema).parquet(str(tmp_path / name)), repo, "main", "seq", "user:s", str(tmp_path / f"wal-{name}")).awaitTermination(120)
    assert {r["k"]: r["s"] for r in repo.read("main").where("k > 100").collect()} == {101: "x", 102: "y"}
    edits = spark.createDataFrame([(103, "put", 7, "z", 5, 1)], schema)
    assert repo.publish("main", edits, "seq", "user:s", "first", stream=("s", 4)) and repo.publish("main", edits, "seq", "user:s", "again", stream=("s", 4)) is None
    repo.stage("main", repo.read("main").where("k <> 103"))
    with pytest.raises(Conflict):
        repo.publish("main", edits, "seq", "user:s", "over uncommitted work")


def test_writers_do_not_overwrite_each_other_unseen(repository):
    repo, frame = repository
    seen = repo.state()[1]["work"]["main"]["snapshot"]
    repo.stage("main", frame([(1, 7, "first", 1)]), expected=seen)
    with pytest.raises(Conflict):
        repo.stage("main", frame([(1, 7, "second", 1)]), expected=seen)
    with pytest.raises(Conflict):
        repo.commit("main", "u", "on another head", expected="0" * 64)
    repo.branch("b", "main")
    repo.stage("b", frame([(1, 7, "x", 1)]))
    with pytest.raises(Conflict):
        repo.delete_branch("b")
    repo.delete_branch("b", force=True)
    repo.tag("t", "main", "u")
    assert list(repo.branches()) == ["main"] and list(repo.tags()) == ["t"]
    repo.delete_tag("t")
    assert repo.tags() == {}


def test_edits_write_and_diffs_read_only_the_segments_that_they_touch(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "repo"), Schema("k", ("v", "m"), "m", width=10))
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string, m int")
    rows = [(i, f"v{i}", 7) for i in range(200)]
    repo.init(frame(rows), "u")
    first = repo.state()[1]["work"]["main"]["snapshot"]
    files = lambda: set((tmp_path / "repo" / "data").glob("*/segment=*/*.parquet"))
    before = files()
    assert len(before) == 20
    edits = spark.createDataFrame([(57, "put", "new", 7, 1), (151, "delete", None, None, 2)], "k long, op string, v string, m int, o long")
    second = repo.edit("main", edits, "o")
    assert len(files() - before) == 2
    new = repo.commit("main", "u", "two edits")
    old = repo.record(new)["parents"][0]
    wanted = [(k, "new" if k == 57 else v, m) for k, v, m in rows if k != 151]
    assert sorted(map(tuple, repo.read("main").select("k", "v", "m").collect())) == wanted
    assert second == repo.write(frame(wanted[::-1]))  # the history of a snapshot does not matter
    changes = repo.diff(old, new)
    assert len(changes.inputFiles()) == 4 and {(r["key"], r["kind"]) for r in changes.collect()} == {(57, 3), (151, 2)}
    assert repo.diff(new, new).inputFiles() == [] and repo.snapshots.changed_segments(first, second).count() == 2
    repo.branch("b", old)
    repo.edit("b", spark.createDataFrame([(58, "put", "theirs", 7, 1), (5, "put", "theirs", 7, 2)], "k long, op string, v string, m int, o long"), "o")
    repo.commit("b", "u", "theirs")
    before = files()
    assert repo.merge("main", "b", merge.PER_CELL) == []
    assert len(files() - before) == 1  # only keys 50 to 59 changed on both sides
    assert {r["k"]: r["v"] for r in repo.working("main").where("k in (5, 57, 58)").collect()} == {5: "theirs", 57: "new", 58: "theirs"}
    with pytest.raises(Exception, match="a key is null"):
        repo.write(frame([(None, "x", 7)]))


def test_logs_and_bases_by_frontiers_equal_those_by_closure(spark):
    import random

    random.seed(4)
    graph = []
    for i in range(120):
        parents = sorted({random.randrange(max(0, i - 12), i) for _ in range(random.choice([1, 1, 2]))}) if i > 2 else []
        graph.append((i, parents, 1 + max((graph[p][2] for p in parents), default=-1)))
    commits = spark.createDataFrame(graph, "id long, parents array<long>, height long")
    starts = spark.createDataFrame([(k, random.randrange(60, 120)) for k in range(12)], "start long, id long")
    pairs = spark.createDataFrame([(a, a + 1) for a in range(11)] + [(3, 3)], "a long, b long")
    reached = history.closure(commits, starts)
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert rows(history.logs(commits, starts, 7), "start", "id", "place") == rows(history.log(reached, 7), "start", "id", "place")
    assert rows(history.nearest_bases(commits, starts, pairs), "a", "b", "height", "base") == rows(history.merge_bases(reached, pairs), "a", "b", "height", "base")


@pytest.mark.parametrize("ordered", [True, False])
def test_closures_move_each_pair_once_for_each_edge(spark, tmp_path, monkeypatch, ordered):
    import random

    random.seed(5)
    parents = {i: sorted({random.randrange(max(0, i - 9), i) for _ in range(2)}) if i > 2 else [] for i in range(60)}
    heights = {}
    for i, own in parents.items():
        heights[i] = 1 + max((heights[p] for p in own), default=-1)
    if not ordered:  # heights that say nothing, a commit that is its own parent, a ring, one that is not there
        heights = {i: random.randrange(9) for i in parents}
        parents |= {7: [7, 3], 0: [12], 20: [999, 8]}
    commits = spark.createDataFrame([(i, own, heights[i]) for i, own in parents.items()], "id long, parents array<long>, height long")
    starts = {k: random.randrange(30, 60) for k in range(6)}
    wanted = set()
    for start, id in starts.items():
        left = [id]
        while left:
            if (start, at := left.pop()) not in wanted and at in parents:
                wanted.add((start, at))
                left += parents[at]
    monkeypatch.setattr(history, "shared_dir", lambda spark, what: str(tmp_path / what))
    got = [tuple(r) for r in history.closure(commits, spark.createDataFrame(list(starts.items()), "start long, id long")).collect()]
    assert sorted(got) == sorted((s, i, heights[i]) for s, i in wanted)
    if ordered:
        assert spark.read.parquet(str(tmp_path / "reached")).count() == len(starts) + sum(len(parents[i]) for _, i in wanted)
    assert not (tmp_path / "edges").exists()


def test_closure_of_no_starts_is_empty(spark):
    commits = spark.createDataFrame([(1, [], 0)], "id long, parents array<long>, height long")
    assert history.closure(commits, spark.createDataFrame([], "start long, id long")).count() == 0


def test_row_hashes_tell_separators_and_nulls_apart(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k long, a string, b string")
    before, after = frame([(1, "a\x1fb", "c"), (2, None, "x"), (3, "1:a", "")]), frame([(1, "a", "b\x1fc"), (2, "\x00", "x"), (3, "1:a", None)])
    assert diff.diff_by_hash(before, after, "k", ["a", "b"]).count() == 3 == diff.diff(before, after, "k", ["a", "b"]).count()


def test_names_end_where_they_end(spark):
    names = spark.createDataFrame([("dev\n", 0), ("feature/.x", 1), ("a/-b", 1), ("x.lock/y", 1)], "n string, valid int")
    assert all(r[0] == bool(r[1]) for r in names.select(grammar.valid_ref(F.col("n")), "valid").collect())
    assert not spark.createDataFrame([("a\n",)], "n string").select(grammar.valid_object_name(F.col("n"))).first()[0]
    assert not spark.createDataFrame([("0" * 64 + "\n",)], "n string").select(hashing.is_hash(F.col("n"))).first()[0]


def test_too_many_volumes_are_refused(spark):
    names = spark.createDataFrame([("n",)], "name string")
    volumes = lambda n: spark.range(n).select(F.concat(F.lit("v"), "id").alias("volume"))
    assert store.rendezvous(names, volumes(64)).count() == 64
    with pytest.raises(ValueError):
        store.rendezvous(names, volumes(65))


def test_condemned_packs_are_broadcast_up_to_a_bound(spark):
    entries = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 2, 3), ("b", 2, 4), ("c", 3, 5), (None, 1, 6)], "hash string, pack long, seq long")
    condemned = spark.createDataFrame([(2, 9), (2, 8), (4, 9)], "pack long, condemned_at long")
    incoming = spark.createDataFrame([("a",), ("b",), ("d",), ("d",)], "hash string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for bound, joins in ((2, 1), (1, 2)):
            new = store.new_chunks(incoming, entries, condemned, bound)
            first = store.first_locations(entries, condemned, bound)
            assert sorted(r[0] for r in new.collect()) == ["b", "d"]
            assert sorted(map(tuple, first.collect()), key=str) == [("a", 1, 1, False), ("b", 2, 3, True), ("c", 3, 5, False), (None, 1, 6, False)]
            plan = new._jdf.queryExecution().sparkPlan().toString()
            assert plan.count("SortMergeJoin") == joins and plan.count("HashAggregate") == 4  # both sides are distinct before they meet
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_volumes_are_ranked_without_a_window(spark):
    names = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "name string")
    volumes = spark.createDataFrame([("v1",), ("v2",), ("v3",)], "volume string")
    placed = store.rendezvous(names, volumes)
    assert "Window" not in placed._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for name, n in (("a", 1), ("b", 2), (None, 1)):
        scores = sorted(((hashlib.sha256("\x1f".join(filter(None, (v, name))).encode()).hexdigest()[:16], v) for v in ("v1", "v2", "v3")), key=lambda x: (-int(x[0], 16), x[1]))
        want += [(name, v, s, rank + 1) for rank, (s, v) in enumerate(x for x in scores for _ in range(n))]
    assert sorted(map(tuple, placed.select("name", "volume", "score", "rank").collect()), key=str) == sorted(want, key=str)
    assert store.rendezvous(names, volumes.limit(0)).count() == 0


def test_chunks_equal_those_of_a_plain_loop(spark, monkeypatch):
    import random

    monkeypatch.setattr(segment, "BLOCK", 5000)
    rng = random.Random(8)
    streams = [rng.randbytes(n) for n in (0, 1, 300, 6000, 20_000)] + [b"\0" * 3000, b"ab" * 4000]

    def rotated(v, k):
        return (v << k | v >> (64 - k)) & (2**64 - 1) if k else v

    table = [int(v) for v in segment.gear("s")]
    want = []
    for number, data in enumerate(streams):
        padded, start, seq = bytes(47) + data, 0, 0
        for i in range(len(data)):
            h = 0
            for age in range(48):
                h ^= rotated(table[padded[i + 47 - age]], age)
            n = i + 1 - start
            if n == 900 or i + 1 == len(data) or (n < 200 and not h & (0x7F << 2 | 0x7F)) or (n >= 200 and not h & (0x7F >> 2)):
                want.append((number, seq, n, hashlib.sha256(data[start : i + 1]).hexdigest()))
                start, seq = i + 1, seq + 1
    rows = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(streams)] + [(99, None)], "stream long, data binary").coalesce(1)
    assert sorted(map(tuple, segment.chunks(rows, least=200, most=900, mask=0x7F, seed="s").collect())) == want


def test_walks_refuse_models_that_they_do_not_know(spark):
    registry = spark.createDataFrame([(1, "blob", True), (3, "counter", False)], "model long, name string, walkable boolean")
    entries = spark.createDataFrame([], "object long, root string")
    rows = lambda model: spark.createDataFrame([(1, 1, "r"), (2, model, "s")], "object long, model long, root string")
    assert objects.walk(rows(1), entries, registry).count() == 2
    for model in (3, 9):
        with pytest.raises(ValueError):
            objects.walk(rows(model), entries, registry)


def test_references_are_46_bytes(spark):
    fields = [258, 1, 3, 2, 2**40 + 5]
    ref = objects.encode_reference(*(F.lit(x) for x in fields), F.lit("ab" * 32))
    row = spark.range(1).select(ref.alias("b"), objects.decode_reference(ref).alias("r"), objects.decode_reference(F.lit(b"x")).alias("n")).first()
    assert bytes(row["b"]) == (258).to_bytes(2, "little") + b"\1\0\3\2" + (2**40 + 5).to_bytes(8, "little") + bytes.fromhex("ab" * 32)
    assert list(row["r"]) == [*fields, "ab" * 32] and row["n"] is None
