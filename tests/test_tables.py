import pytest
from pyspark.sql import functions as F

from parcela import streaming
from parcela.functions import geometry as g
from parcela.functions.spatial import CONTAINS, INTERSECTS
from parcela.functions.where import FilterError
from parcela.operators.filters import QueryFilter
from parcela.operators.table import EditError, FeatureTable, numbered
from parcela.sources.workspace import CatalogError, ConflictError, Workspace

RING = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]


@pytest.fixture
def table(spark):
    """Object ids 2 to 5: the first slot is empty."""
    shape = lambda k: g.polygon([(x + 20 * k, y) for x, y in RING]).row()
    rows = spark.createDataFrame([(k + 1, shape(k), f"n{k}", 100.0 * k) for k in range(1, 5)], f"OBJECTID long, SHAPE {g.SHAPE}, BH string, LEN double")
    return FeatureTable.of("plots", rows, "SHAPE")


def test_searches(table):
    assert table.query_oids() == [2, 3, 4, 5] and table.next_oid == 6 and table.count() == 4
    assert table.query_oids(QueryFilter.where("(BH = 'n1' OR BH = 'n2') AND LEN > 0")) == [2, 3]
    assert table.get(3).BH == "n2" and table.get(99) is None
    assert [r.OBJECTID for r in table.cursor(QueryFilter.by_oids([5, 2, 77, 5]))] == [2, 5]
    assert [f.name for f in table.fields] == ["OBJECTID", "SHAPE", "BH", "LEN"]
    assert table.query_oids(QueryFilter.by_oids([])) == [] and table.query_oids(QueryFilter.by_oids(range(3, 5000))) == [3, 4, 5]
    donut = g.polygon([(15, -5), (35, -5), (35, 15), (15, 15)], [(19, -1), (31, -1), (31, 11), (19, 11)])
    assert table.query_oids(QueryFilter.intersecting(donut)) == []
    assert table.query_oids(QueryFilter.where("LEN > 100").and_related(INTERSECTS, g.point(45, 5))) == [3]


def test_deletes_keep_object_ids(table):
    assert table.deleted(QueryFilter.where("BH = 'n1'")).query_oids() == [3, 4, 5]
    assert table.deleted(QueryFilter.by_oids([2, 4, 12345])).query_oids() == [3, 5]
    emptied = table.deleted(QueryFilter.where("LEN > 0"))
    assert emptied.query_oids() == [] and emptied.inserted([{"BH": "x"}]).query_oids() == [6]
    assert table.deleted(QueryFilter.intersecting(g.point(25, 5))).query_oids() == [3, 4, 5]
    assert table.deleted(QueryFilter.by_oids(range(4, 3000))).query_oids() == [2, 3]


def test_updates(table):
    changed = table.updated(QueryFilter.where("BH = 'n2' OR BH = 'n3'"), {"BH": "z", "LEN": F.col("LEN") + 1})
    assert [(r.OBJECTID, r.BH, r.LEN) for r in changed.cursor()] == [(2, "n1", 100), (3, "z", 201), (4, "z", 301), (5, "n4", 400)]
    moved = table.updated(QueryFilter.by_oid(2), {"SHAPE": g.point(500, 500)})
    assert moved.query_oids(QueryFilter.related(CONTAINS, g.polygon([(499, 499), (501, 499), (501, 501), (499, 501)]))) == [2]
    assert table.updated(QueryFilter.by_oids(range(3, 2000)), {"BH": "y"}).count(QueryFilter.where("BH = 'y'")) == 3
    for values in ({"nope": 1}, {"OBJECTID": 1}, {"BH": g.point(0, 0)}):
        with pytest.raises(EditError):
            table.updated(QueryFilter.all(), values)


def test_inserts(table):
    more = table.inserted([{"BH": "a", "SHAPE": g.point(1, 1)}, {"LEN": 2.0}])
    assert more.query_oids() == [2, 3, 4, 5, 6, 7] and more.next_oid == 8
    assert more.query_oids(QueryFilter.where("SHAPE IS NULL")) == [7] and more.query_oids(QueryFilter.intersecting(g.point(1, 1))) == [6]
    assert table.copied(QueryFilter.where("BH IN ('n1', 'n4')")).query_oids() == [2, 3, 4, 5, 6, 7]
    with pytest.raises(EditError):
        table.inserted([{"nope": 1}])


def skewed(spark, n):
    return spark.range(n, numPartitions=7).selectExpr("id", "if(id % 3 = 0, 0, id % 1000) as t", "repeat('x', int(id % 50)) as filler")


@pytest.mark.parametrize("conf", [{}, {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.shuffle.partitions": "60"}])
def test_numbering_of_shuffled_rows(spark, conf):
    """Every row stays, under a dense id of its own, however the plan deals the rows."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = skewed(spark, 60_000).repartition("t")
        out, n = numbered(rows, 5)
        facts = out.selectExpr("count(*)", "count(distinct OBJECTID)", "min(OBJECTID)", "max(OBJECTID)", "count(distinct id)").first()
        assert n == 60_000 and tuple(facts) == (n, n, 5, n + 4, n)
        more = FeatureTable("t", out, n + 5).inserted(rows)
        assert more.next_oid == 2 * n + 5 and more.rows.selectExpr("count(distinct OBJECTID)").first()[0] == 2 * n
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_deletes_by_position_handle_and_count(table):
    assert table.deleted_positions([0, 2]).query_oids() == [3, 5] and table.deleted_positions([]).count() == 4
    with pytest.raises(EditError):
        table.deleted_positions([4])
    assert table.deleted_row(table.get(4)).query_oids() == [2, 3, 5]
    left, n = table.deleted_with_count(QueryFilter.by_oids([2, 2, 99, 5]))
    assert (left.query_oids(), n) == ([3, 4], 2)


def test_filter_algebra():
    a, b = g.point(0, 0), g.point(1, 1)
    where = QueryFilter.where("x = 1")
    assert where.and_related(INTERSECTS, a).and_related(CONTAINS, b) == where.and_related(CONTAINS, b)
    assert QueryFilter.intersecting(a).and_related(CONTAINS, b) == QueryFilter.related(CONTAINS, b)
    assert str(QueryFilter.by_oids([1, 2])) == "OBJECTID IN (1,2)" and str(QueryFilter.by_oid(3)) == "OBJECTID = 3" and str(QueryFilter.all()) == "<all>"
    assert str(where.and_related(INTERSECTS, a)) == "(x = 1) AND SHAPE INTERSECTS <filter>"
    assert QueryFilter.by_oid(1).is_oid_only and not where.is_oid_only
    for bad in (lambda: QueryFilter.by_oid(1).and_related(INTERSECTS, a), lambda: QueryFilter.intersecting(g.Geometry(g.POLYGON, ()))):
        with pytest.raises(FilterError):
            bad()


@pytest.fixture
def workspace(spark, tmp_path):
    w = Workspace.create(spark, f"file://{tmp_path}/w")
    w.add_table("T1", spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "Name string, Val int").coalesce(1))
    w.add_dataset("Admin")
    w.add_feature_class("Regions", spark.createDataFrame([(g.polygon(RING).row(), "A")], f"SHAPE {g.SHAPE}, Name string"), g.POLYGON, "Admin", srs_wkt="WGS")
    return w


def test_workspace(spark, workspace):
    assert workspace.tables() == ["T1"] and workspace.feature_classes() == ["Regions"] == workspace.feature_classes("Admin")
    assert workspace.feature_datasets() == ["Admin"] and workspace.items().count() == 3
    regions = workspace.open("Regions")
    assert regions.geometry_type == g.POLYGON and regions.spatial_reference == "WGS" and regions.count() == 1
    with pytest.raises(CatalogError):
        workspace.open("t1")
    with pytest.raises(CatalogError):
        workspace.add_feature_class("X", regions.rows, "MULTIPATCH")
    with pytest.raises(CatalogError):
        Workspace.create(spark, workspace.root)


def test_object_ids_are_not_given_again_after_saving(workspace):
    table = workspace.open("T1")
    workspace.save(table.deleted(QueryFilter.by_oid(3)))
    workspace.save(workspace.open("T1").inserted([{"Name": "d"}]))
    assert workspace.open("T1").query_oids() == [1, 2, 4]


def test_sessions(workspace):
    session = workspace.session()
    for early in (session.commit, session.start_operation, session.stop_operation):
        with pytest.raises(EditError):
            early()
    session.begin_transaction()
    session.edit("T1", lambda t: t.updated(QueryFilter.where("Val > 1"), {"Name": "z"}))
    session.start_operation()
    assert session.operation_depth == 2
    session.edit("T1", lambda t: t.deleted(QueryFilter.by_oid(1)))
    session.stop_operation()
    with pytest.raises(EditError):
        session.commit()
    session.stop_operation()
    session.abort()
    assert not session.is_being_edited and [r.Name for r in session.open("T1").cursor()] == ["a", "b", "c"]
    session.begin_transaction()
    session.edit("T1", lambda t: t.deleted(QueryFilter.where("Val = 2")))
    session.stop_operation()
    assert workspace.open("T1").count() == 3
    session.commit()
    assert workspace.open("T1").query_oids() == [1, 3]


def test_commits_at_one_time(spark, workspace):
    """Two sessions that change one table: the second commit fails, and nothing of the first is undone."""
    workspace.add_table("T2", spark.createDataFrame([("q",)], "Name string"))
    one, two, three = workspace.session(), workspace.session(), workspace.session()
    for session, name, oid in ((one, "T1", 1), (two, "T1", 2), (three, "T2", 1)):
        session.start()
        session.open("T2" if name == "T1" else "T1")  # only read
        session.edit(name, lambda t, oid=oid: t.deleted(QueryFilter.by_oid(oid)))
    version = next(i["version"] for i in workspace.manifest() if i["name"] == "T2")
    one.commit()
    assert next(i["version"] for i in workspace.manifest() if i["name"] == "T2") == version  # unchanged tables aren't written
    with pytest.raises(ConflictError):
        two.commit()
    three.commit()
    assert workspace.open("T1").query_oids() == [2, 3] and workspace.open("T2").count() == 0
    assert one.open("T1").query_oids() == [2, 3]


def test_a_batch_that_comes_again(spark, workspace, tmp_path):
    """A crash after the commit of a batch and before the stream notes it: the batch is not added twice."""
    rows = spark.createDataFrame([("s", 9)], "Name string, Val int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("Name string, Val int").parquet(str(tmp_path / "in"))
    checkpoint = str(tmp_path / "c")
    workspace.commit({"T1": workspace.open("T1").inserted(rows)}, batch=(f"T1 from {checkpoint}", 0))
    streaming.into_table(stream, workspace, "T1", checkpoint).awaitTermination()
    assert workspace.open("T1").query_oids() == [1, 2, 3, 4]


def test_abort_without_operation_keeps_memory_only(workspace):
    session = workspace.session()
    session.start()
    session.edit("T1", lambda t: t.deleted(QueryFilter.all()))
    session.abort()
    assert session.open("T1").count() == 0 and workspace.open("T1").count() == 3


def test_second_group_is_what_abort_undoes(workspace):
    session = workspace.session()
    session.begin_transaction()
    session.edit("T1", lambda t: t.deleted(QueryFilter.by_oid(1)))
    session.stop_operation()
    session.start_operation()
    session.edit("T1", lambda t: t.deleted(QueryFilter.by_oid(2)))
    session.abort()
    assert session.open("T1").query_oids() == [2, 3]


def test_streams(spark, workspace, tmp_path):
    spark.createDataFrame([("s", 9), ("t", 1)], "Name string, Val int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("Name string, Val int").parquet(str(tmp_path / "in"))
    found = streaming.matching(stream, QueryFilter.where("Val > 5"))
    for _ in range(2):  # a second run finds nothing new
        streaming.into_table(found, workspace, "T1", str(tmp_path / "c")).awaitTermination()
    assert [(r.OBJECTID, r.Name) for r in workspace.open("T1").cursor()] == [(1, "a"), (2, "b"), (3, "c"), (4, "s")]


def test_single_rows(table):
    """matches_row() says of every row what a search says."""
    box = g.polygon([(35, -5), (75, -5), (75, 15), (35, 15)])
    filters = [QueryFilter.all(), QueryFilter.by_oid(3), QueryFilter.by_oids([2, 5]), QueryFilter.intersecting(box), QueryFilter.related(CONTAINS, box)]
    filters += [QueryFilter.where(t) for t in ("BH > 'n1' AND NOT len = 300", "LEN IN (100, '400', NULL)", "nope IS NULL AND BH <> 5 OR LEN >= ' 2e2 '", "LEN = TRUE OR BH = 'n3'", "LEN < '3x' AND SHAPE IS NOT NULL")]
    filters += [f.and_related(INTERSECTS, box) for f in filters[5:8]]
    rows = [(r.asDict(), g.from_row(r.SHAPE)) for r in table.cursor()]
    for f in filters:
        assert [r["OBJECTID"] for r, shape in rows if f.matches_row(r, shape)] == table.query_oids(f), str(f)
