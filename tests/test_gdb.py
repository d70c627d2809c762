import datetime
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcela import cli
from parcela.functions import geometry as g
from parcela.functions import scalars
from parcela.operators.filters import QueryFilter
from parcela.sources.gdb import codec, datasource
from parcela.sources.gdb.codec import Field, FormatError, Grid, Input, Schema
from parcela.sources.gdb.datasource import GdbDataSource
from parcela.sources.gdb.tables import Builder, Folder, TableFile, catalog, write_table

WHEN = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
UUID = "00112233-4455-6677-8899-aabbccddeeff"
EVERY = (
    codec.OBJECT_ID,
    *[Field(k, k) for k in ("int16", "int32", "int64", "float32", "float64", "string", "xml", "datetime", "date", "time", "uuid", "binary", "raster")],
    Field("SHAPE", "geometry", srs_wkt="WGS", grid=Grid(-400.0, -400.0, 1e6)),
    Field("req", "int32", alias="needed", nullable=False, default=7),
    Field("txt", "string", length=20, default="déf"),
)


@pytest.mark.parametrize(("value", "raw"), [(0, "00"), (63, "3f"), (64, "8001"), (-1, "41"), (-64, "c001"), (8191, "bf7f"), (8192, "808001")])
def test_signed_numbers(value, raw):
    assert codec.signed(value).hex() == raw and Input(bytes.fromhex(raw)).signed() == value


@given(st.integers(-(2**62), 2**62), st.integers(0, 2**64 - 1))
def test_numbers_come_back(signed, unsigned):
    assert Input(codec.signed(signed)).signed() == signed and Input(codec.unsigned(unsigned)).unsigned() == unsigned


coordinates = st.floats(-180, 180, allow_nan=False)
points = st.tuples(coordinates, coordinates)


@settings(max_examples=100)
@given(st.one_of(points.map(lambda p: g.point(*p)), st.lists(points, min_size=1, max_size=5).map(g.multipoint), st.lists(st.lists(points, min_size=1, max_size=5), min_size=1, max_size=3).map(lambda x: g.polyline(*x)), st.lists(st.lists(points, min_size=3, max_size=5), min_size=1, max_size=3).map(lambda x: g.polygon(*x))), st.booleans(), st.booleans())
def test_shapes_come_back(shape, has_z, has_m):
    grid = Grid(-400.0, -400.0, 1e6)
    back = codec.read_geometry(codec.write_geometry(shape, grid, has_z, has_m), grid)
    assert back.kind == shape.kind and [len(p) for p in back.parts] == [len(p) for p in shape.parts]
    assert all(math.dist(a, b) < 2e-6 for a, b in zip(back.points, shape.points, strict=True))


def test_shapes_that_cant_be_read():
    for raw in (b"\x00", b"\x01\x00\x05", codec.unsigned(32), codec.unsigned(3 | codec.HAS_CURVES) + bytes((2, 1, 1)), b""):
        with pytest.raises(FormatError):
            codec.read_geometry(raw, Grid())
    with pytest.raises(FormatError):
        codec.write_geometry(g.point(-1e10, 0), Grid())
    assert codec.read_geometry(codec.write_geometry(g.Geometry(g.POLYGON, ()), Grid()), Grid()) == g.Geometry(g.POLYGON, ())


@pytest.mark.parametrize("version", [3, 4])
@pytest.mark.parametrize("utf8", [True, False])
def test_tables_come_back(tmp_path, version, utf8):
    schema = Schema(EVERY, g.POLYGON, utf8=utf8)
    full = [3, -5, 70000, 1 << 60, 0.5, math.pi, "名 a", "<x/>", WHEN, WHEN, scalars.EPOCH, UUID, b"\x00\x01", b"", g.polygon([(0, 0), (1, 0), (1, 1)]), 1, "t"]
    bare = [1, *[None] * 14, -1, None]
    write_table(str(tmp_path), 9, schema, [full, bare], version)
    table = TableFile.open(str(tmp_path), 9)
    got = list(table.rows())
    assert table.version == version and table.slots == 3 and table.schema.fields[1:14] == EVERY[1:14]
    assert got[0] == bare and got[1][:14] == full[:14] and got[1][15:] == full[15:]
    assert got[1][14].bounds == pytest.approx((0, 0, 1, 1), abs=1e-5)
    assert table.schema.index("req") == 15 and table.schema.fields[15].default == 7 and table.schema.fields[16].default == "déf"
    assert [r[0] for r in table.rows(2)] == [3] and list(table.rows(1, 2)) == []


def test_what_doesnt_fit_is_an_error():
    schema = Schema(EVERY)
    for at, value in ((1, 1 << 20), (5, "x"), (6, 5), (11, "short"), (14, "POINT"), (15, None), (8, 3)):
        row = [1, *[None] * 14, 1, None]
        row[at] = value
        with pytest.raises(FormatError):
            codec.write_row(row, schema)


def test_broken_files(tmp_path):
    path = str(tmp_path)
    with pytest.raises(FormatError):
        catalog(path)
    write_table(path, 8, Schema((codec.OBJECT_ID, Field("a", "int32"))), [[1, 5], [2, 6]])
    with pytest.raises(FormatError):
        TableFile.open(path, 7)
    index = Folder(path).path("a00000008.gdbtablex".replace("tablex", "tablex"))
    raw = open(index, "rb").read()
    open(index, "wb").write(raw[:-2])
    assert [r[1] for r in TableFile.open(path, 8).rows()] == [5]  # a cut index has fewer slots
    data = bytearray(open(index[:-1], "rb").read())
    data[0] = 9
    open(index[:-1], "wb").write(data)
    with pytest.raises(FormatError):
        TableFile.open(path, 8)


def test_sample_catalog(tmp_path):
    path = str(tmp_path / "s.gdb")
    cli.sample(path)
    found = {i.name: (i.item_type, i.geometry_type, i.parent_dataset, i.path) for i in catalog(path)}
    assert found == {"Cities_Tbl": ("Table", None, None, "\\Cities_Tbl"), "Capitals": ("FeatureClass", g.POINT, None, "\\Capitals"), "Admin": ("FeatureDataset", None, None, "\\Admin"), "Regions": ("FeatureClass", g.POLYGON, "Admin", "\\Admin\\Regions")}
    (row,) = TableFile.open(path, 5).rows()
    assert row[0] == 1 and row[2] == "Beijing" and row[1].points[0] == pytest.approx((116.4, 39.9), abs=1e-6)
    with pytest.raises(FormatError):
        Builder.create(path)


def test_spark_source(spark, tmp_path):
    spark.dataSource.register(GdbDataSource)
    path = str(tmp_path / "d.gdb")
    rows = spark.createDataFrame([(i + 2, g.point(i, -i).row(), f"n{i}", WHEN if i % 2 else None, bool(i % 2)) for i in range(50)], f"OBJECTID long, SHAPE {g.SHAPE}, Name string, At timestamp_ntz, Odd boolean")
    rows = rows.withMetadata("SHAPE", {"geometry_type": g.POINT, "kind": "geometry"})
    save = lambda mode, some=rows: some.repartition(4).write.format("gdb").option("table", "P").mode(mode).save(path)
    save("append")
    got = spark.read.format("gdb").option("table", "P").option("slotsPerPartition", 7).load(path)
    assert got.rdd.getNumPartitions() == 8 and got.count() == 50
    r = got.where("OBJECTID = 5").first()
    assert (r.Name, r.At, r.Odd, r.SHAPE_XMIN) == ("n3", WHEN, 1, pytest.approx(3, abs=1e-6))
    assert QueryFilter.where("Name IN ('n1', 'n2') OR At IS NULL AND OBJECTID < 5").apply(got).count() == 3
    assert QueryFilter.intersecting(g.polygon([(0.5, -3.5), (3.5, -3.5), (3.5, -0.5), (0.5, -0.5)])).apply(got).count() == 3
    with pytest.raises(Exception, match="already"):
        save("append")
    save("overwrite", rows.where("OBJECTID < 10"))
    assert spark.read.format("gdb").option("table", "P").load(path).count() == 8
    assert not [f for f in (tmp_path / "d.gdb").iterdir() if f.suffix in (".rows", ".new")]


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "c.gdb")

    def run(*args):
        code = cli.main(list(args))
        return code, capsys.readouterr().out

    assert run("sample", path)[0] == 0 and run("sample", path)[0] == 1
    assert "Regions" in run("list", path)[1] and "Pop\tint32" in run("describe", path, "Cities_Tbl")[1]
    assert run("read", path, "Cities_Tbl", "--where", "pop > 2200")[1].splitlines() == ["OBJECTID=2  Name=Shanghai  Pop=2424", "1 rows"]
    assert "OBJECTID 3" in run("insert", path, "Cities_Tbl", "--set", "Name=Xi'an", "--set", "Pop=NULL")[1]
    assert "updated 2 rows" in run("update", path, "Cities_Tbl", "--where", "Pop IS NULL OR Name = 'Beijing'", "--set", "Pop=5")[1]
    assert "2 rows of Cities_Tbl would be deleted" in run("delete", path, "Cities_Tbl", "--where", "Pop = 5", "--dry-run")[1]
    assert "deleted 1" in run("delete", path, "Cities_Tbl", "--oids", "3,99")[1]
    assert "OBJECTID 4" in run("insert", path, "Cities_Tbl", "--set", "Name=D")[1]  # 3 is not given again
    assert run("update-geom", path, "Capitals", "1", "3", "4.5")[0] == 0
    assert "SHAPE=POINT(3 4.5)" in run("read", path, "Capitals")[1].replace("3.0000000", "3").replace("2.9999998", "3")
    assert run("update-attr", path, "Capitals", "1", "Name", "null")[0] == 0 and "Name=<null>" in run("read", path, "Capitals")[1]
    assert run("insert", path, "Regions", "--ring", "0,0;1,0")[0] == 1 and run("insert", path, "Regions", "--ring", "0,0;1,0;1,1")[0] == 0
    for bad in (("read", path, "nope"), ("update", path, "Cities_Tbl", "--oid", "1", "--set", "Pop=x"), ("delete", path, "Cities_Tbl", "--where", "Pop ="), ("update", path, "Cities_Tbl", "--oid", "1", "--set", "nope=1")):
        assert run(*bad)[0] == 1


def test_scalars():
    assert scalars.ole_time(0.0) == scalars.EPOCH and scalars.ole_time(scalars.ole_days(WHEN)) == WHEN
    assert scalars.iso(WHEN) == "2024-05-06 07:08:09.123456" and scalars.iso(scalars.EPOCH) == "1899-12-30 00:00:00"
    assert scalars.parse_time("2024-05-06T07:08:09.1234569") == WHEN and scalars.parse_time("2024-05-06 7:x").hour == 7
    assert scalars.parse_uuid("{" + UUID.upper() + "}") == UUID
    assert scalars.parse_value("NuLl", "string") is None and scalars.parse_value("+5", "int16") == 5
    for text, kind in (("70000", "int16"), ("1_0", "int32"), ("x", "float64"), ("12", "uuid"), ("2024", "date"), ("x", "geometry"), ("-1", "oid")):
        with pytest.raises(ValueError):
            scalars.parse_value(text, kind)


def test_xml_helpers(spark):
    from pyspark.sql import functions as F

    text = "<DEFeatureClassInfo><GeometryType>esriGeometryPoint</GeometryType><WKT>GEOGCS[\"x\"]</WKT></DEFeatureClassInfo>"
    row = spark.createDataFrame([(text,)], "x string").select(scalars.is_dataset_xml(F.col("x")), scalars.xml_wkt(F.col("x")), scalars.xml_geometry_type(F.col("x"))).first()
    assert list(row) == [True, 'GEOGCS["x"]', "esriGeometryPoint"]


def test_typed_columns(spark):
    from pyspark.sql import functions as F

    def typed(text, kind):
        return spark.createDataFrame([(text,)], "x string").select(scalars.typed(F.col("x"), kind)).first()[0]

    for text, kind in (("+5", "int16"), ("-7", "int64"), ("1e3", "float64"), ("nULL", "int32"), ("x", "string"), ("2024-05-06T07:08:09.1234569", "datetime"), ("2024-05-06", "date"), ("{" + UUID.upper() + "}", "uuid"), ("12", "oid")):
        assert typed(text, kind) == scalars.parse_value(text, kind), (text, kind)
    for text, kind in (("70000", "int16"), ("1_0", "int32"), ("x", "float64"), ("12", "uuid"), ("2024", "date"), ("-1", "oid")):
        with pytest.raises(Exception, match="not a value"):
            typed(text, kind)


def test_filters_and_columns_reach_the_reader(spark, tmp_path):
    spark.dataSource.register(GdbDataSource)
    path = str(tmp_path / "f.gdb")
    rows = spark.createDataFrame([(i, f"n{i}", i / 2) for i in range(1, 501)], "OBJECTID long, Name string, Val double")
    rows.coalesce(2).write.format("gdb").option("table", "P").mode("append").save(path)
    found = datasource.read(spark, path, "P", slotsPerPartition=50).where("OBJECTID in (7, 8, 420) and Val > 3.6")
    assert sorted(map(tuple, found.collect())) == [(8, "n8", 4.0), (420, "n420", 210.0)]
    assert found.rdd.getNumPartitions() == 2
    some = datasource.read(spark, path, "P", columns=("Val", "OBJECTID"), slotsPerPartition=50).where("OBJECTID > 480 and OBJECTID <= 482")
    assert some.columns == ["Val", "OBJECTID"] and sorted(map(tuple, some.collect())) == [(240.5, 481), (241.0, 482)]
    assert some.rdd.getNumPartitions() == 1
    assert datasource.read(spark, path, "P").where("OBJECTID = 9999").collect() == []
