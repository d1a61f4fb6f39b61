import numpy as np
import pytest

from tracelet.sources import binary, config, gmm_xml, tiff


def test_options():
    text = "# run\nimgFilePattern=/a/TM???.tif\ndebugPathPrefix=/out\nbackgroundThreshold=200\nmaxIterEM = 7 # few\nnonsense line\na=b=c\n"
    o = config.parse_options(text)
    assert (o.imgFilePattern, o.backgroundThreshold, o.maxIterEM, o.KmaxNumNNsupervoxel) == ("/a/TM???.tif", 200.0, 7, 10)
    with pytest.warns(UserWarning):
        config.parse_options(text + "odd=1\n")
    with pytest.raises(ValueError, match="debugPathPrefix"):
        config.parse_options("imgFilePattern=x\nbackgroundThreshold=1")


def test_numbered_paths(spark):
    from pyspark.sql import functions as F

    assert config.numbered_path("/a?/TM???/x_??.tif", 7) == "/a?/TM007/x_07.tif"
    assert config.numbered_path("TM??", 123) == "TM123"
    got = spark.range(1).select(config.numbered_path_column("/a?/TM???/x_??.tif", F.lit(7)).alias("p")).collect()[0]["p"]
    assert got == "/a?/TM007/x_07.tif"
    back = spark.createDataFrame([("/q/TM042.svb",)], "p string").select(config.frame_of_path("/q/TM???.svb", F.col("p")).alias("f")).collect()[0]["f"]
    assert back == 42


def test_regions_round_trip(spark, tmp_path):
    regions = [(3, 2, (9, 8, 7), [1, 5, 6]), (3, 2, (9, 8, 7), [])]
    (tmp_path / "a.svb").write_bytes(binary.write_regions(regions))
    got = [(r["frame"], r["dims"], r["voxels"]) for r in binary.read_regions(spark, str(tmp_path / "*.svb")).orderBy("sv_id").collect()]
    assert got == [(3, [9, 8, 7], [1, 5, 6]), (3, [9, 8, 7], [])]


def test_segmentation_round_trip(spark, tmp_path):
    nodes = [(0, None, 9.0, None), (1, 0, 0.0, 0), (2, 0, 0.0, 1)]
    regions = [(0, 2, (4, 4, 1), [0, 1]), (0, 2, (4, 4, 1), [7])]
    data = binary.write_segmentation(regions, nodes)
    assert binary.parse_segmentation(data)[1] == nodes
    (tmp_path / "a.bin").write_bytes(data)
    got = [(r["node"], r["parent"], r["thr"], r["region"]) for r in binary.read_dendrograms(spark, str(tmp_path / "a.bin")).orderBy("node").collect()]
    assert got == nodes
    with pytest.raises(ValueError):
        binary.parse_segmentation(binary.write_segmentation([], [*nodes, (3, 0, 0.0, None)]))


def test_other_binaries(spark, tmp_path):
    rows = [(0, 1.0, 0.0, 1.5, 2.5, 3.5, 1.0, None, 3.0), (2, 2.0, 0.0, 1.0, 2.0, 3.0, 1.0, 1.0, 0.0)]
    assert list(binary.parse_lineages(binary.write_lineages(rows))) == rows
    (tmp_path / "l").write_bytes(binary.write_lineages(rows))
    assert binary.read_lineages(spark, str(tmp_path / "l")).filter("parent is null").count() == 1
    r, c = np.array([[0.75, 0.25], [0.25, 0.75]], "f4"), np.array([[4, 5], [6, 7]], "i4")
    got = list(binary.parse_responsibilities(binary.write_responsibilities(r, c)))
    assert [(label, comp) for _, label, weight, comp in got if weight > 0.5] == [(0, 4), (1, 7)]
    x, y = np.arange(6, dtype="f4").reshape(3, 2), np.array([1, -1, 1], "f4")
    assert list(binary.parse_training(binary.write_training(x, y)))[1] == ([2.0, 3.0], -1.0)
    flow = np.arange(24, dtype="<f4")
    assert binary.parse_flow(flow.tobytes(), (2, 2, 2))[1].tolist() == [1, 0, 0, 1, 9, 17]
    assert binary.parse_drift("1 0.5 0 2\n\n2 1 1 1\n") == [(1, 0.5, 0.0, 2.0), (2, 1.0, 1.0, 1.0)]
    assert binary.parse_swc("# n\n1 1 0 0 0 2.5 -1\n2 3 1 0 0 1 1\n")[1] == (2, 3, 1.0, 0.0, 0.0, 1.0, 1)


@pytest.mark.parametrize("kind", ["uint8", "uint16", "float32"])
def test_tiff_round_trip(spark, tmp_path, kind):
    stack = (np.arange(3 * 4 * 5).reshape(3, 4, 5) * 3 % 250).astype(kind)
    data = tiff.write_pages(list(stack))
    assert (np.stack(list(tiff.read_pages(data))) == stack).all()
    (tmp_path / "a.tif").write_bytes(data)
    v = tiff.read_voxels(spark, str(tmp_path / "a.tif"))
    assert v.count() == 60 and v.filter("z = 2 and y = 1 and x = 3").collect()[0]["v"] == float(stack[2, 1, 3])


def test_tiff_errors_and_promotion():
    with pytest.raises(ValueError):
        list(tiff.read_pages(b"PK\x03\x04" + bytes(20)))
    assert tiff._unpack_bits(bytes([2, 7, 8, 9, 254, 5, 128])) == bytes([7, 8, 9, 5, 5, 5])
    p = tiff.promoted(np.full((1, 2, 2), 3, np.uint8))
    assert p.dtype == np.uint16 and p.shape[0] == 2 and p[0, 0, 0] == 768


def test_gmm_xml_round_trip(spark, tmp_path):
    rows = [(0, 5, None, 3, 0.5, [1.0, 1.0, 5.0], [2, 3]), (1, 5, 0, 3, None, [1.0, 1.0, 5.0], None)]
    df = spark.createDataFrame(rows, "id long, lineage long, parent long, dims int, splitScore double, m array<double>, svIdx array<int>")
    gmm_xml.write_gmm(df, str(tmp_path / "x"))
    got = gmm_xml.read_gmm(spark, str(tmp_path / "x")).orderBy("id").collect()
    assert [(r["id"], r["lineage"], r["parent"], r["dims"], r["splitScore"], r["m"], r["svIdx"]) for r in got] == rows
