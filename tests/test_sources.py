import gzip
import shutil
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.sources import dicom, nifti, text


@pytest.fixture
def image(spark, tmp_path):
    nifti.register(spark)
    df = spark.range(4 * 3 * 2 * 5).selectExpr("cast(id % 4 as int) x", "cast(id div 4 % 3 as int) y", "cast(id div 12 % 2 as int) z", "cast(id div 24 as int) t", "id * 0.5 - 3 as v")
    return df.selectExpr("'a' image", "cast(z * 12 + y * 4 + x as long) voxel", "x", "y", "z", "t", "v"), tmp_path


@pytest.mark.parametrize("dt,slope", [("float32", 1), ("float64", 0), ("int16", 0.5), ("uint8", 0.5), ("int32", 0.25), ("int64", 0.5)])
def test_round_trip(spark, image, dt, slope):
    df, d = image
    p = f"{d}/a.nii"
    inter = -10 if dt == "uint8" else 0
    df.write.format("nifti").mode("overwrite").options(path=p, xdim=4, ydim=3, zdim=2, vdim=5, dt=dt, slope=slope, inter=inter, tr=1.4, affine="3,0,0,-1,0,3,0,-2,0,0,3,-3,0,0,0,1").save()
    b = spark.read.format("nifti").option("values_per_task", 24).load(p)
    j = b.join(df.selectExpr("x", "y", "z", "t", "v as w"), ["x", "y", "z", "t"])
    assert b.count() == 120 and j.agg(F.max(F.abs(F.col("v") - F.col("w")))).first()[0] == 0
    assert b.where("t = 2 and x > 1").count() == 12 and b.count() == 120
    assert spark.read.format("nifti").options(t="2", x="2:9").load(p).count() == 12
    h = nifti.read_header(p)
    assert np.allclose(h.sform(), h.qform()) and h.pixdim[4] == pytest.approx(1.4)
    assert np.allclose(nifti.read_point(p, 1, 2, 1), [(t * 24 + 21) * 0.5 - 3 for t in range(5)])
    with gzip.open(p + ".gz", "wb") as g, open(p, "rb") as f:
        shutil.copyfileobj(f, g)
    z = spark.read.format("nifti").load(p + ".gz")
    assert z.selectExpr("sum(v)").first()[0] == b.selectExpr("sum(v)").first()[0]
    assert spark.read.format("nifti_header").load(p).first().vdim == 5


def test_headers(tmp_path):
    m = np.array([[0, -2.0, 0, 5], [3, 0, 0, 6], [0, 0, 4, 7], [0, 0, 0, 1]])
    h = nifti.Header((2, 2, 2, 1), pixdim=(1.0, 3.0, 2.0, 4.0, 1, 0, 0, 0), sform_code=1, srow=tuple(m[:3].ravel()))
    nifti.append_comment(h, "first")
    nifti.append_comment(h, "second line")
    p = tmp_path / "h.nii"
    p.write_bytes(nifti.header_bytes(h) + np.zeros(8, "<f4").tobytes())
    b = nifti.read_header(str(p))
    assert [c.rstrip(b"\0") for _, c in b.extensions] == [b"first", b"second line"] and b.offset % 16 == 0
    assert np.allclose(b.qform(), m, atol=1e-5)
    p.write_bytes(b"x" * 400)
    with pytest.raises(ValueError):
        nifti.read_header(str(p))
    with pytest.raises(ValueError):
        nifti.Header((1, 1, 1, 1), code=32).type
    with pytest.raises(FileNotFoundError):
        nifti.paths_of({"path": str(tmp_path / "none.nii")})


def test_integers_on_write():
    w = nifti.SampleWriter.__new__(nifti.SampleWriter)
    w.h = nifti.Header((1, 1, 1, 1), code=4)
    assert list(w.encode(np.array([1.9, -1.9, np.nan, 1e9, -1e9]))) == [1, -1, 0, 32767, -32768]


def test_text(spark, tmp_path):
    p = tmp_path / "r.txt"
    p.write_text("1 2\t3\n\n  4 5 6\r\n7 8 9")
    got = {(r.t, r.r): r.value for r in text.regressors(spark, str(p)).collect()}
    assert got[(0, 0)] == 1 and got[(1, 2)] == 5 and got[(2, 3)] == 9 and len(got) == 12
    (tmp_path / "c.txt").write_text("0.5\n-1e3\n")
    assert [r.value for r in text.column(spark, str(tmp_path / "c.txt")).orderBy("t").collect()] == [0.5, -1000.0]
    (tmp_path / "i.txt").write_text("3\n1\n3\n")
    assert sorted(r.t for r in text.index_list(spark, str(tmp_path / "i.txt"), 5).collect()) == [1, 3]
    with pytest.raises(Exception, match="no such frame"):
        text.index_list(spark, str(tmp_path / "i.txt"), 3).collect()
    (tmp_path / "s.conf").write_text("# c\na = 1\na=2 # d\n")
    assert text.settings(str(tmp_path / "s.conf")) == {"a": "2"}
    text.write_column(spark.createDataFrame([(1, 2.0), (0, 1.0)], "t int, value double"), str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["1.000000e+00", "2.000000e+00"]


def element(grp, el, vr, value):
    value += b" " * (len(value) % 2)
    size = b"\0\0" + struct.pack("<I", len(value)) if vr in dicom.LONG_FORMS else struct.pack("<H", len(value))
    return struct.pack("<2H", grp, el) + vr.encode() + size + value


def test_dicom(spark, tmp_path):
    for k, series in enumerate(["s1", "s1", "s1", "s2"]):
        body = element(0x10, 0x10, "PN", b"A^B") + element(0x20, 0x0E, "UI", series.encode()) + element(0x20, 0x13, "IS", str(k + 1).encode())
        body += element(0x29, 0x1010, "OB", b"x### ASCCONV BEGIN ###\na.b = 0x1\nc = 2\n### ASCCONV END ###")
        (tmp_path / f"{k}.dcm").write_bytes(b"\0" * 128 + b"DICM" + body + element(0x7FE0, 0x10, "OW", b"1234"))
    (tmp_path / "other.txt").write_bytes(b"no image")
    els = dicom.elements(spark, str(tmp_path))
    assert els.where("grp = 32736").count() == 0
    f = dicom.fields(els)
    assert f.count() == 4 and f.first().patientname == "A^B"
    r = dicom.reliable(f).collect()
    assert [(x.instance, x.series.endswith("s1")) for x in r] == [(2, True)]
    assert {(x.key, x.value) for x in dicom.protocol_values(els).collect()} == {("a.b", "0x1"), ("c", "2")}


def test_dicom_numbers_and_protocol(spark, tmp_path):
    body = element(0x02, 0x13, "SH", b"V 1") + element(0x19, 0x1028, "FD", struct.pack("<d", 12.5)) + element(0x19, 0x1029, "FD", struct.pack("<3d", 0, 1.5, 3))
    body += element(0x28, 0x10, "US", struct.pack("<H", 384)) + element(0x28, 0x11, "US", struct.pack("<H", 320))
    body += element(0x29, 0x1020, "OB", b"### ASCCONV BEGIN ###\nsPat.lAccelFactPE = 2\nsKSpace.lPhaseEncodingLines\t = 64\n### ASCCONV END ###")
    body += element(0x51, 0x100B, "LO", b"64*64") + element(0x51, 0x100C, "SH", b"FoV 192*192")
    (tmp_path / "a.dcm").write_bytes(b"\0" * 128 + b"DICM" + body)
    (tmp_path / "b.dcm").write_bytes(b"\0" * 128 + b"DICM" + element(0x10, 0x10, "PN", b"A^B"))
    a, b = dicom.fields(dicom.elements(spark, str(tmp_path))).orderBy("path").collect()
    assert (a.implementationversionname, a.matrixsize, a.fieldofview) == ("V 1", "64*64", "FoV 192*192")
    assert (a.dicom_rows, a.dicom_columns, a.bandwidthperpixelphaseencode, a.mosaicrefacqtimes) == (384, 320, 12.5, [0.0, 1.5, 3.0])
    assert (a.grappafactor, a.phaseencodinglines, a.dwelltime) == ("2", "64", 1 / (64 * 12.5))
    assert b.dicom_rows is None and b.grappafactor is None and b.dwelltime is None
