"""DICOM elements of explicit-VR little-endian files as rows, and what is read from them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

LONG_FORMS = ("OB", "OW", "OF", "SQ", "UT", "UN")
PIXELS = (0x7FE0, 0x0010)
ELEMENTS = "path string, grp int, element int, vr string, value binary, numbers array<double>"
#: Binary number representations, as struct codes (fixed values of the standard).
BINARY = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d"}

#: Tag of the fields that are projected (fixed values of the standard).
FIELDS = {
    "implementationversionname": (0x0002, 0x0013), "acquisitiondate": (0x0008, 0x0022), "institutionname": (0x0008, 0x0080), "institutionaddress": (0x0008, 0x0081),
    "studydescription": (0x0008, 0x1030), "seriesdescription": (0x0008, 0x103E), "operatorsname": (0x0008, 0x1070),
    "manufacturermodelname": (0x0008, 0x1090), "patientname": (0x0010, 0x0010), "patientid": (0x0010, 0x0020),
    "patientbirthdate": (0x0010, 0x0030), "patientsex": (0x0010, 0x0040), "patientage": (0x0010, 0x1010), "patientweight": (0x0010, 0x1030),
    "sequencename": (0x0018, 0x0024), "slicethickness": (0x0018, 0x0050), "repetitiontime": (0x0018, 0x0080), "echotime": (0x0018, 0x0081),
    "magneticfieldstrength": (0x0018, 0x0087), "spacingbetweenslices": (0x0018, 0x0088), "numberofphaseencodingsteps": (0x0018, 0x0089),
    "pixelbandwidth": (0x0018, 0x0095), "softwareversions": (0x0018, 0x1020), "protocolname": (0x0018, 0x1030), "transmitcoilname": (0x0018, 0x1251),
    "inplanephaseencodingdirection": (0x0018, 0x1312), "patientposition": (0x0018, 0x5100), "studyinstance": (0x0020, 0x000D),
    "seriesinstance": (0x0020, 0x000E), "seriesnumber": (0x0020, 0x0011), "instancenumber": (0x0020, 0x0013), "imagecomments": (0x0020, 0x4000),
    "matrixsize": (0x0051, 0x100B), "fieldofview": (0x0051, 0x100C),
}


#: Fields stored as binary numbers: tag and type, the last one with all its values.
NUMBER_FIELDS = {
    "dicom_rows": (0x0028, 0x0010, "int"), "dicom_columns": (0x0028, 0x0011, "int"), "bandwidthperpixelphaseencode": (0x0019, 0x1028, "double"),
    "mosaicrefacqtimes": (0x0019, 0x1029, "array<double>"),
}
#: Fields of the scanner's protocol block, which one element holds.
PROTOCOL = (0x0029, 0x1020)
PROTOCOL_FIELDS = {"grappafactor": "sPat.lAccelFactPE", "phaseencodinglines": "sKSpace.lPhaseEncodingLines"}


def binary_numbers(vr: str, value: bytes) -> list[float] | None:
    """The numbers of a binary element, else None; bytes that make no whole number are left."""
    if vr not in BINARY:
        return None
    size = struct.calcsize("<" + BINARY[vr])
    n = len(value) // size
    return [float(x) for x in struct.unpack_from(f"<{n}{BINARY[vr]}", value)]


def walk(data: bytes) -> Iterator[tuple[int, int, str, bytes]]:
    """(group, element, vr, value) up to the pixels; stops at what is cut off or is no explicit-VR element."""
    if data[128:132] != b"DICM":
        return
    at = 132
    while at + 8 <= len(data):
        grp, el = struct.unpack_from("<2H", data, at)
        vr = data[at + 4 : at + 6].decode("latin-1")
        if (grp, el) == PIXELS or not (vr.isalpha() and vr.isupper()):
            return
        if vr in LONG_FORMS:
            if at + 12 > len(data):
                return
            size, at = struct.unpack_from("<I", data, at + 8)[0], at + 12
        else:
            size, at = struct.unpack_from("<H", data, at + 6)[0], at + 8
        if size == 0xFFFFFFFF or at + size > len(data):
            return
        yield grp, el, vr, data[at : at + size]
        at += size


def elements(spark: SparkSession, path: str) -> DataFrame:
    """One row per element of every DICOM file below a path; other files give none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, g, e, vr, v, binary_numbers(vr, v)) for p, c in zip(b["path"], b["content"]) for g, e, vr, v in walk(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "grp", "element", "vr", "value", "numbers"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, ELEMENTS)


def fields(els: DataFrame) -> DataFrame:
    """One row per file with the known fields: text trimmed, binary numbers, what the protocol block says, and the dwell time."""
    raw = F.decode("value", "ISO-8859-1")
    text = F.trim(F.translate(raw, "\0", " "))
    at = lambda g, e: (F.col("grp") == g) & (F.col("element") == e)
    cols = [F.max(F.when(at(g, e), text)).alias(n) for n, (g, e) in FIELDS.items()]
    for n, (g, e, kind) in NUMBER_FIELDS.items():
        v = F.col("numbers") if kind.startswith("array") else F.get("numbers", F.lit(0)).cast(kind)
        cols.append(F.max(F.when(at(g, e), v)).alias(n))
    for n, key in PROTOCOL_FIELDS.items():
        pattern = r"(?m)^[ \t]*" + key.replace(".", r"\.") + r"[ \t]*=[ \t]*(\S+)"
        cols.append(F.max(F.when(at(*PROTOCOL), F.nullif(F.regexp_extract(raw, pattern, 1), F.lit("")))).alias(n))
    out = els.groupBy("path").agg(*cols)
    return out.withColumn("dwelltime", dwell_time(F.col("phaseencodinglines").try_cast("double"), F.col("bandwidthperpixelphaseencode")))


def reliable(files: DataFrame) -> DataFrame:
    """Per input the middle instance of the largest series: path. Ties go to the later series key."""
    key = F.concat_ws("__", "patientid", "studyinstance", "seriesinstance")
    f = files.select("path", key.alias("series"), F.col("instancenumber").try_cast("int").alias("instance"))
    top = f.groupBy("series").count().agg(F.max(F.struct("count", "series")).alias("m")).select("m.series", F.col("m.count").alias("n"))
    w = W.partitionBy("series").orderBy("instance", "path")
    ranked = f.join(top, "series").withColumn("k", F.row_number().over(w) - 1)
    return ranked.where(F.col("k") == F.ceil((F.col("n") - 1) / 2)).select("path", "series", "instance")


def protocol_values(els: DataFrame) -> DataFrame:
    """key = value lines between the begin and end marks of the embedded scanner protocol: path, key, value."""
    text = F.decode("value", "ISO-8859-1")
    block = F.regexp_extract(text, r"(?s)### ASCCONV BEGIN[^\n]*###(.*?)### ASCCONV END ###", 1)
    line = els.select("path", F.explode(F.split(block, "\n")).alias("line")).where(F.col("line").contains("="))
    return line.select("path", F.trim(F.split_part("line", F.lit("="), F.lit(1))).alias("key"), F.trim(F.split_part("line", F.lit("="), F.lit(2))).alias("value"))


def dwell_time(lines_col, bandwidth_col):
    """1 / (phase-encoding lines x bandwidth per pixel) where both are positive."""
    return F.when((lines_col > 0) & (bandwidth_col > 0), 1 / (lines_col * bandwidth_col))
