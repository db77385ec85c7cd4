"""mzML as DataFrames: spectra, chromatograms, headers, offset indexes.

Spark's XML reader takes one row for each element, with a fixed schema of
strings, so nothing is inferred and a single child is an array of one.  Gzip
files (indexed or not) are read by their suffix.  Write spectra to Parquet
sorted by native_id once, and look-ups by id are pruned by its statistics.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from specframe.functions.numeric import PRECISIONS
from specframe.operators import spectra as sp
from specframe.session import importable
from specframe.sources import codec, igzip

_CV = "array<struct<_cvRef: string, _accession: string, _name: string, _value: string, _unitName: string, _unitAccession: string, _unitCvRef: string>>"
_ARRAYS = f"struct<binaryDataArray: array<struct<_encodedLength: string, _arrayLength: string, cvParam: {_CV}, binary: string>>>"
_ISOLATION = f"struct<cvParam: {_CV}>"
SPECTRUM_XML = (
    f"_id string, _index string, _defaultArrayLength string, cvParam {_CV}, referenceableParamGroupRef array<struct<_ref: string>>, "
    f"scanList struct<cvParam: {_CV}, scan: array<struct<cvParam: {_CV}, scanWindowList: struct<scanWindow: array<struct<cvParam: {_CV}>>>>>>, "
    f"precursorList struct<precursor: array<struct<_spectrumRef: string, isolationWindow: {_ISOLATION}, selectedIonList: struct<selectedIon: array<struct<cvParam: {_CV}>>>, activation: struct<cvParam: {_CV}>>>>, "
    f"binaryDataArrayList {_ARRAYS}"
)
CHROMATOGRAM_XML = (
    f"_id string, _index string, _defaultArrayLength string, cvParam {_CV}, precursor struct<isolationWindow: {_ISOLATION}, activation: struct<cvParam: {_CV}>>, "
    f"product struct<isolationWindow: {_ISOLATION}>, binaryDataArrayList {_ARRAYS}"
)
MZ, INTENSITY, TIME = "m/z array", "intensity array", "time array"
MOBILITY = "mean inverse reduced ion mobility array"


def _cv(x: Column) -> Column:
    """Parameters under short names."""
    return F.transform(F.coalesce(x, F.array().cast(_CV)), lambda p: F.struct(p["_accession"].alias("accession"), p["_name"].alias("name"), F.coalesce(p["_value"], F.lit("")).alias("value"), p["_unitName"].alias("unit"), p["_unitCvRef"].alias("unit_cv")))


def _arrays(x: Column) -> Column:
    def one(a: Column) -> Column:
        cv = _cv(a["cvParam"])
        named = F.get(F.filter(cv, lambda p: p["name"].endswith("array")), F.lit(0))
        return F.struct(named["name"].alias("name"), F.transform(cv, lambda p: p["accession"]).alias("accessions"), cv.alias("cv"), a["binary"].alias("b64"))

    return F.transform(F.coalesce(x["binaryDataArray"], F.array().cast("array<struct<_encodedLength: string, _arrayLength: string, cvParam: " + _CV + ", binary: string>>")), one)


def file_format(path: str) -> str:
    """plain, gzip or igzip, as the suffix and the first bytes say."""
    if re.search(r"\.i?gz$", str(path)):
        return "igzip" if os.path.exists(path) and igzip.is_indexed(path) else "gzip"
    return "plain"


def encoding_of(spark: SparkSession, path: str) -> str:
    """What the first line declares; UTF-8 otherwise."""
    row = spark.read.text(path).select(F.regexp_extract("value", r'encoding="([^"]+)"', 1).alias("e")).first()
    return (row and row["e"]) or "utf-8"


def _read(spark: SparkSession, path: str, tag: str, schema: str, encoding: str | None) -> DataFrame:
    charset = encoding or encoding_of(spark, path)
    return spark.read.format("xml").option("rowTag", tag).option("charset", charset).option("mode", "FAILFAST").schema(schema).load(path).withColumn("path", F.col("_metadata.file_path"))


def spectra(spark: SparkSession, path: str, encoding: str | None = None, precisions: dict[int, float] | None = None) -> DataFrame:
    """One row a scan; arrays stay encoded until ``arrays_of`` or ``peaks`` asks for them."""
    return normalise_spectra(_read(spark, path, "spectrum", SPECTRUM_XML, encoding), precisions)


def normalise_spectra(raw: DataFrame, precisions: dict[int, float] | None = None) -> DataFrame:
    levels = PRECISIONS | (precisions or {})
    scan = F.coalesce(F.get(F.col("scanList.scan"), F.lit(0))["cvParam"], F.array().cast(_CV))
    first_time = F.get(sp.params(_cv(scan), sp.SCAN_TIME), F.lit(0))
    ion = lambda p: F.transform(
        p["selectedIonList"]["selectedIon"],
        lambda s: F.struct(
            sp.param_number(_cv(s["cvParam"]), sp.PRECURSOR_MZ).alias("mz"),
            sp.param_number(_cv(s["cvParam"]), sp.PRECURSOR_I).alias("i"),
            sp.param(_cv(s["cvParam"]), sp.CHARGE).try_cast("int").alias("charge"),
            sp.native_id(p["_spectrumRef"]).alias("precursor_id"),
            p["_spectrumRef"].alias("precursor_ref"),
        ),
    )
    out = raw.select(
        *(c for c in ("path",) if c in raw.columns),
        F.col("_id").alias("id_raw"),
        sp.native_id("_id").alias("native_id"),
        sp.id_map("_id").alias("id_map"),
        F.col("_index").cast("bigint").alias("idx"),
        F.concat(_cv(F.col("cvParam")), _cv(scan)).alias("cv"),
        _cv(F.col("cvParam")).alias("own_cv"),
        F.get(F.col("referenceableParamGroupRef"), F.lit(0))["_ref"].alias("group_ref"),
        first_time["value"].try_cast("double").alias("scan_time"),
        F.when(first_time.isNotNull(), F.coalesce(first_time["unit"], F.lit("unicorns"))).alias("scan_time_unit"),
        F.coalesce(F.flatten(F.transform(F.col("precursorList.precursor"), ion)), F.array().cast("array<struct<mz: double, i: double, charge: int, precursor_id: bigint, precursor_ref: string>>")).alias("precursors"),
        _arrays(F.col("binaryDataArrayList")).alias("arrays"),
    )
    level = sp.param("cv", sp.MS_LEVEL).try_cast("int")
    precision = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    return (
        out.withColumn("ms_level", level)
        .withColumn("tic", sp.param_number("own_cv", sp.TIC))
        .withColumn("is_profile", F.exists("own_cv", lambda p: p["name"].isin("profile spectrum", "profile mass spectrum")))
        .withColumn("measured_precision", F.try_element_at(precision, F.coalesce("ms_level", F.lit(0))))
        .drop("own_cv")
    )


def chromatograms(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    return normalise_chromatograms(_read(spark, path, "chromatogram", CHROMATOGRAM_XML, encoding))


def normalise_chromatograms(raw: DataFrame) -> DataFrame:
    return raw.select(
        *(c for c in ("path",) if c in raw.columns),
        F.col("_id").alias("id"),
        F.col("_index").cast("bigint").alias("idx"),
        _cv(F.col("cvParam")).alias("cv"),
        _cv(F.col("precursor.isolationWindow.cvParam")).alias("precursor_cv"),
        _cv(F.col("product.isolationWindow.cvParam")).alias("product_cv"),
        _arrays(F.col("binaryDataArrayList")).alias("arrays"),
    )


def array_names(arrays: Column | str = "arrays") -> Column:
    """Names of all arrays whose parameters have a unit of the MS vocabulary."""
    arrays = F.col(arrays) if isinstance(arrays, str) else arrays
    own = F.flatten(F.transform(arrays, lambda a: F.filter(a["cv"], lambda p: p["unit_cv"] == "MS")))
    return F.transform(own, lambda p: p["name"])


def array_of(name: str, arrays: Column | str = "arrays") -> Column:
    """One decoded array by its name (or by a parameter's value); empty if there is none."""
    arrays = F.col(arrays) if isinstance(arrays, str) else arrays
    a = F.get(F.filter(arrays, lambda x: F.exists(x["cv"], lambda p: (p["name"] == name) | (p["value"] == name))), F.lit(0))
    return codec.decoded(a["b64"], a["accessions"])


def mobility(arrays: Column | str = "arrays") -> Column:
    return array_of(MOBILITY, arrays)


def peaks(spectra_: DataFrame, keys: tuple[str, ...] = ("native_id",)) -> DataFrame:
    """keys…, pos, mz, i.  Filter the spectra first: what is filtered out isn't decoded."""
    importable(spectra_.sparkSession)
    two = spectra_.select(*keys, array_of(MZ).alias("mz"), array_of(INTENSITY).alias("i"))
    return two.select(*keys, F.posexplode(F.arrays_zip("mz", "i")).alias("pos", "p")).select(*keys, "pos", "p.mz", "p.i")


def chromatogram_points(chromatograms_: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys…, pos, time, i."""
    importable(chromatograms_.sparkSession)
    return sp.chromatogram_points(chromatograms_.select(*keys, array_of(TIME).alias("time"), array_of(INTENSITY).alias("i")), keys)


# -- from strings and bytes ----------------------------------------------------------------------------------------------


def elements(documents: DataFrame, xml: str = "xml", tag: str = "spectrum") -> DataFrame:
    """path (if there), element: each element of a tag in whole documents."""
    found = F.regexp_extract_all(xml, F.lit(f"(?s)(<{tag}\\s.*?</{tag}>)"), F.lit(1))
    return documents.select(*(c for c in documents.columns if c != xml), F.explode(found).alias("element"))


def spectra_from_xml(rows: DataFrame, element: str = "element", precisions: dict[int, float] | None = None) -> DataFrame:
    """Spectra of a table that holds each one's XML, such as a store of (id, xml)."""
    parsed = rows.select(*(c for c in rows.columns if c == "path"), F.from_xml(element, SPECTRUM_XML).alias("x"))
    return normalise_spectra(parsed.select(*(c for c in parsed.columns if c == "path"), "x.*"), precisions)


def chromatograms_from_xml(rows: DataFrame, element: str = "element") -> DataFrame:
    parsed = rows.select(*(c for c in rows.columns if c == "path"), F.from_xml(element, CHROMATOGRAM_XML).alias("x"))
    return normalise_chromatograms(parsed.select(*(c for c in parsed.columns if c == "path"), "x.*"))


def spectra_from_bytes(spark: SparkSession, data: bytes, encoding: str | None = None) -> DataFrame:
    """Spectra of a document held in memory."""
    if encoding is None:
        m = re.search(rb'encoding="([^"]+)"', data[:200])
        encoding = m[1].decode() if m else "utf-8"
    return spectra_from_xml(elements(spark.createDataFrame([(data.decode(encoding),)], "xml string")))


def raw_elements(spark: SparkSession, path: str, tag: str = "spectrum", encoding: str | None = None) -> DataFrame:
    """path, element: the text of each element of a tag, from files split at their end tags."""
    t = spark.read.option("encoding", encoding or encoding_of(spark, path)).text(path, lineSep=f"</{tag}>").select(F.col("_metadata.file_path").alias("path"), "value")
    found = F.regexp_extract("value", rf"(?s)(<{tag}\s.*)$", 1)
    return t.select("path", F.concat(found, F.lit(f"</{tag}>")).alias("element")).where(F.col("element") != f"</{tag}>")


# -- writing --------------------------------------------------------------------------------------------------------------

_COMPRESSIONS = {codec.ZLIB: "zlib compression"}
_TYPES = {"MS:1000523": "64-bit float", "MS:1000521": "32-bit float"}


def spectrum_elements(arrays: DataFrame, key: str, accessions: list[str], ms_level: Column | int = 1) -> DataFrame:
    """key, element: spectra of (key, mz, i), arrays, as XML."""
    importable(arrays.sparkSession)
    kinds = "".join(f'<cvParam cvRef="MS" accession="{a}" name="{(_TYPES | _COMPRESSIONS).get(a, "numpress")}" value=""/>' for a in accessions)

    def array(name: str, accession: str, values: str) -> Column:
        head = f'<binaryDataArray encodedLength="0">{kinds}<cvParam cvRef="MS" accession="{accession}" name="{name}" value="" unitCvRef="MS"/><binary>'
        return F.concat(F.lit(head), F.coalesce(codec.encoded(values, accessions), F.lit("")), F.lit("</binary></binaryDataArray>"))

    level = F.lit(ms_level) if isinstance(ms_level, int) else ms_level
    xml = F.concat(
        F.lit('<spectrum index="0" defaultArrayLength="'), F.coalesce(F.size("mz"), F.lit(0)), F.lit('" id="controllerType=0 controllerNumber=1 scan='), F.col(key), F.lit('"><cvParam cvRef="MS" accession="MS:1000511" name="ms level" value="'),
        level, F.lit('"/><binaryDataArrayList count="2">'), array(MZ, "MS:1000514", "mz"), array(INTENSITY, "MS:1000515", "i"), F.lit("</binaryDataArrayList></spectrum>"),
    )
    return arrays.select(key, xml.alias("element"))


def write(elements_: DataFrame, folder: str, suffix: str = "mzML", files: int | None = None, run: str = "run", instrument: str = "instrument") -> str:
    """Write a column ``element`` to files of a shared folder, one a partition or so many as ``files`` says, and return the folder.

    A file's head says how many spectra it has, so bodies are written first, and
    the file gets its name when it is whole.  With ``files``, each task deals its
    elements to a body for each file, and the bodies' tasks copy them to their
    places in it, so no task has a whole file.
    """
    import gzip
    import shutil

    from pyspark import TaskContext

    packed = suffix.endswith("gz")
    tail = "</spectrumList></run></mzML>\n"

    def head(n: int) -> bytes:
        text = f"""<?xml version="1.0" encoding="utf-8"?>
<mzML version="1.1.0"><cvList count="1"><cv id="MS" version="4.1.79" URI=""/></cvList>
<softwareList count="1"><software id="specframe" version="1"/></softwareList>
<instrumentConfigurationList count="1"><instrumentConfiguration id="IC1"><cvParam cvRef="MS" accession="MS:1000031" name="{instrument}" value=""/></instrumentConfiguration></instrumentConfigurationList>
<run id="{run}"><spectrumList count="{n}">
""".encode()
        return gzip.compress(text) if packed else text

    def body(path: str):
        return (gzip.open if packed else open)(path, "wt", encoding="utf-8")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = os.path.join(folder, f"part-{task.partitionId():05d}.{suffix}")
        own, rest = (os.path.join(folder, f".{x}-{task.partitionId()}-{task.taskAttemptId()}") for x in ("whole", "body"))
        n = 0
        with body(rest) as f:
            for batch in batches:
                for element in batch.column(0):
                    f.write(element.as_py() + "\n")
                    n += 1
            f.write(tail)
        with open(own, "wb") as f, open(rest, "rb") as b:
            f.write(head(n))
            shutil.copyfileobj(b, f)
        os.remove(rest)
        os.replace(own, name)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        bodies: dict[int, tuple] = {}
        counts: dict[int, int] = {}
        k = task.partitionId()
        for batch in batches:
            for element in batch.column(0):
                which = k % files
                if which not in bodies:
                    path = os.path.join(folder, f".body-{which}-{task.partitionId()}-{task.taskAttemptId()}")
                    bodies[which] = path, body(path)
                bodies[which][1].write(element.as_py() + "\n")
                counts[which] = counts.get(which, 0) + 1
                k += 1
        for _, f in bodies.values():
            f.close()
        at = sorted(bodies)
        yield pa.RecordBatch.from_pydict({"file": pa.array(at, pa.int64()), "part": pa.array([task.partitionId()] * len(at), pa.int64()), "path": pa.array([bodies[x][0] for x in at], pa.string()), "n": pa.array([counts[x] for x in at], pa.int64()), "size": pa.array([os.path.getsize(bodies[x][0]) for x in at], pa.int64())})

    rows = elements_.select("element")
    spark = rows.sparkSession
    importable(spark)
    if files is None:
        rows.mapInArrow(store, "n long").count()
        return folder
    parts = sorted(rows.mapInArrow(deal, "file long, part long, path string, n long, size long").collect())
    places, names = [], []
    for which in range(files):
        own = os.path.join(folder, f".whole-{which}-{os.getpid()}")
        bodies = [r for r in parts if r.file == which]
        with open(own, "wb") as f:
            at = f.write(head(sum(r.n for r in bodies)))
            for r in bodies:
                places.append((r.path, own, at))
                at += r.size
            f.seek(at)
            f.write(gzip.compress(tail.encode()) if packed else tail.encode())
        names.append((own, os.path.join(folder, f"part-{which:05d}.{suffix}")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                path, own, at = places[k]
                with open(path, "rb") as b, open(own, "r+b") as f:
                    f.seek(at)
                    shutil.copyfileobj(b, f, 1 << 20)
            yield batch

    if places:
        spark.range(0, len(places), 1, len(places)).mapInArrow(place, "id long").count()
    for path, _, _ in places:
        os.remove(path)
    for own, name in names:
        os.replace(own, name)
    return folder


# -- headers and indexes -------------------------------------------------------------------------------------------------


def _tags(spark: SparkSession, path: str) -> DataFrame:
    """path, value: the text between each ``<`` and the next."""
    return spark.read.text(path, lineSep="<").select(F.col("_metadata.file_path").alias("path"), "value")


def _attribute(name: str) -> Column:
    return F.nullif(F.regexp_extract("value", rf'\b{name}="([^"]*)"', 1), F.lit(""))


_NAMED = "array<struct<accession: string, name: string, value: string>>"
_HEADER = (
    "path string, encoding string, mzml_version string, obo_version string, run_id string, start_time string, spectrum_count int, instrument string, "
    f"cv_list array<struct<id: string, version: string, uri: string>>, software array<struct<id: string, version: string>>, file_content {_NAMED}, source_files array<struct<id: string, name: string, location: string>>, "
    f"samples array<struct<id: string, name: string>>, param_groups array<struct<id: string, cv: {_NAMED}>>, instruments array<struct<id: string, groups: array<string>, cv: {_NAMED}>>, data_processing array<struct<id: string, steps: array<string>>>"
)


def header_of(path: str) -> dict:
    """What the head of one file says; reading stops at the first list of spectra or chromatograms."""
    import gzip
    import xml.etree.ElementTree as ET

    with open(path, "rb") as raw:
        packed = raw.read(2) == b"\x1f\x8b"
    out: dict = {"path": path} | {k: None for k in ("encoding", "mzml_version", "obo_version", "run_id", "start_time", "spectrum_count", "instrument")}
    out |= {k: [] for k in ("cv_list", "software", "file_content", "source_files", "samples", "param_groups", "instruments", "data_processing")}

    def named(e) -> list[dict]:
        return [{k: x.get(k) for k in ("accession", "name", "value")} for x in e if x.tag.endswith("cvParam")]

    with (gzip.open if packed else open)(path, "rb") as f:
        if m := re.search(rb'encoding="([^"]+)"', f.peek(200)[:200] if hasattr(f, "peek") else b""):
            out["encoding"] = m[1].decode()
        for event, e in ET.iterparse(f, events=("start", "end")):
            tag = e.tag.rpartition("}")[2]
            if event == "start":
                if tag == "mzML":
                    out["mzml_version"] = e.get("version")
                elif tag == "run":
                    out |= {"run_id": e.get("id"), "start_time": e.get("startTimeStamp")}
                elif tag in ("spectrumList", "chromatogramList"):
                    if tag == "spectrumList" and e.get("count"):
                        out["spectrum_count"] = int(e.get("count"))
                    break
            elif tag == "cv":
                out["cv_list"].append({"id": e.get("id"), "version": e.get("version"), "uri": e.get("URI")})
            elif tag == "software":
                out["software"].append({"id": e.get("id"), "version": e.get("version")})
            elif tag == "fileContent":
                out["file_content"] = named(e)
            elif tag == "sourceFile":
                out["source_files"].append({"id": e.get("id"), "name": e.get("name"), "location": e.get("location")})
            elif tag == "sample":
                out["samples"].append({"id": e.get("id"), "name": e.get("name")})
            elif tag == "referenceableParamGroup":
                out["param_groups"].append({"id": e.get("id"), "cv": named(e)})
            elif tag == "instrumentConfiguration":
                out["instruments"].append({"id": e.get("id"), "groups": [x.get("ref") for x in e if x.tag.endswith("referenceableParamGroupRef")], "cv": named(e)})
            elif tag == "dataProcessing":
                out["data_processing"].append({"id": e.get("id"), "steps": [p["name"] for m in e for p in named(m)]})
    out["obo_version"] = next((x["version"] for x in out["cv_list"] if x["id"] == "MS"), None)
    groups = {x["id"]: x["cv"] for x in out["param_groups"]}
    out["instrument"] = next((p["name"] for x in out["instruments"] for p in [*x["cv"], *(p for g in x["groups"] for p in groups.get(g, []))]), None)
    return out


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, from the file's head alone: versions, run, declared spectra, the instrument's name, and the header's lists."""
    files = spark.read.format("binaryFile").load(path).select("path").distinct()

    schema = to_arrow_schema(spark.createDataFrame([], _HEADER).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([header_of(re.sub(r"^file:/*", "/", unquote(p))) | {"path": p} for p in batch.column(0).to_pylist()], schema=schema)

    importable(spark)
    return files.mapInArrow(run, _HEADER)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, from all of it: what ``headers`` has of versions, run and counts, and the count of chromatograms, whose list comes last."""
    tag = F.regexp_extract("value", r"^([?\w]+)", 1)
    t = _tags(spark, path).withColumn("tag", tag).where(F.col("tag").isin("?xml", "mzML", "cv", "software", "run", "spectrumList", "chromatogramList"))
    pick = lambda tag, name: F.max(F.when(F.col("tag") == tag, _attribute(name)))
    listed = lambda tag, **names: F.array_sort(F.collect_set(F.when(F.col("tag") == tag, F.struct(*[_attribute(a).alias(n) for n, a in names.items()]))))
    return t.groupBy("path").agg(
        pick(r"?xml", "encoding").alias("encoding"),
        pick("mzML", "version").alias("mzml_version"),
        F.max(F.when((F.col("tag") == "cv") & (_attribute("id") == "MS"), _attribute("version"))).alias("obo_version"),
        pick("run", "id").alias("run_id"),
        pick("run", "startTimeStamp").alias("start_time"),
        pick("spectrumList", "count").cast("int").alias("spectrum_count"),
        pick("chromatogramList", "count").cast("int").alias("chromatogram_count"),
        listed("software", id="id", version="version").alias("software"),
        listed("cv", id="id", version="version", uri="URI").alias("cv_list"),
    )


def scan_index(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, id_raw, native_id, offset of the index at a file's end.

    ``pattern`` is a Java regular expression with the groups ID and offset that
    is tried on each tag's text instead.
    """
    t = _tags(spark, path)
    if pattern is not None:
        both = F.regexp_extract("value", pattern, 0)
        groups = re.findall(r"\(\?<(\w+)>", pattern)
        if set(groups) != {"ID", "offset"}:
            raise ValueError("the pattern needs the groups ID and offset")
        a, b = groups.index("ID") + 1, groups.index("offset") + 1
        rows = t.where(both != "").select("path", F.regexp_extract("value", pattern, a).alias("id_raw"), F.regexp_extract("value", pattern, b).cast("bigint").alias("offset"))
        return rows.select("path", "id_raw", F.coalesce(sp.native_id("id_raw"), F.col("id_raw").try_cast("bigint")).alias("native_id"), "offset")
    own = t.where(F.col("value").startswith("offset ")).select("path", F.coalesce(_attribute("idRef"), _attribute("nativeID")).alias("id_raw"), F.regexp_extract("value", r">\s*(\d+)", 1).try_cast("bigint").alias("offset"))
    return own.select("path", "id_raw", sp.native_id("id_raw").alias("native_id"), "offset")


def scan_index_from_scratch(spark: SparkSession, path: str) -> DataFrame:
    """path, id_raw, native_id, offset, kind of every open tag in plain files, whatever their own index says.

    Files are searched in steps with an overlap, one task a file.
    """
    files = spark.read.format("binaryFile").load(path).select("path").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = re.compile(rb"<(spectrum|chromatogram)\s([^>]*)>")
        name = re.compile(rb'\bid="([^"]*)"')
        step, look_back = 1 << 20, 4096
        for batch in batches:
            for p in batch.column(0).to_pylist():
                found = {}
                with open(re.sub(r"^file:/*", "/", p), "rb") as f:
                    held, base = b"", 0
                    while chunk := f.read(step):
                        held += chunk
                        for m in tag.finditer(held):
                            if n := name.search(m[2]):
                                found[base + m.start()] = (m[1].decode(), n[1].decode("latin-1"))
                        base += max(0, len(held) - look_back)
                        held = held[-look_back:]
                at = sorted(found)
                yield pa.RecordBatch.from_pydict({"path": pa.array([p] * len(at), pa.string()), "id_raw": pa.array([found[k][1] for k in at], pa.string()), "offset": pa.array(at, pa.int64()), "kind": pa.array([found[k][0] for k in at], pa.string())})

    importable(spark)
    return files.mapInArrow(run, "path string, id_raw string, offset long, kind string").withColumn("native_id", sp.native_id("id_raw"))


def save(spectra_: DataFrame, path: str) -> None:
    """Parquet, in ranges of native_id, so that its statistics answer look-ups."""
    spectra_.repartitionByRange("native_id").sortWithinPartitions("native_id").write.mode("overwrite").parquet(path)
