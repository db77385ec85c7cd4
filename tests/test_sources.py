import gzip

import pytest
from pyspark.sql import functions as F

from specframe.operators import ontology, spectra, traces
from specframe.sources import codec, igzip, mzml, sqlite

ARRAY = '<binaryDataArray encodedLength="1"><cvParam cvRef="MS" accession="MS:1000523" name="64-bit float" value=""/><cvParam cvRef="MS" accession="{}" name="compression" value=""/><cvParam cvRef="MS" accession="MS:{}" name="{}" value="" unitCvRef="MS"/><binary>{}</binary></binaryDataArray>'


def arrays(a, b, first=("1000514", mzml.MZ)):
    kinds = ["MS:1000523", codec.ZLIB]
    return '<binaryDataArrayList count="2">' + ARRAY.format(codec.ZLIB, *first, codec.encode(a, kinds)) + ARRAY.format(codec.ZLIB, "1000515", mzml.INTENSITY, codec.encode(b, kinds)) + "</binaryDataArrayList>"


def spectrum(n, level, extra=""):
    return f"""<spectrum index="{n - 1}" id="controllerType=0 controllerNumber=1 scan={n}" defaultArrayLength="2">
<cvParam cvRef="MS" accession="MS:1000511" name="ms level" value="{level}"/><cvParam cvRef="MS" accession="MS:1000130" name="positive scan" value=""/>
<cvParam cvRef="MS" accession="MS:1000285" name="total ion current" value="9.5e07"/>
<scanList count="1"><scan><cvParam cvRef="MS" accession="MS:1000016" name="scan start time" value="{n}.5" unitName="second"/></scan></scanList>{extra}
{arrays([100.0 + n, 200.0], [10.0, 20.0 * n])}</spectrum>
"""


PRECURSOR = """<precursorList count="1"><precursor spectrumRef="controllerType=0 controllerNumber=1 scan=1"><selectedIonList count="1"><selectedIon>
<cvParam cvRef="MS" accession="MS:1000744" name="selected ion m/z" value="443.711242675781"/><cvParam cvRef="MS" accession="MS:1000041" name="charge state" value="2"/></selectedIon></selectedIonList></precursor></precursorList>"""
CHROMATOGRAM = f"""<chromatogram index="0" id="TIC" defaultArrayLength="2"><cvParam cvRef="MS" accession="MS:1000235" name="total ion current chromatogram" value=""/>
<precursor><isolationWindow><cvParam cvRef="MS" accession="MS:1000827" name="target" value="808.5"/></isolationWindow></precursor><product><isolationWindow><cvParam cvRef="MS" accession="MS:1000827" name="target" value="689.25"/></isolationWindow></product>
{arrays([0.5, 1.5], [3.0, 4.0], ("1000595", mzml.TIME))}</chromatogram>
"""
DOCUMENT = f"""<?xml version="1.0" encoding="ISO-8859-1"?>
<indexedmzML><mzML version="1.1.0"><cvList count="1"><cv id="MS" fullName="vocabulary" version="3.65.0" URI="x"/></cvList>
<fileDescription><fileContent><cvParam cvRef="MS" accession="MS:1000579" name="MS1 spectrum" value=""/></fileContent><sourceFileList count="1"><sourceFile id="f" name="n" location="here"/></sourceFileList></fileDescription>
<referenceableParamGroupList count="1"><referenceableParamGroup id="common"><cvParam cvRef="MS" accession="MS:1" name="a fine instrument" value=""/></referenceableParamGroup></referenceableParamGroupList><sampleList count="1"><sample id="s" name="yeast"/></sampleList>
<softwareList count="1"><software id="made" version="2"/></softwareList><instrumentConfigurationList count="1"><instrumentConfiguration id="IC1"><referenceableParamGroupRef ref="common"/></instrumentConfiguration></instrumentConfigurationList>
<dataProcessingList count="1"><dataProcessing id="dp"><processingMethod order="1" softwareRef="made"><cvParam cvRef="MS" accession="MS:2" name="peak picking" value=""/></processingMethod></dataProcessing></dataProcessingList><run id="made-run" startTimeStamp="2013-09-10T10:31:08Z">
<spectrumList count="5">
{spectrum(1, 1)}{spectrum(2, 2, PRECURSOR)}{spectrum(3, 1)}</spectrumList><chromatogramList count="1">{CHROMATOGRAM}</chromatogramList></run></mzML>
<indexList count="1"><index name="spectrum"><offset idRef="controllerType=0 controllerNumber=1 scan=1">42</offset><offset idRef="controllerType=0 controllerNumber=1 scan=2">99</offset></index></indexList></indexedmzML>
"""


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("mzml")
    (d / "a.mzML").write_text(DOCUMENT, encoding="latin-1")
    (d / "b.mzML.gz").write_bytes(gzip.compress(DOCUMENT.encode("latin-1")))
    igzip.index_mzml(str(d / "a.mzML"), str(d / "c.mzML.gz"))
    return d


@pytest.mark.parametrize("name", ["a.mzML", "b.mzML.gz", "c.mzML.gz"])
def test_spectra(spark, files, name):
    s = mzml.spectra(spark, str(files / name)).orderBy("native_id")
    rows = s.collect()
    assert [r.native_id for r in rows] == [1, 2, 3] and [r.ms_level for r in rows] == [1, 2, 1]
    assert rows[0].tic == 9.5e7 and rows[0].scan_time == 1.5 and rows[0].scan_time_unit == "second" and rows[0].measured_precision == 5e-6
    assert rows[1].precursors[0].mz == 443.711242675781 and rows[1].precursors[0].precursor_id == 1 and rows[1].precursors[0].charge == 2 and rows[1].precursors[0].i is None
    peaks = mzml.peaks(s.where("ms_level = 1")).orderBy("native_id", "pos").collect()
    assert [(r.native_id, r.pos, r.mz, r.i) for r in peaks] == [(1, 0, 101, 10), (1, 1, 200, 20), (3, 0, 103, 10), (3, 1, 200, 60)]
    assert s.select(mzml.array_names().alias("n")).first().n == [mzml.MZ, mzml.INTENSITY]
    assert s.select(mzml.mobility().alias("m")).first().m == []
    assert rows[0].id_map == {"controllerType": 0, "controllerNumber": 1, "scan": 1}


def test_chromatograms(spark, files):
    c = mzml.chromatograms(spark, str(files / "a.mzML"))
    p = spectra.chromatogram_properties(c).first()
    assert (p.id, p.type, p.precursor_mz, p.product_mz, p.polarity) == ("TIC", "total ion current chromatogram", 808.5, 689.25, None)
    assert [(r.time, r.i) for r in mzml.chromatogram_points(c).orderBy("pos").collect()] == [(0.5, 3), (1.5, 4)]


@pytest.mark.parametrize("name", ["a.mzML", "b.mzML.gz", "c.mzML.gz"])
def test_heads(spark, files, name):
    r = mzml.headers(spark, str(files / name)).first()
    assert (r.encoding, r.mzml_version, r.obo_version, r.run_id, r.start_time, r.spectrum_count, r.instrument) == ("ISO-8859-1", "1.1.0", "3.65.0", "made-run", "2013-09-10T10:31:08Z", 5, "a fine instrument")
    assert r.software[0].id == "made" and [x.id for x in r.instruments] == ["IC1"] and r.param_groups[0].cv[0].accession == "MS:1" and r.file_content[0].name == "MS1 spectrum"
    assert [(x.id, list(x.steps)) for x in r.data_processing] == [("dp", ["peak picking"])] and r.samples[0].name == "yeast" and r.source_files[0].location == "here"


def test_elements_as_text(spark, files):
    e = mzml.raw_elements(spark, str(files / "a.mzML"))
    assert e.count() == 3 and e.first().element.startswith("<spectrum ") and e.first().element.endswith("</spectrum>")
    assert mzml.spectra_from_xml(e).select("native_id").orderBy("native_id").collect() == [(1,), (2,), (3,)]
    got = e.select(spectra.element_by_name("element", "ms level").alias("a"), spectra.element_by_name("element", "MS:1000285").alias("b"), spectra.element_by_name("element", "no such").alias("c"), F.size(spectra.elements_by_path("element", "spectrum/binaryDataArrayList/binaryDataArray")).alias("n")).collect()
    assert sorted(tuple(x) for x in got) == [("1", "9.5e07", None, 2), ("1", "9.5e07", None, 2), ("2", "9.5e07", None, 2)]
    assert mzml.raw_elements(spark, str(files / "a.mzML"), "chromatogram").count() == 1


def test_sqlite_store(spark, files, tmp_path):
    e = mzml.raw_elements(spark, str(files / "a.mzML")).select(spectra.native_id(F.regexp_extract("element", r'\bid="([^"]*)"', 1)).alias("id"), "element")
    path = str(tmp_path / "store.db")
    assert sqlite.write(e, path) == 3
    back = sqlite.read(spark, path)
    assert back.rdd.getNumPartitions() == 1 and [x.id for x in back.orderBy("id").collect()] == [1, 2, 3]
    assert sorted(mzml.peaks(mzml.spectra_from_xml(back)).collect()) == sorted(mzml.peaks(mzml.spectra(spark, str(files / "a.mzML"))).collect())
    empty = str(tmp_path / "none.db")
    assert sqlite.write(e.limit(0), empty) == 0 and sqlite.read(spark, empty).count() == 0


def test_pages(spark):
    points = spark.createDataFrame([(1, 100.0, 5.0, "a<b"), (1, 200.0, 10.0, "c"), (2, 7.0, 1.0, None)], "plot long, x double, y double, text string")
    drawn = traces.trace(points.withColumn("at", F.col("x")), "sticks", ["plot", "at"])
    html = {r.plot: r.html for r in traces.to_html(drawn, ["plot"], ["at", "pos"]).collect()}
    assert 'd="M0.00 400.00L0.00 200.00L0.00 400.00M900.00 400.00L900.00 0.00L900.00 400.00"' in html[1] and "a&lt;b\nc" in html[1]
    assert 'd="M450.00 400.00L450.00 0.00L450.00 400.00"' in html[2]


@pytest.mark.parametrize("suffix", ["mzML", "mzML.gz"])
def test_writing(spark, tmp_path, suffix):
    rows = [(k, [100.0 + k, 200.0], [1.0, float(k)]) for k in range(7)] + [(7, [], [])]
    df = spark.createDataFrame(rows, "n long, mz array<double>, i array<double>").repartition(3)
    folder = mzml.write(mzml.spectrum_elements(df, "n", ["MS:1000523", codec.ZLIB], 2), str(tmp_path), suffix, run="r<1>".strip("<>1"))
    assert mzml.headers(spark, folder).agg(F.sum("spectrum_count")).first()[0] == 8
    s = mzml.spectra(spark, folder)
    assert s.where("ms_level = 2").count() == 8
    assert sorted((x.native_id, x.mz, x.i) for x in mzml.peaks(s).collect()) == sorted((n, m, i) for n, a, b in rows for m, i in zip(a, b))


def test_headers_and_indexes(spark, files):
    r = mzml.runs(spark, str(files / "a.mzML")).first()
    assert (r.encoding, r.mzml_version, r.obo_version, r.run_id, r.start_time, r.spectrum_count, r.chromatogram_count) == ("ISO-8859-1", "1.1.0", "3.65.0", "made-run", "2013-09-10T10:31:08Z", 5, 1)
    assert [(x.id, x.version) for x in r.software] == [("made", "2")]
    found = mzml.spectra(spark, str(files / "a.mzML"))
    v = spectra.validate_count(mzml.runs(spark, str(files / "a.mzML")), found).first()
    assert (v.declared, v.found, v.complete) == (5, 3, False)
    index = mzml.scan_index(spark, str(files / "a.mzML")).orderBy("offset").collect()
    assert [(x.native_id, x.offset) for x in index] == [(1, 42), (2, 99)]
    own = mzml.scan_index(spark, str(files / "a.mzML"), r'offset idRef="(?<ID>[^"]*scan=1)">(?<offset>\d+)').collect()
    assert [(x.native_id, x.offset) for x in own] == [(1, 42)]
    raw = DOCUMENT.encode("latin-1")
    for x in mzml.scan_index_from_scratch(spark, str(files / "a.mzML")).collect():
        assert raw[x.offset :].startswith(f"<{x.kind} ".encode()) and x.id_raw.encode() in raw[x.offset : x.offset + 100]
    assert mzml.scan_index_from_scratch(spark, str(files / "a.mzML")).count() == 4


def test_formats(files):
    assert [mzml.file_format(str(files / n)) for n in ("a.mzML", "b.mzML.gz", "c.mzML.gz")] == ["plain", "gzip", "igzip"]


def test_bytes(spark):
    assert mzml.spectra_from_bytes(spark, DOCUMENT.encode("latin-1")).count() == 3
    e = mzml.elements(spark.createDataFrame([(DOCUMENT,)], "xml string"), tag="chromatogram")
    assert mzml.chromatograms_from_xml(e).first().id == "TIC"


def test_store_and_lookup(spark, files, tmp_path):
    s = mzml.spectra(spark, str(files / "a.mzML"))
    mzml.save(s, str(tmp_path / "s"))
    t = spark.read.parquet(str(tmp_path / "s"))
    assert spectra.by_id(t, 2).first().ms_level == 2
    assert tuple(spectra.bounds(t).first()) == (1, 3)
    assert spectra.search_id(t, "scan=3").first().native_id == 3
    assert spectra.by_ordinal(t, 1).first().native_id == 2
    with pytest.raises(ValueError):
        spectra.by_ordinal(t, "x")
    up = spectra.with_parent(t.select("native_id", "scan_time", "tic", t.precursors[0].precursor_id.alias("precursor_id")).where("native_id < 3"))
    assert up.where("native_id = 2").first().parent_time == 1.5


def test_igzip(spark, files, tmp_path):
    path = str(tmp_path / "x.gz")
    with igzip.IgzipWriter(path, most=3) as out:
        assert out.add("A" * 8 + "b" * 8, 1) and out.add("second", "two") and out.add("third", 3)
        assert not out.add("fourth", 4)
        out.write_index()
        with pytest.raises(ValueError, match="index"):
            out.add("late", 5)
    assert gzip.open(path).read() == b"A" * 8 + b"b" * 8 + b"secondthird"
    index = igzip.read_index(path)
    assert list(index) == ["1", "two", "3"] and igzip.read_block(path, index["two"]) == b"second"
    assert [r.text for r in igzip.read_igzip(spark, path, ["3"]).collect()] == ["third"]
    assert gzip.open(files / "c.mzML.gz").read() == DOCUMENT.encode("latin-1")
    blocks = igzip.read_igzip(spark, str(files / "c.mzML.gz"))
    assert {"1", "2", "3", "TIC", "Head", "tail"} <= {r.id for r in blocks.collect()}
    assert mzml.spectra_from_xml(blocks.where("id = '2'").selectExpr("text AS element")).first().native_id == 2
    done = igzip.convert_folder(spark, [str(files / "a.mzML")], str(tmp_path)).collect()
    assert done[0].blocks > 5 and gzip.open(done[0].target).read() == DOCUMENT.encode("latin-1")
    with pytest.raises(ValueError, match="no index"):
        igzip.read_index(str(files / "b.mzML.gz"))


def test_stream(spark, files, tmp_path):
    from specframe.streaming import dropfolder

    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.mzML").write_text(DOCUMENT)
    q = dropfolder.spectra(spark, str(drop)).select("native_id").writeStream.format("memory").queryName("dropped").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.native_id for r in spark.table("dropped").collect()) == [1, 2, 3]


OBO = """format-version: 1.2
[Term]
id: MS:1
name: root
def: "the top" [x]

[Term]
id: MS:2
name: middle
is_a: MS:1 ! root

[Term]
id: MS:3
name: leaf
is_a: MS:2 ! middle
is_a: MS:9 ! other

[Typedef]
id: part_of
"""


def test_ontology(spark, tmp_path):
    (tmp_path / "v.obo.gz").write_bytes(gzip.compress(OBO.encode()))
    t = ontology.read_obo(spark, str(tmp_path / "v.obo.gz"))
    assert t.count() == 3
    assert ontology.lookup(t, "leaf").first().id == "MS:3" and ontology.lookup(t, "none").count() == 0
    assert ontology.is_a(t, "MS:3", "MS:2").first()[0] and not ontology.is_a(t, "MS:3", "MS:1").first()[0] and not ontology.is_a(t, "MS:8", "MS:1").first()[0]
    assert sorted((r.id, r.ancestor, r.distance) for r in ontology.ancestors(t).collect()) == [("MS:2", "MS:1", 1), ("MS:3", "MS:1", 2), ("MS:3", "MS:2", 1), ("MS:3", "MS:9", 1)]
    assert sorted((r.field, r.id) for r in ontology.search(t, "TOP").collect()) == [("def", "MS:1")]
    assert ontology.check(t, "MS:1", "root").first()[0] and not ontology.check(t, "MS:1", "x").first()[0]
    assert dict(tuple(r) for r in ontology.mapping(t, True).collect())["leaf"] == "MS:3"
    assert ontology.add(t, [("MS:4", "new", None, [], {})]).count() == 4
    assert ontology.normalise_version("3.1") == "3.1.0"
    have = {"3.65.0", "1.1.0", "4.1.79"}
    assert [ontology.resolve_version(v, have, {2017: "3.65.0"}) for v in (None, "3.65.0", "23:06:2017", "9.9.9", "junk")] == ["4.1.79", "3.65.0", "3.65.0", "1.1.0", "1.1.0"]


def test_params(spark):
    kind = "array<struct<accession: string, name: string, value: string, unit: string>>"
    df = spark.createDataFrame([([("a", "x", "1.5", None), ("b", "y", "", None), ("a", "x", "word", None)],), (None,)], f"cv {kind}")
    rows = df.select(spectra.all_params("cv", "a").alias("a"), spectra.has_param("cv", "b").alias("b"), spectra.param("cv", "z", "-").alias("z"), spectra.params_map("cv").alias("m")).collect()
    assert [(x.num, x.str) for x in rows[0].a] == [(1.5, "1.5"), (None, "word")] and rows[0].b and rows[0].z == "-" and rows[0].m == {"a": "1.5", "b": ""}
    assert rows[1].a is None and rows[1].z == "-"


def test_minutes(spark):
    df = spark.createDataFrame([(60000.0, "millisecond"), (60.0, "Second"), (1.0, "minute"), (1.0, "hour"), (1.0, None)], "t double, u string")
    assert [r[0] for r in df.select(spectra.minutes("t", "u")).collect()] == [1, 1, 1, 60, None]
    with pytest.raises(Exception, match="no such unit"):
        spark.createDataFrame([(1.0, "fortnight")], "t double, u string").select(spectra.minutes("t", "u")).collect()


def test_traces(spark):
    p = spark.createDataFrame([(1, 10.0, 5.0, "a"), (1, 20.0, 6.0, "b")], "plot int, x double, y double, text string")
    got = traces.trace(p, "label.sticks", ["plot"]).collect()
    assert len(got) == 8 and sum(r.x is None for r in got) == 2 and {r.y for r in got if r.pos == 1} == {5, 6}
    assert {r.x for r in traces.trace(p.where("x = 10"), "triangle", ["plot"]).collect()} == {9.9, 10.0, 10.1, None}
    assert {round(r.x, 3) for r in traces.triangles(p.where("x = 10"), ["plot"], precision=0.1).collect() if r.x} == {9, 10, 11}
    for bad in ("bars", "triangle.huge", "label.linear.medium", "sticks.big"):
        with pytest.raises(ValueError):
            traces.validate(bad)
    with pytest.raises(ValueError, match="text"):
        traces.trace(p.drop("text"), "label.sticks", ["plot"])
    assert '"x":[10.0,20.0]' in traces.to_json(traces.trace(p, "points", ["plot"]), ["plot"], ["x"]).first().json
