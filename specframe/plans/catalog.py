"""The queries of the library's own operators over the driver's tables, with SQL for each.

The tables stand for a run: line items are peaks (supplier = spectrum, price
= m/z), orders are scans, events are chromatogram points, nations and regions
a vocabulary.  Intensities are rounded once, at the source, since sums of
doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specframe.functions import numeric, series
from specframe.operators import deconvolute, match, ontology, similarity, spectra, traces
from specframe.operators import peaks as pk
from specframe.session import importable, work_folder
from specframe.sources import codec, igzip, mzml, sqlite

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
P = 20e-6
TARGETS = tuple(round(52.5 + 4.73 * k, 2) for k in range(200))

SQL_PEAKS = "peaks AS (SELECT l_suppkey AS spec_id, l_extendedprice / 100.0::DOUBLE AS mz, round(sum(l_quantity * (1 - l_discount) * (1 + l_tax)), 6) AS i FROM lineitem GROUP BY 1, 2)"
SQL_TARGETS = "targets AS (SELECT * FROM (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in TARGETS) + ") AS t(target))"
SQL_BINS = "binned AS (SELECT *, round_even((mz - mz * 2e-5::DOUBLE) * 2500, 0)::BIGINT AS low, round_even((mz + mz * 2e-5::DOUBLE) * 2500, 0)::BIGINT AS high FROM peaks)"
SQL_MATCH = f"WITH {SQL_PEAKS}, {SQL_TARGETS}, {SQL_BINS}, hit AS (SELECT * FROM binned JOIN targets ON round_even(target * 2500, 0)::BIGINT BETWEEN low AND high)"


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# -- bindings ----------------------------------------------------------------------------------------------------------


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _peaks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("l_quantity") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    raw = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("spec_id"), (F.col("l_extendedprice") / 100.0).alias("mz"), i.alias("i"))
    return pk.distinct_mz(raw).withColumn("i", F.round("i", 6))


def _scans(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("spec_id"), F.col("o_orderkey").alias("native_id"), (1 + F.col("o_orderkey") % 2).cast("int").alias("ms_level"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("scan_time"), F.col("o_totalprice").alias("tic")
    )


def _targets(spark: SparkSession, values: tuple[float, ...] = TARGETS) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({v}D)" for v in values) + " AS t(target)")


def _points(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select(F.col("event_type").alias("id"), F.col("ts").alias("time"), F.col("value").alias("i"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    of = F.concat(F.lit("RG:"), F.col("n_regionkey"), F.lit(" ! region"))
    nation = _t(spark, d, "nation").select(F.concat(F.lit("NA:"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("nation of region "), "n_regionkey").alias("def"), F.array(of).alias("is_a"), F.create_map().cast("map<string,string>").alias("other"))
    region = _t(spark, d, "region").select(F.concat(F.lit("RG:"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), none.alias("def"), F.array().cast("array<string>").alias("is_a"), F.create_map().cast("map<string,string>").alias("other"))
    return nation.unionByName(region)


SQL_TERMS = """terms AS (SELECT 'NA:' || n_nationkey AS id, n_name AS name, 'nation of region ' || n_regionkey AS def, 'RG:' || n_regionkey AS parent FROM nation
    UNION ALL SELECT 'RG:' || r_regionkey, r_name, NULL, NULL FROM region)"""


def _raw_id():
    return F.concat(F.lit("controllerType=0 controllerNumber=1 scan="), F.col("conv_id"))



# -- matching ------------------------------------------------------------------------------------------------------------


@query("xic", SQL_MATCH + " SELECT spec_id, strftime(o_orderdate, '%Y-%m-%d') AS scan_time, target, mz, i FROM hit JOIN orders ON o_orderkey = spec_id WHERE 1 + o_orderkey % 2 = 1")
def xic(spark, d):
    return match.extracted_ion_chromatogram(_scans(spark, d), _peaks(spark, d), _targets(spark), P)


@query("has_peak", SQL_MATCH + " SELECT spec_id, target, count(*) AS n_peaks FROM hit GROUP BY 1, 2")
def has_peak(spark, d):
    return match.has_peak(_peaks(spark, d), _targets(spark), P)


@query(
    "has_peak_many",
    f"WITH {SQL_PEAKS}, {SQL_BINS}, t AS (SELECT DISTINCT p_retailprice / 2 AS target FROM part) SELECT spec_id, count(*) AS n_matches FROM binned JOIN t ON round_even(target * 2500, 0)::BIGINT BETWEEN low AND high GROUP BY 1",
)
def has_peak_many(spark, d):
    """As many targets as there are parts."""
    t = _t(spark, d, "part").select((F.col("p_retailprice") / 2).alias("target")).distinct()
    return match.match(_peaks(spark, d), t, P).groupBy("spec_id").agg(F.count("*").alias("n_matches"))


@query(
    "overlapping_peak",
    f"WITH {SQL_PEAKS}, {SQL_TARGETS}, {SQL_BINS} SELECT spec_id, target, count(*) > 1 AS overlaps FROM binned JOIN targets ON round_even((target + target * 2e-5::DOUBLE) * 2500, 0)::BIGINT BETWEEN low AND high GROUP BY 1, 2",
)
def overlapping_peak(spark, d):
    return match.has_overlapping_peak(_peaks(spark, d), _targets(spark), P)


@query(
    "t_mz_set_size",
    f"WITH {SQL_PEAKS}, {SQL_BINS} SELECT spec_id, count(DISTINCT b) AS n_bins FROM (SELECT spec_id, unnest(range(low, high + 1)) AS b FROM binned) GROUP BY 1",
)
def t_mz_set_size(spark, d):
    return match.bin_set_size(_peaks(spark, d), P)


@query("t_mz_set", f"WITH {SQL_PEAKS}, {SQL_BINS}, b AS (SELECT DISTINCT spec_id, unnest(range(low, high + 1)) AS bin FROM binned) SELECT spec_id, count(*) AS n, min(bin) AS first_bin, max(bin) AS last_bin, sum(bin)::BIGINT AS bins FROM b GROUP BY 1")
def t_mz_set(spark, d):
    bins = match.bin_set(_peaks(spark, d), P)
    return bins.groupBy("spec_id").agg(F.count("*").alias("n"), F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.sum("bin").alias("bins"))


@query("t_mz_semi", SQL_MATCH + " SELECT DISTINCT spec_id, mz, i FROM hit")
def t_mz_semi(spark, d):
    return match.spectra_with(_peaks(spark, d), _targets(spark), P)


@query(
    "remove_precursor_peak",
    f"WITH {SQL_PEAKS}, {SQL_BINS}, pre AS (SELECT spec_id, max(mz) AS target FROM peaks GROUP BY 1) SELECT spec_id, mz, i FROM binned b WHERE NOT EXISTS (SELECT 1 FROM pre WHERE pre.spec_id = b.spec_id AND round_even(target * 2500, 0)::BIGINT BETWEEN low AND high)",
)
def remove_precursor_peak(spark, d):
    peaks = _peaks(spark, d)
    return match.remove_precursor_peaks(peaks, peaks.groupBy("spec_id").agg(F.max("mz").alias("target")), P)


@query(
    "fragment_annotation",
    f"WITH {SQL_PEAKS}, {SQL_BINS}, ions AS (SELECT 'b' || k AS ion, (100 + 37 * k)::DOUBLE AS target FROM range(1, 19) r(k)) SELECT spec_id, ion, target, min(mz) AS mz, arg_min(i, mz) AS i FROM binned JOIN ions ON round_even(target * 2500, 0)::BIGINT BETWEEN low AND high GROUP BY 1, 2, 3",
)
def fragment_annotation(spark, d):
    ions = spark.range(1, 19).select(F.concat(F.lit("b"), "id").alias("ion"), (100 + 37 * F.col("id")).cast("double").alias("target"))
    return match.annotate(_peaks(spark, d), ions, P)


# -- aggregates and filters ----------------------------------------------------------------------------------------------


@query("tic_by_scan", f"WITH {SQL_PEAKS} SELECT spec_id, round(sum(i), 7) AS tic FROM peaks GROUP BY 1")
def tic_by_scan(spark, d):
    return pk.total_intensity(_peaks(spark, d)).withColumn("tic", F.round("tic", 7))


@query("peak_count", f"WITH {SQL_PEAKS} SELECT spec_id, count(*) AS n_peaks FROM peaks GROUP BY 1")
def peak_count(spark, d):
    return pk.peak_count(_peaks(spark, d))


for _mode, _sql in (("median", "median(i)"), ("mean", "avg(i)"), ("mad", "mad(i)")):

    @query(f"noise_{_mode}", f"WITH {SQL_PEAKS} SELECT spec_id, round({_sql}, 5) AS noise FROM peaks GROUP BY 1")
    def noise(spark, d, mode=_mode):
        return pk.noise_level_of(_peaks(spark, d), mode).withColumn("noise", F.round("noise", 5))

    @query(f"remove_noise_{_mode}", f"WITH {SQL_PEAKS}, n AS (SELECT spec_id, {_sql} AS noise FROM peaks GROUP BY 1) SELECT spec_id, mz, i FROM peaks JOIN n USING (spec_id) WHERE i / nullif(noise, 0) >= 1.537")
    def remove_noise(spark, d, mode=_mode):
        return pk.remove_noise(_peaks(spark, d), mode, signal_to_noise=1.537)


@query("remove_noise_fixed", f"WITH {SQL_PEAKS} SELECT spec_id, mz, i FROM peaks WHERE i / 10.123 >= 2.0")
def remove_noise_fixed(spark, d):
    return pk.remove_noise(_peaks(spark, d), noise_level=10.123, signal_to_noise=2.0)


@query("reduce_mz_range", f"WITH {SQL_PEAKS} SELECT spec_id, mz, i FROM peaks WHERE mz BETWEEN 100 AND 400")
def reduce_mz_range(spark, d):
    return pk.reduce_range(_peaks(spark, d), (100, 400))


@query("highest_peaks", f"WITH {SQL_PEAKS}, r AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY i DESC, mz DESC)::INT AS rank FROM peaks) SELECT spec_id, mz, i, rank FROM r WHERE rank <= 3")
def highest_peaks(spark, d):
    return pk.highest_peaks(_peaks(spark, d), 3)


@query("extreme_values", f"WITH {SQL_PEAKS} SELECT spec_id, min(mz) AS min_mz, max(mz) AS max_mz, min(i) AS min_i, max(i) AS max_i FROM peaks GROUP BY 1")
def extreme_values(spark, d):
    return pk.extreme_values(_peaks(spark, d), "mz", "i")


@query("transformed_peaks", f"WITH {SQL_PEAKS} SELECT spec_id, round_even(mz * 2500, 0)::BIGINT AS bin, i FROM peaks")
def transformed_peaks(spark, d):
    return _peaks(spark, d).select("spec_id", numeric.mz_bin("mz", P).alias("bin"), "i")


@query("ppm_and_mass", f"WITH {SQL_PEAKS} SELECT spec_id, mz, mz + mz * 5e-6::DOUBLE AS up, mz - mz * 5e-6::DOUBLE AS down, (mz - 1.00727646677::DOUBLE) * 2 AS mass FROM peaks")
def ppm_and_mass(spark, d):
    return _peaks(spark, d).select("spec_id", "mz", numeric.ppm_shift("mz", 5e-6).alias("up"), numeric.ppm_shift("mz", 5e-6, -1).alias("down"), numeric.neutral_mass("mz", 2).alias("mass"))


# -- similarity -----------------------------------------------------------------------------------------------------------


@query(
    "cosine_similarity",
    f"""WITH {SQL_PEAKS}, b AS (SELECT spec_id, round_even(mz, 0) AS bin, sum(i) AS i FROM peaks GROUP BY 1, 2), n AS (SELECT spec_id, sqrt(sum(i * i)) AS norm FROM b GROUP BY 1)
    SELECT x.spec_id AS left_id, y.spec_id AS right_id, round(sum(x.i * y.i) / any_value(nx.norm * ny.norm), 6) AS cosine FROM b x JOIN b y USING (bin) JOIN n nx ON nx.spec_id = x.spec_id JOIN n ny ON ny.spec_id = y.spec_id GROUP BY 1, 2""",
)
def cosine_similarity(spark, d):
    return similarity.pairwise_cosine(_peaks(spark, d)).withColumn("cosine", F.round("cosine", 6))


@query(
    "cosine_between",
    f"""WITH {SQL_PEAKS}, b AS (SELECT spec_id, round_even(mz, 1) AS bin, sum(i) AS i FROM peaks GROUP BY 1, 2), n AS (SELECT spec_id, sqrt(sum(i * i)) AS norm FROM b GROUP BY 1)
    SELECT x.spec_id AS left_id, y.spec_id AS right_id, round(sum(x.i * y.i) / any_value(nx.norm * ny.norm), 6) AS cosine FROM b x JOIN b y USING (bin) JOIN n nx ON nx.spec_id = x.spec_id JOIN n ny ON ny.spec_id = y.spec_id WHERE x.spec_id % 2 = 1 AND y.spec_id % 2 = 0 GROUP BY 1, 2""",
)
def cosine_between(spark, d):
    """Two sets of spectra, by tenths of m/z."""
    p = _peaks(spark, d)
    return similarity.cosine(p.where("spec_id % 2 = 1"), p.where("spec_id % 2 = 0"), 1).withColumn("cosine", F.round("cosine", 6))


@query(
    "embedding_cosine_topk",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT vec_id AS query, v AS q FROM v WHERE vec_id % 20 = 0),
    s AS (SELECT vec_id, query, round(list_sum(list_transform(list_zip(v, q), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))), 6) AS cosine FROM v, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS k FROM s) SELECT vec_id, query, cosine FROM r WHERE k <= 5""",
)
def embedding_cosine_topk(spark, d):
    v = _t(spark, d, "embeddings")
    return similarity.top_cosines(v, v.where("vec_id % 20 = 0"), 5)


# -- arithmetic -----------------------------------------------------------------------------------------------------------


@query("scale_mul", f"WITH {SQL_PEAKS} SELECT spec_id, mz, i * 2.5::DOUBLE AS i FROM peaks")
def scale_mul(spark, d):
    return pk.scale(_peaks(spark, d), 2.5)


@query("scale_div", f"WITH {SQL_PEAKS} SELECT spec_id, mz, i / 4 AS i FROM peaks")
def scale_div(spark, d):
    return pk.divide(_peaks(spark, d), 4.0)


SQL_GRID = """{name} AS (SELECT {key} AS key, k, k / 625.0::DOUBLE AS mz, sum(i * exp(-((mz - k / 625.0::DOUBLE) * (mz - k / 625.0::DOUBLE)) / (2 * s * s))) AS i FROM
    (SELECT spec_id, mz, i, s, unnest(range(low, high + 1)) AS k FROM (SELECT spec_id, mz, i, mz * 4e-5::DOUBLE AS s, round_even((mz - 5 * (mz * 4e-5::DOUBLE)) * 625, 0)::BIGINT AS low, round_even((mz + 5 * (mz * 4e-5::DOUBLE)) * 625, 0)::BIGINT AS high FROM peaks WHERE {which})) WHERE k % 5 = 0 GROUP BY 1, 2, 3)"""
SQL_ODD, SQL_EVEN = (SQL_GRID.format(name=n, key="(spec_id + 1) // 2", which=f"spec_id % 2 = {r}") for n, r in (("g", 1), ("h", 0)))


@query("reprofile_grid", f"WITH {SQL_PEAKS}, {SQL_GRID.format(name='g', key='spec_id', which='true')} SELECT key AS spec_id, k, round(mz, 6) AS mz, round(i, 6) AS i FROM g")
def reprofile_grid(spark, d):
    return pk.reprofile(_peaks(spark, d), P).select("spec_id", "k", F.round("mz", 6).alias("mz"), F.round("i", 6).alias("i"))


@query(
    "average_spectra",
    f"WITH {SQL_PEAKS.replace('peaks AS', 'raw AS')}, peaks AS (SELECT spec_id, mz, i / sum(i) OVER (PARTITION BY spec_id) AS i FROM raw), {SQL_GRID.format(name='g', key='0', which='true')} SELECT k, round(mz, 6) AS mz, round(i, 8) AS i FROM g",
)
def average_spectra(spark, d):
    return pk.average(_peaks(spark, d), P).select("k", F.round("mz", 6).alias("mz"), F.round("i", 8).alias("i"))


for _name, _sign in (("spectrum_add", 1), ("spectrum_sub", -1)):

    @query(
        _name,
        f"WITH {SQL_PEAKS}, {SQL_ODD}, {SQL_EVEN}, u AS (SELECT * FROM g UNION ALL SELECT key, k, mz, {_sign} * i FROM h) SELECT key AS pair, count(DISTINCT k) AS n, sum(DISTINCT k)::BIGINT AS grid, round(sum(i), 3) + 0.0::DOUBLE AS total FROM u GROUP BY 1",
    )
    def spectrum_combine(spark, d, sign=_sign):
        """Each odd spectrum with the even one after it."""
        p = _peaks(spark, d).withColumn("pair", F.floor((F.col("spec_id") + 1) / 2))
        out = pk.combine(p.where("spec_id % 2 = 1"), p.where("spec_id % 2 = 0"), P, sign, ("pair",))
        return out.groupBy("pair").agg(F.count("*").alias("n"), F.sum("k").alias("grid"), (F.round(F.sum("i"), 3) + 0.0).alias("total"))


@query(
    "centroid_gauss",
    f"""WITH {SQL_PEAKS}, w AS (SELECT spec_id, lag(mz) OVER q AS x1, mz AS x2, lead(mz) OVER q AS x3, lag(i) OVER q AS y1, i AS y2, lead(i) OVER q AS y30, row_number() OVER q - 1 AS pos FROM peaks WINDOW q AS (PARTITION BY spec_id ORDER BY mz)),
    t AS (SELECT *, CASE WHEN y30 = y1 THEN y30 + 0.01 * y1 ELSE y30 END AS y3 FROM w WHERE pos >= 2 AND x3 IS NOT NULL AND y1 > 0 AND y30 > 0 AND y2 > y1 AND y2 > y30 AND x2 - x1 <= (x3 - x2) * 10 AND x3 - x2 <= (x2 - x1) * 10),
    r AS (SELECT *, ln(y2 / y1) / nullif(ln(y3 / y1), 0) AS r FROM t), m AS (SELECT *, (r * (x1 * x1 - x3 * x3) - x1 * x1 + x2 * x2) / nullif(2 * (x2 - x1) - 2 * r * (x3 - x1), 0) AS mu FROM r),
    c AS (SELECT *, (x2 * x2 - x1 * x1 - 2 * x2 * mu + 2 * x1 * mu) / nullif(2 * ln(y1 / y2), 0) AS c2 FROM m)
    SELECT spec_id, count(*) AS n, round(sum(mu), 2) AS sum_mz, round(max(y1 * exp((x1 - mu) * (x1 - mu) / nullif(2 * c2, 0))), 1) AS max_i FROM c WHERE mu IS NOT NULL AND c2 <> 0 GROUP BY 1""",
)
def centroid_gauss(spark, d):
    """Apexes of the raw peaks taken as profiles, summed by spectrum."""
    return pk.centroid(_peaks(spark, d)).groupBy("spec_id").agg(F.count("*").alias("n"), F.round(F.sum("mz"), 2).alias("sum_mz"), F.round(F.max("i"), 1).alias("max_i"))


@query("deconvolute")
def deconvolute_peaks(spark, d):
    return deconvolute.deconvolute(_peaks(spark, d), P)


# -- spectra ---------------------------------------------------------------------------------------------------------------


@query("ms_level_filter", "SELECT o_orderkey AS native_id, (1 + o_orderkey % 2)::INT AS ms_level, o_totalprice AS tic FROM orders WHERE 1 + o_orderkey % 2 = 2")
def ms_level_filter(spark, d):
    return spectra.of_level(_scans(spark, d), 2).select("native_id", "ms_level", "tic")


@query("precursor_top10", "SELECT round_even(o_totalprice / 1000, 0) AS mz, count(*) AS n_scans, array_to_string(list_sort(list(o_orderkey)), ',') AS scans FROM orders GROUP BY 1 ORDER BY n_scans DESC, mz DESC LIMIT 10")
def precursor_top10(spark, d):
    p = _t(spark, d, "orders").select(F.col("o_orderkey").alias("native_id"), (F.col("o_totalprice") / 1000).alias("mz"))
    return spectra.top_precursors(p, 10, 0).withColumn("scans", F.array_join(F.col("scans").cast("array<string>"), ","))


@query(
    "precursor_parent",
    "SELECT a.o_orderkey AS native_id, a.o_orderkey // 2 AS precursor_id, strftime(b.o_orderdate, '%Y-%m-%d') AS parent_time, b.o_totalprice AS parent_tic FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey // 2 WHERE a.o_orderkey % 2 = 1",
)
def precursor_parent(spark, d):
    s = _scans(spark, d).withColumn("precursor_id", F.floor(F.col("native_id") / 2))
    return spectra.with_parent(s).where("ms_level = 2").select("native_id", "precursor_id", "parent_time", "parent_tic")


@query(
    "scan_time_minutes",
    "SELECT o_orderkey AS native_id, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice / 1000 / 60 WHEN 1 THEN o_totalprice / 60 WHEN 2 THEN o_totalprice ELSE o_totalprice * 60 END AS minutes FROM orders",
)
def scan_time_minutes(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ("millisecond", "second", "minute", "hour"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("native_id"), spectra.minutes(F.col("o_totalprice"), unit).alias("minutes"))


@query("native_id_parse", """SELECT conv_id, turn, TRY_CAST(regexp_extract('controllerType=0 controllerNumber=1 scan=' || conv_id, '="?([0-9]+)"?>?$', 1) AS BIGINT) AS native_id FROM conversations""")
def native_id_parse(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", spectra.native_id(_raw_id()).alias("native_id"))


@query("id_map", "SELECT conv_id, turn, 0::BIGINT AS controller_type, 1::BIGINT AS controller_number, conv_id AS scan, 3::INT AS n FROM conversations")
def id_map(spark, d):
    m = spectra.id_map(_raw_id())
    return _t(spark, d, "conversations").select("conv_id", "turn", m["controllerType"].alias("controller_type"), m["controllerNumber"].alias("controller_number"), m["scan"].alias("scan"), F.size(m).alias("n"))


@query("point_lookup", "SELECT o_orderkey AS native_id, (1 + o_orderkey % 2)::INT AS ms_level, o_totalprice AS tic FROM orders WHERE o_orderkey = 6")
def point_lookup(spark, d):
    return spectra.by_id(_scans(spark, d), 6).select("native_id", "ms_level", "tic")


@query("lookup_bounds", "SELECT min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM orders")
def lookup_bounds(spark, d):
    return spectra.bounds(_scans(spark, d))


@query("string_id_search", "SELECT p_partkey AS idx, p_name AS id_raw FROM part WHERE contains(p_name, 'cold') ORDER BY p_partkey LIMIT 1")
def string_id_search(spark, d):
    return spectra.search_id(_t(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("id_raw")), "cold")


@query("search_any", "SELECT 'chromatogram' AS kind, event_type AS id FROM events WHERE contains(event_type, 'lic') GROUP BY 2 ORDER BY min(event_id) LIMIT 1")
def search_any(spark, d):
    """Text that no spectrum's id holds, so a chromatogram is found."""
    s = _t(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("id_raw"))
    c = _t(spark, d, "events").groupBy(F.col("event_type").alias("id")).agg(F.min("event_id").alias("idx"))
    return spectra.search_any(s, c, "lic")


@query("precursor_rows", "SELECT l_orderkey AS native_id, l_extendedprice / 100 AS mz, l_quantity AS i, l_linenumber AS charge, l_suppkey AS precursor_id FROM lineitem")
def precursor_rows(spark, d):
    """Line items as the selected ions of their order."""
    ion = F.struct((F.col("l_extendedprice") / 100).alias("mz"), F.col("l_quantity").alias("i"), F.col("l_linenumber").alias("charge"), F.col("l_suppkey").alias("precursor_id"))
    s = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("native_id")).agg(F.collect_list(ion).alias("precursors"))
    return spectra.precursor_rows(s)


def _cv(*rows):
    """A parameter list of (accession, name, value)."""
    return F.array(*[F.struct(F.lit(a).alias("accession"), F.lit(n).alias("name"), v.alias("value"), F.lit(None).cast("string").alias("unit")) for a, n, v in rows])


@query("param_by_name", "SELECT o_orderkey AS native_id, o_orderpriority AS value FROM orders")
def param_by_name(spark, d):
    """A parameter whose accession is looked up by the term's name."""
    s = _t(spark, d, "orders").select(F.col("o_orderkey").alias("native_id"), _cv(("NA:3", "x", F.col("o_orderstatus")), ("NA:7", "y", F.col("o_orderpriority"))).alias("cv"))
    terms = _terms(spark, d)
    return spectra.param_by_name(s, terms, terms.where("id = 'NA:7'").first()["name"]).select("native_id", "value")


@query("params_all", "SELECT o_orderkey AS native_id, true AS present, o_totalprice AS num, o_orderpriority AS str, 3::INT AS n FROM orders")
def params_all(spark, d):
    """Every value of an accession: a number, a flag and a text."""
    s = _t(spark, d, "orders").select(F.col("o_orderkey").alias("native_id"), _cv(("A", "a", F.col("o_totalprice").cast("string")), ("A", "a", F.lit("")), ("B", "b", F.lit("7")), ("A", "a", F.col("o_orderpriority"))).alias("cv"))
    own = s.withColumn("all", spectra.all_params("cv", "A"))
    at = lambda k: F.get(F.col("all"), F.lit(k))
    return own.select("native_id", (at(1)["present"] & at(1)["num"].isNull() & at(1)["str"].isNull()).alias("present"), at(0)["num"].alias("num"), at(2)["str"].alias("str"), F.size("all").alias("n"))


@query("first_scans", "SELECT o_orderkey AS native_id, o_totalprice AS tic FROM orders ORDER BY o_orderkey LIMIT 5")
def first_scans(spark, d):
    return spectra.first_scans(_scans(spark, d).withColumn("idx", F.col("native_id")), 5).select("native_id", "tic")


@query("ordinal_lookup", "SELECT o_orderkey AS native_id, o_totalprice AS tic FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 4")
def ordinal_lookup(spark, d):
    return spectra.by_ordinal(_scans(spark, d).withColumn("idx", F.col("native_id")), 4).select("native_id", "tic")


@query(
    "index_block_length",
    "WITH s AS (SELECT source AS path, doc_id, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars)::BIGINT AS off, (sum(n_chars) OVER (PARTITION BY source))::BIGINT AS total FROM documents) SELECT path, doc_id, off AS \"offset\", coalesce(lead(off) OVER (PARTITION BY path ORDER BY off), total) - off AS length FROM s",
)
def index_block_length(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("source")
    at = _t(spark, d, "documents").select(F.col("source").alias("path"), "doc_id", (F.sum("n_chars").over(w.orderBy("doc_id")) - F.col("n_chars")).alias("offset"), F.sum("n_chars").over(w).alias("file_size"))
    return spectra.block_lengths(at).select("path", "doc_id", "offset", "length")


@query("index_merge", "SELECT coalesce('s' || s_suppkey, 'c' || 0) AS id_raw, s_suppkey * 10 AS \"offset\" FROM supplier UNION ALL SELECT 's' || c_custkey, c_custkey * 3 FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def index_merge(spark, d):
    first = _t(spark, d, "customer").select(F.concat(F.lit("s"), "c_custkey").alias("id_raw"), (F.col("c_custkey") * 3).alias("offset"))
    later = _t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id_raw"), (F.col("s_suppkey") * 10).alias("offset"))
    return spectra.merge_index(first, later)


@query(
    "count_validation",
    "SELECT o_orderkey AS path, 3::BIGINT AS declared, coalesce(n, 0)::BIGINT AS found, 3 <= coalesce(n, 0) AS complete FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
)
def count_validation(spark, d):
    declared = _t(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.lit(3).alias("spectrum_count"))
    return spectra.validate_count(declared, _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("path")))


@query("param_lookup", "SELECT o_orderkey AS native_id, o_totalprice AS tic, o_orderkey % 2 = 0 AS positive, '-' AS missing, (CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END)::INT AS n FROM orders")
def param_lookup(spark, d):
    """Parameters as arrays of structs: a number, a flag, a default, how many."""
    p = lambda a, n, v: F.struct(F.lit(a).alias("accession"), F.lit(n).alias("name"), v.alias("value"), F.lit(None).cast("string").alias("unit"))
    number, flag = p(spectra.TIC, "total ion current", F.col("o_totalprice").cast("string")), p(spectra.POSITIVE, "positive scan", F.lit(""))
    o = _t(spark, d, "orders").withColumn("cv", F.when(F.col("o_orderkey") % 2 == 0, F.array(number, flag)).otherwise(F.array(number)))
    return o.select(F.col("o_orderkey").alias("native_id"), spectra.param_number("cv", spectra.TIC).alias("tic"), spectra.has_param("cv", spectra.POSITIVE).alias("positive"), spectra.param("cv", "MS:0", "-").alias("missing"), F.size(spectra.params_map("cv")).alias("n"))


@query("param_groups", "SELECT c_custkey AS native_id, n_name || ',' || c_mktsegment AS names FROM customer JOIN nation ON n_nationkey = c_nationkey")
def param_groups(spark, d):
    cv = lambda c: F.array(F.struct(F.lit("MS:1").alias("accession"), F.col(c).alias("name"), F.lit("").alias("value")))
    s = _t(spark, d, "customer").select(F.col("c_custkey").alias("native_id"), F.col("c_nationkey").alias("group_ref"), cv("c_mktsegment").alias("cv"))
    g = _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), cv("n_name").alias("cv"))
    return spectra.with_param_groups(s, g).select("native_id", F.concat_ws(",", F.get(F.col("cv"), F.lit(1))["name"], F.get(F.col("cv"), F.lit(0))["name"]).alias("names"))


# -- chromatograms ----------------------------------------------------------------------------------------------------------


@query("chrom_profile", "SELECT event_type AS id, (row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1)::INT AS pos, value AS i FROM events")
def chrom_profile(spark, d):
    return spectra.profile(_points(spark, d)).select("id", "pos", "i")


@query("chrom_tic", "SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(value), 4) AS tic, count(*) AS n FROM events GROUP BY 1")
def chrom_tic(spark, d):
    return _points(spark, d).groupBy(F.date_format("time", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("i"), 4).alias("tic"), F.count("*").alias("n"))


@query("chrom_by_name", "SELECT event_id, value AS i FROM events WHERE event_type = 'click'")
def chrom_by_name(spark, d):
    return spectra.by_name(_t(spark, d, "events"), "CLICK", "event_type").select("event_id", F.col("value").alias("i"))


@query("chrom_properties", "SELECT event_type AS id, 'total ion current chromatogram' AS type, CASE WHEN min(event_id) % 2 = 0 THEN 'positive scan' ELSE 'negative scan' END AS polarity, round(min(value), 4) AS precursor_mz, round(max(value), 4) AS product_mz FROM events GROUP BY 1")
def chrom_properties(spark, d):
    e = _t(spark, d, "events").groupBy(F.col("event_type").alias("id")).agg(F.min("event_id").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    even = F.col("n") % 2 == 0
    polarity = F.struct(F.when(even, spectra.POSITIVE).otherwise(spectra.NEGATIVE).alias("accession"), F.when(even, "positive scan").otherwise("negative scan").alias("name"), F.lit("").alias("value"), F.lit(None).cast("string").alias("unit"))
    kind = _cv(("MS:1000235", "total ion current chromatogram", F.lit("")))
    c = e.select("id", F.concat(kind, F.array(polarity)).alias("cv"), _cv((spectra.ISOLATION_TARGET, "t", F.col("low").cast("string"))).alias("precursor_cv"), _cv((spectra.ISOLATION_TARGET, "t", F.col("high").cast("string"))).alias("product_cv"))
    return spectra.chromatogram_properties(c).withColumns({x: F.round(x, 4) for x in ("precursor_mz", "product_mz")})


@query("chrom_windows", "SELECT event_type AS id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def chrom_windows(spark, d):
    from specframe.streaming import dropfolder

    w = dropfolder.windowed_intensity(_t(spark, d, "events").select(F.col("event_type").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("i")))
    return w.select("id", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "n", F.round("total", 4).alias("total"))


# -- ontology -----------------------------------------------------------------------------------------------------------------


@query("cv_lookup", f"WITH {SQL_TERMS} SELECT id, name FROM terms WHERE id = 'NA:7'")
def cv_lookup(spark, d):
    return ontology.lookup(_terms(spark, d), "NA:7").select("id", "name")


@query("is_a_member", "SELECT count(*) > 0 AS is_member FROM nation WHERE n_nationkey = 7 AND n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 7) AND n_regionkey = 3")
def is_a_member(spark, d):
    return ontology.is_a(_terms(spark, d), "NA:7", "RG:3")


@query("ontology_search", f"WITH {SQL_TERMS} SELECT 'id' AS field, id FROM terms WHERE contains(lower(id), 'a') UNION ALL SELECT 'name', id FROM terms WHERE contains(lower(name), 'a') UNION ALL SELECT 'def', id FROM terms WHERE contains(lower(def), 'a')")
def ontology_search(spark, d):
    return ontology.search(_terms(spark, d), "A")


@query("ontology_mapping", f"WITH {SQL_TERMS} SELECT id AS key, name AS value FROM terms")
def ontology_mapping(spark, d):
    return ontology.mapping(_terms(spark, d))


@query("ontology_ancestors", f"WITH {SQL_TERMS} SELECT id, parent AS ancestor, 1::INT AS distance FROM terms WHERE parent IS NOT NULL")
def ontology_ancestors(spark, d):
    return ontology.ancestors(_terms(spark, d))


@query("accession_join", f"WITH {SQL_TERMS} SELECT c_custkey, name FROM customer JOIN terms ON id = 'NA:' || c_nationkey")
def accession_join(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", F.concat(F.lit("NA:"), "c_nationkey").alias("accession"))
    return ontology.with_names(rows, _terms(spark, d)).select("c_custkey", "name")


# -- traces -------------------------------------------------------------------------------------------------------------------

SQL_TOP = f"WITH {SQL_PEAKS}, top AS (SELECT spec_id AS plot, mz AS x, i AS y FROM (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY i DESC, mz DESC) AS r FROM peaks) WHERE r <= 3)"


def _top(spark, d):
    return pk.highest_peaks(_peaks(spark, d), 3).select(F.col("spec_id").alias("plot"), F.col("mz").alias("x"), F.col("i").alias("y"))


@query("stick_trace", SQL_TOP + " SELECT plot, x AS at, p::INT AS pos, CASE WHEN p < 3 THEN x END AS x, CASE p WHEN 0 THEN 0.0 WHEN 1 THEN y WHEN 2 THEN 0.0 END::DOUBLE AS y FROM top, range(4) r(p)")
def stick_trace(spark, d, points_of=_top):
    return traces.trace(points_of(spark, d).withColumn("at", F.col("x")), "sticks", ["plot", "at"]).drop("text")


@query(
    "triangle_trace",
    SQL_TOP + ", w AS (SELECT *, max(x) OVER (PARTITION BY plot) / 100 AS w FROM top) SELECT plot, x AS at, p::INT AS pos, round(CASE p WHEN 0 THEN x - w WHEN 1 THEN x WHEN 2 THEN x + w END, 6) AS x, CASE p WHEN 0 THEN 0.0 WHEN 1 THEN y WHEN 2 THEN 0.0 END::DOUBLE AS y FROM w, range(4) r(p)",
)
def triangle_trace(spark, d, points_of=_top):
    return traces.trace(points_of(spark, d).withColumn("at", F.col("x")), "triangle.medium", ["plot", "at"]).withColumn("x", F.round("x", 6)).drop("text")


@query(
    "label_trace",
    SQL_TOP + ", w AS (SELECT *, x + 1 AS x1, max(y) OVER (PARTITION BY plot) AS h FROM top) SELECT plot, x AS at, p::INT AS pos, round(CASE p WHEN 0 THEN x WHEN 1 THEN (x + x1) / 2 WHEN 2 THEN x1 END, 6) AS x, round(CASE WHEN p < 3 THEN h * -0.05 END, 6) AS y, CASE WHEN p < 3 THEN 'top' END AS text FROM w, range(4) r(p)",
)
def label_trace(spark, d, points_of=_top):
    points = points_of(spark, d).select("plot", F.col("x").alias("at"), F.col("x").alias("x0"), (F.col("x") + 1).alias("x1"), "y", F.lit("top").alias("text"))
    return traces.trace(points, "label.linear.bottom", ["plot", "at"]).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query("point_trace_range", SQL_TOP + " SELECT plot, 0::INT AS pos, x, y FROM top WHERE x BETWEEN 100 AND 800 AND y BETWEEN 10 AND 1000")
def point_trace_range(spark, d, points_of=_top):
    return traces.trace(traces.in_range(points_of(spark, d), (100, 800), (10, 1000)), "points", ["plot"]).drop("text")


@query("plot_extents", SQL_TOP + " SELECT plot, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM top GROUP BY 1")
def plot_extents(spark, d, points_of=_top):
    return traces.extents(points_of(spark, d))


@query("trace_json", SQL_TOP + " SELECT plot, json_array_length(to_json(list(x)))::INT AS n, round(sum(x), 4) AS sum_x, round(sum(y), 4) AS sum_y FROM top GROUP BY 1")
def trace_json(spark, d, points_of=_top):
    j = traces.to_json(traces.trace(points_of(spark, d), "points", ["plot"]), ["plot"], ["x"])
    read = j.select("plot", F.from_json("json", "x array<double>, y array<double>").alias("p"))
    total = lambda c: F.round(F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x), 4)
    return read.select("plot", F.size("p.x").alias("n"), total("p.x").alias("sum_x"), total("p.y").alias("sum_y"))


SQL_PLOT = f"WITH {SQL_PEAKS}, top AS (SELECT spec_id AS plot, mz AS x, i AS y FROM peaks)"


def _plot(spark, d):
    return _peaks(spark, d).select(F.col("spec_id").alias("plot"), F.col("mz").alias("x"), F.col("i").alias("y"))


# The same over all peaks of each spectrum.
for _name in ("stick_trace", "triangle_trace", "label_trace", "point_trace_range", "plot_extents", "trace_json"):
    query(f"{_name}_all", SQL[_name].replace(SQL_TOP, SQL_PLOT))(partial(QUERIES[_name], points_of=_plot))


# -- codecs and sources ---------------------------------------------------------------------------------------------------------


def _arrays(spark, d):
    return pk.collect_arrays(_peaks(spark, d))


@query("zlib_roundtrip", f"WITH {SQL_PEAKS} SELECT spec_id, mz, i FROM peaks")
def zlib_roundtrip(spark, d):
    """64-bit arrays through zlib and base64 and back."""
    importable(spark)
    both = ["MS:1000523", codec.ZLIB]
    coded = _arrays(spark, d).select("spec_id", codec.encoded("mz", both).alias("a"), codec.encoded("i", both).alias("b"))
    codes = F.array(*map(F.lit, both))
    return pk.explode_arrays(coded.select("spec_id", codec.decoded("a", codes).alias("mz"), codec.decoded("b", codes).alias("i"))).drop("pos")


@query("numpress_linear_roundtrip", f"WITH {SQL_PEAKS} SELECT spec_id, count(*) AS n, round(sum(mz), 2) AS sum_mz FROM peaks GROUP BY 1")
def numpress_linear_roundtrip(spark, d):
    importable(spark)
    coded = _arrays(spark, d).select("spec_id", codec.encoded("mz", [codec.LINEAR]).alias("a"))
    back = coded.select("spec_id", F.explode(codec.decoded("a", F.array(F.lit(codec.LINEAR)))).alias("mz"))
    return back.groupBy("spec_id").agg(F.count("*").alias("n"), F.round(F.sum("mz"), 2).alias("sum_mz"))


@query("numpress_pic_roundtrip", f"WITH {SQL_PEAKS} SELECT spec_id, count(*) AS n, sum(floor(i + 0.5)) AS sum_i FROM peaks GROUP BY 1")
def numpress_pic_roundtrip(spark, d):
    importable(spark)
    coded = _arrays(spark, d).select("spec_id", codec.encoded("i", [codec.PIC]).alias("a"))
    back = coded.select("spec_id", F.explode(codec.decoded("a", F.array(F.lit(codec.PIC)))).alias("i"))
    return back.groupBy("spec_id").agg(F.count("*").alias("n"), F.sum("i").alias("sum_i"))


@query(
    "slof_roundtrip",
    f"WITH {SQL_PEAKS}, f AS (SELECT spec_id, floor(65535 / greatest(1.0, ln(max(i) + 1))) AS fp FROM peaks GROUP BY 1) SELECT spec_id, count(*) AS n, round(sum(exp(floor(ln(i + 1) * fp + 0.5) / fp) - 1), 3) AS sum_i FROM peaks JOIN f USING (spec_id) GROUP BY 1",
)
def slof_roundtrip(spark, d):
    importable(spark)
    coded = _arrays(spark, d).select("spec_id", codec.encoded("i", [codec.SLOF]).alias("a"))
    back = coded.select("spec_id", F.explode(codec.decoded("a", F.array(F.lit(codec.SLOF)))).alias("i"))
    return back.groupBy("spec_id").agg(F.count("*").alias("n"), F.round(F.sum("i"), 3).alias("sum_i"))


@query("numpress_linear_delta", f"WITH {SQL_PEAKS} SELECT spec_id, round_even(mz * 100, 0)::BIGINT AS x FROM peaks")
def numpress_linear_delta(spark, d):
    """Second differences and back by two running sums, in windows."""
    x = _peaks(spark, d).select("spec_id", "mz", F.bround(F.col("mz") * 100).cast("long").alias("x"))
    return series.running_sums(series.second_differences(x, "x", "mz"), "x", "mz").select("spec_id", "x")


@query(
    "mzml_scan",
    f"WITH {SQL_PEAKS} SELECT spec_id AS native_id, 1::INT AS ms_level, count(*) AS n_peaks, round(sum(i), 7) AS tic FROM peaks GROUP BY 1",
)
def mzml_scan(spark, d):
    """Spectra written as XML elements, then parsed and decoded."""
    return _scanned(mzml.spectra_from_xml(_elements(spark, d)))


def _elements(spark, d):
    importable(spark)
    return mzml.spectrum_elements(_arrays(spark, d), "spec_id", ["MS:1000523", codec.ZLIB])


def _scanned(s):
    return mzml.peaks(s, ("native_id", "ms_level")).groupBy("native_id", "ms_level").agg(F.count("*").alias("n_peaks"), F.round(F.sum("i"), 7).alias("tic"))


for _name, _suffix in (("mzml_file_scan", "mzML"), ("mzml_gzip_scan", "mzML.gz")):

    @query(_name, SQL["mzml_scan"])
    def mzml_file_scan(spark, d, suffix=_suffix):
        """The same through files of many spectra each, plain or gzip."""
        return _scanned(mzml.spectra(spark, mzml.write(_elements(spark, d), work_folder(spark, "mzml"), suffix)))


@query("igzip_scan", SQL["mzml_scan"])
def igzip_scan(spark, d):
    """The same through indexed gzip, block by block."""
    path = f"{work_folder(spark, 'igzip')}/run.mzML.gz"
    n = igzip.write(_elements(spark, d).select(F.col("spec_id").alias("id"), F.col("element").alias("block")), path)
    assert n == len(igzip.read_index(path))
    return _scanned(mzml.spectra_from_xml(igzip.read_igzip(spark, path).select(F.col("text").alias("element"))))


@query("mzml_runs", "SELECT 'made' AS run_id, (SELECT count(DISTINCT l_suppkey) FROM lineitem)::INT AS spectrum_count, 'some instrument' AS instrument, 1::INT AS n_software")
def mzml_runs(spark, d):
    """Header of a written file; only its head is read."""
    path = mzml.write(_elements(spark, d), work_folder(spark, "mzml"), "mzML", files=1, run="made", instrument="some instrument")
    return mzml.headers(spark, path).select("run_id", "spectrum_count", "instrument", F.size("software").alias("n_software"))


@query("index_from_scratch", "SELECT DISTINCT l_suppkey AS native_id, 'spectrum' AS kind FROM lineitem")
def index_from_scratch(spark, d):
    """Offsets of open tags in written files; each one points at its tag."""
    path = mzml.write(_elements(spark, d), work_folder(spark, "mzml"))
    return mzml.scan_index_from_scratch(spark, path).where("offset > 0").select("native_id", "kind")


@query("raw_elements", "SELECT DISTINCT l_suppkey AS native_id, true AS whole FROM lineitem")
def raw_elements(spark, d):
    path = mzml.write(_elements(spark, d), work_folder(spark, "mzml"), "mzML.gz")
    e = mzml.raw_elements(spark, path)
    return e.select(spectra.native_id(F.regexp_extract("element", r'\bid="([^"]*)"', 1)).alias("native_id"), (F.startswith("element", F.lit("<spectrum ")) & F.endswith("element", F.lit("</spectrum>"))).alias("whole"))


@query("sqlite_scan", SQL["mzml_scan"])
def sqlite_scan(spark, d):
    path = f"{work_folder(spark, 'sqlite')}/store.db"
    sqlite.write(_elements(spark, d).withColumnRenamed("spec_id", "id"), path)
    return _scanned(mzml.spectra_from_xml(sqlite.read(spark, path)))


@query("element_by_path", f"WITH {SQL_PEAKS} SELECT DISTINCT spec_id AS native_id, '1' AS ms_level, '64-bit float' AS kind FROM peaks")
def element_by_path(spark, d):
    e = _elements(spark, d)
    return e.select(F.col("spec_id").alias("native_id"), spectra.element_by_name("element", "ms level").alias("ms_level"), F.get(spectra.elements_by_path("element", "spectrum/binaryDataArrayList/binaryDataArray/cvParam[1]/@name"), F.lit(0)).alias("kind"))


@query("html_tag_extract", "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1) AS title, regexp_extract(url, '^\\w+://([^/?#]+)', 1) AS host FROM pages")
def html_tag_extract(spark, d):
    return _t(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", r"^\w+://([^/?#]+)", 1).alias("host"))
