"""Spectrum and chromatogram tables: ids, times, CV parameters, precursors.

A parameter list is an array of structs (accession, name, value, unit), all
strings; a flag has the value ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MS_LEVEL, SCAN_TIME, TIC, PROFILE = "MS:1000511", "MS:1000016", "MS:1000285", "MS:1000128"
PRECURSOR_MZ, PRECURSOR_I, CHARGE, ISOLATION_TARGET = "MS:1000744", "MS:1000042", "MS:1000041", "MS:1000827"
NEGATIVE, POSITIVE = "MS:1000129", "MS:1000130"
CHROMATOGRAM_TYPES = tuple(f"MS:{n}" for n in (1000235, 1000627, 1000628, *range(1000810, 1000816), *range(1001472, 1001481)))


# -- ids and times -----------------------------------------------------------------------------------------------------


def native_id(raw: Column | str) -> Column:
    """The integer at the end of a native id; null if there is none."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.regexp_extract(raw, '="?([0-9]+)"?>?$', 1).try_cast("bigint")


def id_map(raw: Column | str) -> Column:
    """All key=integer pairs of a native id."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    pairs = F.regexp_extract_all(raw, F.lit(r"(\w+=[0-9]+)"), F.lit(1))
    keys, values = F.transform(pairs, lambda p: F.substring_index(p, "=", 1)), F.transform(pairs, lambda p: F.substring_index(p, "=", -1).cast("bigint"))
    return F.map_from_arrays(keys, values)


def minutes(time: Column | str, unit: Column | str) -> Column:
    """A scan time in minutes; an unknown unit is an error."""
    t, u = (F.col(c) if isinstance(c, str) else c for c in (time, unit))
    u = F.lower(u)
    return (
        F.when(u.isin("millisecond", "ms"), t / 1000 / 60)
        .when(u.isin("second", "s"), t / 60)
        .when(u.isin("minute", "min"), t)
        .when(u.isin("hour", "h"), t * 60)
        .when(u.isNull(), F.lit(None).cast("double"))
        .otherwise(F.raise_error(F.concat(F.lit("no such unit of time: "), u)).cast("double"))
    )


# -- parameters --------------------------------------------------------------------------------------------------------


def params(cv: Column | str, accession: str) -> Column:
    """The parameters of one accession, in order."""
    return F.filter(cv if isinstance(cv, Column) else F.col(cv), lambda x: x["accession"] == accession)


def param(cv: Column | str, accession: str, default: str | None = None) -> Column:
    """The value of the first parameter of an accession, or the default."""
    return F.coalesce(F.get(params(cv, accession), F.lit(0))["value"], F.lit(default).cast("string"))


def param_number(cv: Column | str, accession: str) -> Column:
    return param(cv, accession).try_cast("double")


def has_param(cv: Column | str, accession: str) -> Column:
    return F.exists(cv if isinstance(cv, Column) else F.col(cv), lambda x: x["accession"] == accession)


def all_params(cv: Column | str, accession: str) -> Column:
    """Every value of an accession as (present, num, str): a number where it is one, a flag has neither."""
    return F.transform(params(cv, accession), lambda x: F.struct(F.lit(True).alias("present"), x["value"].try_cast("double").alias("num"), F.nullif(x["value"], F.lit("")).alias("str")))


def params_map(cv: Column | str) -> Column:
    """Accession -> value of the first parameter of each."""
    cv = cv if isinstance(cv, Column) else F.col(cv)
    first = F.filter(cv, lambda x, i: F.array_position(F.transform(cv, lambda y: y["accession"]), x["accession"]) == i + 1)
    return F.map_from_arrays(F.transform(first, lambda x: x["accession"]), F.transform(first, lambda x: x["value"]))


def param_by_name(spectra: DataFrame, terms: DataFrame, name: str, cv: str = "cv") -> DataFrame:
    """spectra with ``value``: looked up by a term's name through the ontology."""
    wanted = terms.where(F.col("name") == name).select(F.col("id").alias("__accession"))
    return spectra.join(F.broadcast(wanted.limit(1)), how="left").withColumn("value", F.get(F.filter(cv, lambda x: x["accession"] == F.col("__accession")), F.lit(0))["value"]).drop("__accession")


def of_level(spectra: DataFrame, level: int) -> DataFrame:
    return spectra.where(F.col("ms_level") == level)


def with_param_groups(spectra: DataFrame, groups: DataFrame) -> DataFrame:
    """Parameters of the referenced group after the spectrum's own; spectra have group_ref, groups (id, cv)."""
    g = groups.select(F.col("id").alias("__id"), F.col("cv").alias("__cv"))
    joined = spectra.join(g, F.col("group_ref") == F.col("__id"), "left")
    return joined.withColumn("cv", F.concat("cv", F.coalesce("__cv", F.array().cast(groups.schema["cv"].dataType)))).drop("__id", "__cv")


# -- elements as text ---------------------------------------------------------------------------------------------------


def elements_by_path(xml: Column | str, path: str) -> Column:
    """Texts (or attributes) of all elements that an XPath names, from a column of whole elements."""
    return F.xpath(xml, F.lit(path))


def element_by_name(xml: Column | str, name: str) -> Column:
    """The value of the first parameter of a name or accession in an element; null if there is none."""
    if "'" in name:
        raise ValueError("a parameter's name has no quotes")
    xml = F.col(xml) if isinstance(xml, str) else xml
    return F.get(F.xpath(xml, F.lit(f"//cvParam[@name='{name}' or @accession='{name}']/@value")), F.lit(0))


# -- precursors --------------------------------------------------------------------------------------------------------


def precursor_rows(spectra: DataFrame, keys: tuple[str, ...] = ("native_id",)) -> DataFrame:
    """keys…, mz, i, charge, precursor_id: one row for each selected ion."""
    return spectra.select(*keys, F.explode("precursors").alias("p")).select(*keys, "p.mz", "p.i", "p.charge", "p.precursor_id")


def top_precursors(precursors: DataFrame, n: int = 10, decimals: int = 3, key: str = "native_id") -> DataFrame:
    """The n most frequent rounded precursor m/z; the greater m/z first among equals.

    The winners are found from counts alone; only their scan ids are collected.
    """
    rounded = precursors.withColumn("mz", F.bround("mz", decimals))
    top = rounded.groupBy("mz").agg(F.count("*").alias("n_scans")).orderBy(F.desc("n_scans"), F.desc("mz")).limit(n)
    ids = rounded.join(F.broadcast(top), "mz").groupBy("mz", "n_scans").agg(F.array_sort(F.collect_list(key)).alias("scans"))
    return ids


def with_parent(spectra: DataFrame, key: str = "native_id", parent: str = "precursor_id") -> DataFrame:
    """Each spectrum beside the time and TIC of the scan its precursor was taken from."""
    up = spectra.select(F.col(key).alias(parent), F.col("scan_time").alias("parent_time"), F.col("tic").alias("parent_tic"))
    return spectra.join(up, parent, "left")


# -- lookups -----------------------------------------------------------------------------------------------------------


def by_id(table: DataFrame, value: int, key: str = "native_id") -> DataFrame:
    """Parquet statistics prune this; an id outside the table's range gives no row (see ``bounds``)."""
    return table.where(F.col(key) == value)


def bounds(table: DataFrame, key: str = "native_id") -> DataFrame:
    """The least and the greatest id."""
    return table.agg(F.min(key).alias("first_id"), F.max(key).alias("last_id"))


def by_ordinal(table: DataFrame, k: int, order: str = "idx") -> DataFrame:
    """The k-th row (from 0) in file order; sorted per file, since an attribute may start anywhere."""
    if not isinstance(k, int) or isinstance(k, bool):
        raise ValueError("an ordinal is an integer")
    return table.orderBy(order).offset(k).limit(1)


def search_id(table: DataFrame, text: str, raw: str = "id_raw", order: str = "idx") -> DataFrame:
    """The first row, in file order, whose raw id holds the text."""
    return table.where(F.col(raw).contains(text)).orderBy(order).limit(1)


def by_name(table: DataFrame, name: str, key: str = "id") -> DataFrame:
    """Rows of a name, whatever its case, such as a chromatogram's."""
    return table.where(F.upper(key) == name.upper())


def search_any(spectra: DataFrame, chromatograms: DataFrame, text: str) -> DataFrame:
    """kind, id of the first spectrum whose raw id holds the text; if there is none, of the first such chromatogram."""
    found = search_id(spectra, text).select(F.lit("spectrum").alias("kind"), F.col("id_raw").alias("id"))
    other = search_id(chromatograms, text, "id").select(F.lit("chromatogram").alias("kind"), "id")
    return found.unionByName(other).orderBy(F.desc("kind")).limit(1)


def first_scans(table: DataFrame, k: int, order: str = "idx") -> DataFrame:
    return table.orderBy(order).limit(k)


def block_lengths(index: DataFrame, path: str = "path", offset: str = "offset", end: str = "file_size") -> DataFrame:
    """Length of each block of an offset index: up to the next offset, or the end of the file."""
    w = Window.partitionBy(path).orderBy(offset)
    return index.withColumn("length", F.coalesce(F.lead(offset).over(w), F.col(end)) - F.col(offset))


def merge_index(first: DataFrame, later: DataFrame, key: str = "id_raw") -> DataFrame:
    """Both indexes; the later one's rows win."""
    both = first.withColumn("__rank", F.lit(0)).unionByName(later.withColumn("__rank", F.lit(1)))
    value = [c for c in first.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*value), "__rank").alias("v")).select(key, "v.*")


def validate_count(declared: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """key, declared, found, complete: what the header says beside what is there."""
    n = found.groupBy(key).agg(F.count("*").alias("found"))
    joined = declared.select(key, F.col("spectrum_count").cast("bigint").alias("declared")).join(n, key, "left")
    return joined.select(key, "declared", F.coalesce("found", F.lit(0)).alias("found")).withColumn("complete", F.col("declared") <= F.col("found"))


# -- chromatograms -----------------------------------------------------------------------------------------------------


def chromatogram_points(chromatograms: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    zipped = F.arrays_zip(F.col("time").alias("time"), F.col("i").alias("i"))
    return chromatograms.select(*keys, F.posexplode(zipped).alias("pos", "p")).select(*keys, "pos", "p.time", "p.i")


def profile(points: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Points numbered by time within their chromatogram."""
    return points.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("time")) - 1)


def chromatogram_properties(chromatograms: DataFrame, cv: str = "cv") -> DataFrame:
    """id, type, polarity, precursor and product m/z."""
    kind = F.get(F.filter(cv, lambda x: x["accession"].isin(*CHROMATOGRAM_TYPES)), F.lit(0))["name"]
    polarity = F.get(F.filter(cv, lambda x: x["accession"].isin(NEGATIVE, POSITIVE)), F.lit(0))["name"]
    return chromatograms.select("id", kind.alias("type"), polarity.alias("polarity"), param_number("precursor_cv", ISOLATION_TARGET).alias("precursor_mz"), param_number("product_cv", ISOLATION_TARGET).alias("product_mz"))
