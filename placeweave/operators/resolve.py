"""Places to boundaries: candidate look-ups, validation, ranking and fallback over tables that stand for map services.

``gazetteer`` (address_key, city, position, location, level,
formatted_address), ``districts`` (keyword, position, name, adcode, level,
polyline) and ``osm_elements`` (osm_type, name, tags, geometry). Places are
distinct (name, in_region, in_country); what equal places find is looked up
once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.functions import columns as C
from placeweave.functions import kernel as K
from placeweave.functions.pseudo import lookup_boundary
from placeweave.operators.coast import dissolved
from placeweave.operators.memo import LookupMemo
from placeweave.storage import saved, tasks_for

PLACE = ("name", "in_region", "in_country")
# What is appended to names of scenic places, of regions and of districts.
SCENIC = ("风景名胜区", "风景区", "景区", "公园", "湖")
REGION = ("", "省", "市", "区", "县")
TRANSLATED = ("省", "市", "区", "县")
OWN = ("市", "区", "县", "省")
#: Look-ups and keywords of a place at most.
LOOKUPS, KEYWORDS = 17, 12


def _key() -> Column:
    """One hash-free key of a place, null kept apart from empty."""
    return F.to_json(F.struct(*PLACE))


def places_of(nodes: DataFrame) -> DataFrame:
    """Distinct places named in a tree table, with their key."""
    return nodes.filter("node_type = 'NamedPlace' and name is not null").select(*PLACE).distinct().withColumn("place", _key())


def _ordered(entries: list[Column]) -> Column:
    """Entries (address, city) that aren't null, with their place in the list."""
    return F.filter(F.array(*[F.when(e["address"].isNotNull(), F.struct(F.lit(i).alias("ordinal"), e["address"].alias("address"), e["city"].alias("city"))) for i, e in enumerate(entries)]), lambda e: e.isNotNull())


def geocode_candidates(places: DataFrame) -> DataFrame:
    """(place, columns of PLACE, ordinal, address, city): the look-ups for each place, in order of preference, at most 17."""
    name, region, country = F.col("name"), F.col("in_region"), F.col("in_country")
    cn_region, cn_country = C.chinese_name(region), C.chinese_name(country)
    none = F.lit(None).cast("string")
    entry = lambda address, city, when: F.struct(F.when(when, address).alias("address"), city.alias("city"))
    differs = lambda given, cn: given.isNotNull() & (given != "") & ~given.eqNullSafe(cn)
    outside = lambda cn: cn.isNotNull() & ~name.contains(cn)
    entries = [
        entry(name, cn_region, cn_region.isNotNull()), entry(name, cn_country, cn_country.isNotNull()),
        entry(name, region, differs(region, cn_region)), entry(name, country, differs(country, cn_country)), entry(name, none, F.lit(True)),
        entry(F.concat(cn_region, name), none, outside(cn_region)), entry(F.concat(cn_country, name), none, outside(cn_country)),
    ]
    for s in SCENIC:
        free = ~name.contains(s)
        entries += [entry(F.concat(name, F.lit(s)), cn_region, free & cn_region.isNotNull()), entry(F.concat(name, F.lit(s)), none, free)]
    return places.select("place", *PLACE, F.inline(_ordered(entries)))


def first_entries(gazetteer: DataFrame, tasks: int, asked: DataFrame | None = None) -> DataFrame:
    """(address_key, city, found): the gazetteer's first entry for each (address_key, city), of those ``asked`` for if given; no city is the empty string."""
    dealt = lambda df: df.repartition(tasks, "address_key", "city")
    entries = dealt(gazetteer.withColumn("city", F.coalesce("city", F.lit(""))))
    if asked is not None:
        entries = entries.join(dealt(asked), ["address_key", "city"], "left_semi")
    return entries.groupBy("address_key", "city").agg(F.min_by(F.struct("location", "level", "formatted_address"), "position").alias("found"))


def geocoded(candidates: DataFrame, gazetteer: DataFrame, memo: LookupMemo | None = None, rows: int | None = None) -> DataFrame:
    """Candidates with what the gazetteer's first entry for (address, city) says; no row where there is none or its location is malformed.

    With ``memo`` the gazetteer is asked only for what that doesn't know yet.
    There are at most ``rows`` candidates, which are counted if that isn't given.
    """
    rows = candidates.count() if rows is None else rows
    tasks = tasks_for(rows + gazetteer.count())
    asked = candidates.withColumns({"address_key": F.col("address"), "city": F.coalesce("city", F.lit(""))})
    first = memo.answers(asked, lambda new: first_entries(gazetteer, tasks, new), rows) if memo else first_entries(gazetteer, tasks)
    dealt = lambda df: df.repartition(tasks, "address_key", "city")
    got = dealt(asked).join(dealt(first.withColumnRenamed("found", "g")) if memo else first.withColumnRenamed("found", "g"), ["address_key", "city"])
    at = F.split("g.location", ",")
    level = F.coalesce("g.level", F.lit("兴趣点"))
    return got.select(
        "place", *PLACE, "ordinal", F.get(at, 0).try_cast("double").alias("lon"), F.get(at, 1).try_cast("double").alias("lat"), level.alias("level"),
        F.coalesce("g.formatted_address", "address").alias("found_address"), F.coalesce(C.lookup(C.LEVEL_RADIUS_KM, level), F.lit(C.DEFAULT_RADIUS_KM)).alias("radius_km"),
    ).filter("lon is not null and lat is not null")


def valid(address: Column, region: Column, country: Column) -> Column:
    """Whether an address lies in the region or country that was asked for; anything does if neither was."""
    has = lambda part: F.coalesce(address.contains(part), F.lit(False))
    given = lambda c: c.isNotNull() & (c != "")
    return (
        has(C.chinese_name(region)) | has(C.chinese_name(country)) | (given(region) & has_lower(address, region)) | (given(country) & has_lower(address, country))
        | (~given(region) & ~given(country))
    )


def has_lower(address: Column, part: Column) -> Column:
    return F.coalesce(F.lower(address).contains(F.lower(part)), F.lit(False))


def best_candidate(places: DataFrame, gazetteer: DataFrame, memo: LookupMemo | None = None) -> DataFrame:
    """(place, lon, lat, level, found_address, radius_km): the valid candidate of the most exact level, the earliest of equals."""
    rows = LOOKUPS * places.count()
    tasks = tasks_for(rows)
    found = geocoded(geocode_candidates(places.repartition(tasks, *PLACE)), gazetteer, memo, rows).filter(valid(F.col("found_address"), F.col("in_region"), F.col("in_country")))
    order = F.struct(F.coalesce(C.lookup(C.LEVEL_SCORE, F.col("level")), F.lit(C.DEFAULT_SCORE)), "ordinal")
    best = found.repartition(tasks, "place").groupBy("place").agg(F.min_by(F.struct("lon", "lat", "level", "found_address", "radius_km"), order).alias("b"))
    return best.select("place", "b.*")


def precise_bounds(places: DataFrame, gazetteer: DataFrame, memo: LookupMemo | None = None) -> DataFrame:
    """(place, center_lon, center_lat, radius_km, level, address) of each place's best candidate."""
    best = best_candidate(places, gazetteer, memo)
    return best.select("place", F.col("lon").alias("center_lon"), F.col("lat").alias("center_lat"), "radius_km", "level", F.col("found_address").alias("address"))


def region_adcode(regions: DataFrame, districts: DataFrame) -> DataFrame:
    """(region, adcode) by the region's name, then its Chinese name, each bare and with suffixes; the code of the first answer whose first district has one."""
    region = F.col("region")
    names = [region, C.chinese_name(region)]
    entries = [F.struct(F.when(n.contains(s), n).otherwise(F.concat(n, F.lit(s))).alias("address"), F.lit(None).cast("string").alias("city")) for n in names for s in REGION]
    keys = regions.select("region", F.inline(_ordered(entries))).select("region", "ordinal", F.col("address").alias("keyword"))
    codes = districts.join(keys.select("keyword").distinct(), "keyword", "left_semi").groupBy("keyword").agg(F.min_by("adcode", "position").alias("adcode")).filter("adcode <> ''")
    return keys.join(codes, "keyword").groupBy("region").agg(F.min_by("adcode", "ordinal").alias("adcode"))


def district_best(places: DataFrame, districts: DataFrame) -> DataFrame:
    """(place, boundary, name, level, malformed): the district that fits a place best.

    All districts that the place's names find are kept if no soft filter has
    a match: first the region's code prefix, then the exact name. Of those
    left the smallest kind of district wins, then the earliest. If its
    polyline has a point that is no number, it is ``malformed`` and has no boundary.
    """
    name, cn = F.col("name"), C.chinese_name(F.col("name"))
    cn_region, cn_country = C.chinese_name(F.col("in_region")), C.chinese_name(F.col("in_country"))
    plain = [name, cn, *[F.concat(cn, F.lit(s)) for s in TRANSLATED], F.concat(cn_region, name), F.concat(cn_country, name), *[F.concat(name, F.lit(s)) for s in OWN]]
    entries = [F.struct(a.alias("address"), F.lit(None).cast("string").alias("city")) for a in plain]
    count = KEYWORDS * places.count()
    tasks = tasks_for(count + districts.count())
    keys = places.repartition(tasks_for(count), *PLACE).select("place", *PLACE, F.inline(_ordered(entries))).withColumnRenamed("address", "keyword").drop("city")
    rows = keys.repartition(tasks, "keyword").join(districts.filter("polyline <> ''").repartition(tasks, "keyword").select("keyword", "position", F.col("name").alias("d_name"), "adcode", F.col("level").alias("d_level"), "polyline"), "keyword")
    region = F.coalesce(F.nullif("in_region", F.lit("")), "in_country")
    codes = region_adcode(places.select(region.alias("region")).filter("region <> ''").distinct(), districts).withColumnRenamed("adcode", "code")
    rows = rows.withColumn("region", region).join(codes, "region", "left").repartition(tasks, "place")
    digits = F.when(F.col("code").endswith("0000"), 2).when(F.col("code").endswith("00"), 4)
    whole = Window.partitionBy("place")
    soft = lambda df, match: df.withColumn("_m", F.coalesce(match, F.lit(False))).withColumn("_any", F.max("_m").over(whole)).filter("_m or not _any").drop("_m", "_any")
    rows = soft(rows, F.col("adcode").startswith(F.substring(F.col("code"), F.lit(1), digits)))
    rows = soft(rows, (F.col("d_name") == F.col("name")) | (F.col("d_name") == C.chinese_name(F.col("name"))))
    order = F.struct(F.coalesce(C.lookup(C.DISTRICT_RANK, F.col("d_level")), F.lit(C.DEFAULT_RANK)), "ordinal", "position")
    best = rows.groupBy("place").agg(F.min_by(F.struct("d_name", "d_level", "polyline"), order).alias("b"))
    bad = C.polyline_malformed(F.col("b.polyline"))
    boundary = F.when(~bad, C.rings_json(C.polyline_rings(F.col("b.polyline"))))
    return best.select("place", boundary.alias("boundary"), F.col("b.d_name").alias("name"), F.col("b.d_level").alias("level"), bad.alias("malformed"))


def osm_wanted() -> Column:
    """Elements that can be a place: any with a place tag; relations that are administrative; areas of amenities, leisure, tourism and water."""
    tag = lambda k: F.col("tags")[k].isNotNull()
    area = F.col("osm_type").isin("way", "relation") & (tag("amenity") | tag("leisure") | tag("tourism") | tag("waterway") | (F.col("tags")["natural"] == "water"))
    relation = (F.col("osm_type") == "relation") & (F.col("tags")["boundary"] == "administrative")
    return F.coalesce(tag("place"), F.lit(False)) | F.coalesce(area, F.lit(False)) | F.coalesce(relation, F.lit(False))


def osm_boundary(elements: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(name, boundary): polygons, and closed lines as polygons, of a name's elements, dissolved; others and bad geometries are passed over.

    With ``names`` (name) only those are looked up.
    """
    wanted = elements.filter(osm_wanted())
    if names is not None:
        wanted = wanted.join(names.select("name").distinct(), "name", "left_semi")
    parts = wanted.select("name", K.call("Areal", K.from_geojson("geometry")).alias("g")).filter("g is not null")
    return dissolved(parts, ["name"], "g").select("name", K.to_geojson("g").alias("boundary"))


def resolve(places: DataFrame, gazetteer: DataFrame | None, districts: DataFrame | None, osm_elements: DataFrame | None, memo: LookupMemo | None = None) -> DataFrame:
    """(place, boundary, lon, lat, radius_km, level, source): the first of district, map features and a point with a drawn boundary.

    Each source that there is is asked once, for the places that those before
    it left. A place whose district boundary is malformed goes to a point
    without a boundary at once ("point after error"): it is drawn around its
    centre when its tree is evaluated.
    """
    spark = places.sparkSession
    K.register(spark)
    none = lambda kind: F.lit(None).cast(kind)
    area = lambda rows, source: rows.select("place", "boundary", none("double").alias("lon"), none("double").alias("lat"), none("double").alias("radius_km"), none("string").alias("level"), F.lit(source).alias("source"))
    places = rest = saved(places)
    asked = rest.withColumn("failed", F.lit(False))
    found = [spark.createDataFrame([], "place string, boundary string, lon double, lat double, radius_km double, level string, source string")]
    if districts is not None:
        district = saved(district_best(places, districts).select("place", "boundary", "malformed").filter("boundary is not null or malformed"))
        found.append(area(district.filter("not malformed"), "district"))
        rest = rest.join(district.select("place"), "place", "left_anti")
        failed = places.join(district.filter("malformed").select("place"), "place", "left_semi").withColumn("failed", F.lit(True))
        asked = rest.withColumn("failed", F.lit(False)).unionByName(failed)
    if osm_elements is not None:
        by_osm = saved(rest.join(osm_boundary(osm_elements, rest), "name").select("place", "boundary"))
        found.append(area(by_osm, "osm"))
        asked = asked.join(by_osm.select("place"), "place", "left_anti")
    if gazetteer is not None:
        asked = saved(asked)
        point = best_candidate(asked.drop("failed"), gazetteer, memo).join(asked.select("place", "failed"), "place")
        drawn = lookup_boundary(*[F.when(~F.col("failed"), F.col(c)) for c in ("lon", "lat", "radius_km")])
        found.append(point.select("place", drawn.alias("boundary"), "lon", "lat", "radius_km", "level", F.when(F.col("failed"), "point after error").otherwise("point").alias("source")))
    rows = reduce(DataFrame.unionByName, found).withColumn("m", K.measures(K.from_geojson("boundary")))
    return rows.select("place", "boundary", F.coalesce("m.cx", "lon").alias("lon"), F.coalesce("m.cy", "lat").alias("lat"), "radius_km", "level", "source")


def enrich(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """(query_id, node_id, boundary, lon, lat, radius_km, level) of the leaves whose place was resolved."""
    leaves = nodes.filter("node_type = 'NamedPlace' and name is not null").select("query_id", "node_id", _key().alias("place"))
    return leaves.join(resolved, "place").select("query_id", "node_id", "boundary", "lon", "lat", "radius_km", "level")
