"""Spatial and text expressions of built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.32
DIRECTIONS = ("north", "south", "east", "west")

# Effective radius in km by provider level, and by default.
LEVEL_RADIUS_KM = {"兴趣点": 0.15, "门牌号": 0.1, "村庄": 0.5, "乡镇": 2.0, "区县": 5.0, "市": 20.0, "省": 50.0, "国家": 100.0}
DEFAULT_RADIUS_KM = 0.5
# Precision of a provider level, the smaller the more exact, and by default.
LEVEL_SCORE = {"门牌号": 1, "兴趣点": 2, "村庄": 3, "乡镇": 4, "道路": 4, "住宅小区": 4, "区县": 5, "高等院校": 5, "市": 6, "省": 7, "国家": 8}
DEFAULT_SCORE = 5
# Rank of a district level, and by default.
DISTRICT_RANK = {"district": 1, "city": 2, "province": 3, "country": 4}
DEFAULT_RANK = 5
# Chinese names of regions. Most are known in lower and in title case; the others as listed below.
CHINESE = {
    "Beijing": "北京", "Shanghai": "上海", "Guangdong": "广东", "Zhejiang": "浙江", "Sichuan": "四川", "Jiangsu": "江苏", "Hubei": "湖北",
    "Hunan": "湖南", "Fujian": "福建", "Shandong": "山东", "Henan": "河南", "Hebei": "河北", "Liaoning": "辽宁", "Yunnan": "云南",
    "Guizhou": "贵州", "Shanxi": "山西", "Shaanxi": "陕西", "Gansu": "甘肃", "Qinghai": "青海", "Hainan": "海南", "Jilin": "吉林",
    "Anhui": "安徽", "Jiangxi": "江西", "Taiwan": "台湾", "Guangxi": "广西", "Xinjiang": "新疆", "Ningxia": "宁夏", "Hong Kong": "香港",
    "Macau": "澳门", "China": "中国",
}
ONE_CASE = {"neimenggu": "内蒙古", "Inner Mongolia": "内蒙古", "xizang": "西藏", "Tibet": "西藏", "asia": "亚洲"}
NAMES = CHINESE | {k.lower(): v for k, v in CHINESE.items()} | ONE_CASE


def lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def km_to_degrees(km: Column, lat: Column) -> Column:
    """The larger of the degrees of latitude and of longitude."""
    return F.greatest(km / KM_PER_DEGREE, km / (KM_PER_DEGREE * F.cos(F.radians(F.abs(lat))) + 1e-10))


def chinese_name(name: Column) -> Column:
    return F.coalesce(lookup(NAMES, name), lookup(NAMES, F.lower(name)))


def side_box(direction: Column, minx: Column, miny: Column, maxx: Column, maxy: Column, d: Column) -> tuple[Column, Column, Column, Column]:
    """The box of depth ``d`` outside one side of a box; null for an unknown direction."""
    known = direction.isin(*DIRECTIONS)
    pick = lambda side, moved, still: F.when(direction == side, moved).when(known, still)
    return (
        F.when(direction == "west", minx - d).otherwise(pick("east", maxx, minx)),
        F.when(direction == "south", miny - d).otherwise(pick("north", maxy, miny)),
        F.when(direction == "east", maxx + d).otherwise(pick("west", minx, maxx)),
        F.when(direction == "north", maxy + d).otherwise(pick("south", miny, maxy)),
    )


def box_json(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """A box as a GeoJSON polygon."""
    point = lambda x, y: F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))
    ring = F.concat_ws(",", point(maxx, miny), point(maxx, maxy), point(minx, maxy), point(minx, miny), point(maxx, miny))
    return F.when(minx.isNotNull(), F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}")))


def effective_radius_km(level: Column, radius: Column) -> Column:
    """Radius of a place without a boundary; 0 counts as none."""
    given = F.when(radius != 0, radius)
    return F.coalesce(given, F.when(level.isin("兴趣点", "门牌号"), 0.15).when(level == "乡镇", 2.0).otherwise(DEFAULT_RADIUS_KM))


def strip_fence(text: Column) -> Column:
    """A model's answer without the Markdown fence around it."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return bare(F.regexp_replace(F.regexp_replace(bare(text), r"^```(json)?", ""), r"```$", ""))


def polyline_rings(polyline: Column) -> Column:
    """Rings as arrays of points: ``|`` between rings, ``;`` between points, ``,`` in a point.

    Points without two parts and empty rings are dropped; null without any
    ring. Parts that are no numbers are null: see :func:`polyline_malformed`.
    """
    pairs = lambda ring: F.filter(F.transform(F.split(ring, ";"), lambda p: F.split(p, ",")), lambda p: F.size(p) == 2)
    rings = F.transform(F.split(polyline, r"\|"), lambda r: F.transform(pairs(r), lambda p: F.struct(p[0].try_cast("double").alias("x"), p[1].try_cast("double").alias("y"))))
    full = F.filter(rings, lambda r: F.size(r) > 0)
    return F.when(F.size(full) > 0, full)


def polyline_malformed(polyline: Column) -> Column:
    """Whether a point of two parts has one that is no number: such a boundary as a whole is an error."""
    bad = lambda p: (F.size(p) == 2) & (p[0].try_cast("double").isNull() | p[1].try_cast("double").isNull())
    return F.coalesce(F.exists(F.split(polyline, r"[|;]"), lambda p: bad(F.split(p, ","))), F.lit(False))


def rings_json(rings: Column) -> Column:
    """Rings as a GeoJSON polygon, or multipolygon of polygons without holes."""
    inner = F.transform(rings, lambda r: F.concat(F.lit("[["), F.array_join(F.transform(r, lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))), ","), F.lit("]]")))
    one = F.concat(F.lit('{"type":"Polygon","coordinates":'), F.get(inner, 0), F.lit("}"))
    return F.when(F.size(rings) == 1, one).when(F.size(rings) > 1, F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), F.array_join(inner, ","), F.lit("]}")))


# Colours and widths of map layers.
def map_style(kind: Column) -> Column:
    """Marker, line or fill style of a map layer by geometry type."""
    line = kind.isin("LineString", "MultiLineString")
    return F.when(kind == "Point", "marker:red").when(line, "line:#ff4400;weight:4;opacity:0.8").otherwise("fill:#ff7800;opacity:0.4;line:#ff4400;weight:2")


# Fixed value: the name of a feature.
def feature_json(geometry_json: Column, name: str = "查询区域") -> Column:
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry_json, F.lit(f',"properties":{{"name":"{name}"}}}}'))
