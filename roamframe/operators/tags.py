"""Kinds of buildings and places from map tags, as Column expressions. The lookup tables are parameters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags in the order in which they are asked after building and amenity; an unknown value of the marked ones ends the search.
ORDER = {"leisure": True, "landuse": True, "tourism": False, "shop": True, "office": False, "healthcare": False, "craft": False}
#: An address, and the height in metres under which a plain building with signs of dwelling is taken for a home.
ADDRESS = ("addr:housenumber", "addr:housename", "addr:unit")
HOME_HEIGHT = 20
PARKING, UNKNOWN, RESIDENTIAL = "parking", "unknown", "residential"


def values(tag: Column) -> Column:
    """The values of a tag, lower-cased, that ; | or , separate; none for null."""
    parts = F.transform(F.split(F.regexp_replace(F.lower(tag), r"[|,]", ";"), ";"), lambda v: F.trim(v))
    return F.coalesce(F.filter(parts, lambda v: v != ""), F.array().cast("array<string>"))


def _table(entries: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv]) if entries else F.create_map().cast("map<string,string>")


def classify(features: DataFrame, subtypes: Mapping[str, Mapping[str, str]], categories: Mapping[str, str], default: str = "other", infer_homes: bool = False) -> DataFrame:
    """features with osm_type, subtype, category, subtype_2 and subtype_3.

    subtypes: by tag the subtype of each value; categories: by subtype. A building's own kind goes before amenities, of which one that is no parking goes before
    parking, and these before the tags of ORDER. Missing tag columns count as null. infer_homes takes low plain buildings with signs of dwelling for homes.
    The further subtypes are the first two other ones among the amenities, parking not counted.
    """
    kind = "struct<osm_type:string,subtype:string>"
    tag = lambda name: F.col(f"`{name}`").cast("string") if name in features.columns else F.lit(None).cast("string")
    one = lambda name: F.trim(F.lower(tag(name)))
    found = lambda value, subtype: F.struct(value.alias("osm_type"), subtype.alias("subtype")).cast(kind)
    known = lambda value, table: F.when(table[value].isNotNull(), found(value, table[value]))
    building, amenities = one("building"), values(tag("amenity"))
    buildings, places = _table({k: v for k, v in subtypes.get("building", {}).items() if k != "yes"} | {PARKING: PARKING}), _table(subtypes.get("amenity", {}))
    good = F.filter(amenities, lambda a: places[a].isNotNull() & (places[a] != PARKING))
    answers = [
        known(building, buildings),
        F.when(F.size(good) > 0, found(good[0], places[good[0]])),
        F.when(F.array_contains(amenities, PARKING), found(F.lit(PARKING), F.lit(PARKING))),
    ]
    for name, ends in ORDER.items():
        answers.append(known(one(name), _table(subtypes.get(name, {}))))
        if ends:
            answers.append(F.when(tag(name).isNotNull(), found(one(name), F.lit(UNKNOWN))))
    if infer_homes:
        signs = (one("landuse") == RESIDENTIAL) | one("building:use").contains(RESIDENTIAL)
        signs = F.coalesce(signs, F.lit(False)) | F.coalesce(*[tag(a) for a in ADDRESS]).isNotNull()
        low = F.coalesce(tag("height").try_cast("double") < HOME_HEIGHT, F.lit(False))
        answers.append(F.when(building == "yes", found(F.lit("yes"), F.when(signs & low & tag("amenity").isNull(), F.lit(RESIDENTIAL)).otherwise(F.lit(UNKNOWN)))))
    answer = F.coalesce(*answers, found(F.lit(UNKNOWN), F.lit(UNKNOWN)))
    out = features.withColumns({"osm_type": answer["osm_type"], "subtype": answer["subtype"]})
    more = F.array_distinct(F.filter(F.transform(good, lambda a: places[a]), lambda s: s != F.col("subtype")))
    return out.withColumns({"category": F.coalesce(_table(categories)[F.col("subtype")], F.lit(default)), "subtype_2": F.get(more, F.lit(0)), "subtype_3": F.get(more, F.lit(1))})


def summary(features: DataFrame, by: str = "category") -> DataFrame:
    """Features by category, or by another column such as subtype."""
    return features.groupBy(by).agg(F.count("*").alias("n"))
