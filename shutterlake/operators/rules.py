"""User-declared recipes matched against metadata documents, and the fields of a photo's panel."""

from __future__ import annotations

import tomllib
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from shutterlake.functions import scalars as S

RULES = "ord int, name string, param string, alt int, op string, s string, lo double, hi double"


def alternatives(constraint: Any) -> list[tuple[str, str | None, float | None, float | None]]:
    """(op, s, lo, hi) of each way to meet a constraint: a text, a number, a list of constraints, or {min, max}."""
    if isinstance(constraint, str):
        return [("text", constraint, None, None)]
    if isinstance(constraint, (int, float)):
        return [("number", None, float(constraint), float(constraint))]
    if isinstance(constraint, list):
        return [a for c in constraint for a in alternatives(c)]
    return [("range", None, float(constraint["min"]), float(constraint["max"]))]


def rules_frame(spark: SparkSession, recipes: list[tuple[str, dict[str, Any]]]) -> DataFrame:
    """Recipes, in order, as rows: one for each alternative of each pinned parameter; a recipe without any has one row of nulls."""
    rows = []
    for ord_, (name, params) in enumerate(recipes):
        pinned = [(ord_, name, p, i, *a) for p, c in params.items() for i, a in enumerate(alternatives(c))]
        rows += pinned or [(ord_, name, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, RULES)


def recipes_of_toml(text: str) -> list[tuple[str, dict[str, Any]]]:
    """[[recipe]] tables with a name; every other key pins a parameter."""
    return [(r["name"], {k: v for k, v in r.items() if k != "name"}) for r in tomllib.loads(text).get("recipe", [])]


def _width(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def _levels(low: Column, high: Column) -> Column:
    """The power of two that is the least width of bins of which an interval meets two at most; WIDEST for one that no bin can hold."""
    size = F.greatest(high - low, F.lit(2e-9))
    level = F.ceil(F.log2(size)).cast("int")
    return F.when(size < 1e300, level).otherwise(F.lit(WIDEST))


def indexed(rules: DataFrame) -> DataFrame:
    """rules with level, bin and folded, once for each key under which a value can meet them: a text by its folded form, a number or a range by the one or two bins of its own size that it lies in."""
    text = F.col("op") == "text"
    low, high = F.when(F.col("op") == "number", F.col("lo") - 1e-9).otherwise(F.col("lo")), F.when(F.col("op") == "number", F.col("hi") + 1e-9).otherwise(F.col("hi"))
    rows = rules.filter("param is not null").withColumn("_low", low).withColumn("_high", high).withColumn("level", F.when(text, TEXT).otherwise(_levels(low, high)).cast("int"))
    wide = F.col("level") == WIDEST
    ends = F.array_distinct(F.array(F.floor(F.col("_low") / _width(F.col("level"))), F.floor(F.col("_high") / _width(F.col("level"))))).cast("array<double>")
    bins = F.when(text | wide, F.array(F.lit(0.0))).otherwise(ends)
    return rows.withColumn("folded", F.when(text, S.ascii_lower(S.trimmed(F.col("s")))).otherwise("")).withColumn("bin", F.explode(bins)).drop("_low", "_high")


def met_keys(values: DataFrame, levels: list[int]) -> DataFrame:
    """values (param, value, ...) with number, and level, bin and folded once for each of the levels that rules have: the keys under which rules may be."""
    texts = TEXT in levels
    rows = values.withColumn("number", S.leading_number(F.col("value"))).withColumn("_folded", S.ascii_lower(S.trimmed(F.col("value"))) if texts else F.lit(""))
    keys = []
    for level in levels:
        bin_ = F.lit(0.0) if level in (TEXT, WIDEST) else F.floor(F.col("number") / _width(F.lit(level))).cast("double")
        key = F.struct(F.lit(level).alias("level"), bin_.alias("bin"), (F.col("_folded") if level == TEXT else F.lit("")).alias("folded"))
        keys.append(key if level == TEXT else F.when(F.col("number").isNotNull(), key))
    none = F.array().cast("array<struct<level:int,bin:double,folded:string>>")
    return rows.select(*values.columns, "number", F.inline(F.array_compact(F.array(*keys)) if keys else none))


def matched(metadata: DataFrame, rules: DataFrame) -> DataFrame:
    """(photo_id, first, every): for each document (photo_id, doc) the first recipe in order whose parameters all match, and all of them, comma-joined; nulls and '' without a match.

    Documents become (param, value) rows, which meet the rules that they can match: by folded text, or by bins of
    the size of the rule's range. Rules are what a user typed: more than MOST_RULES rows are refused, so that they can be
    broadcast. A recipe matches if as many of its parameters match as it pins; one that pins none matches all.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rule rows")
    document = S.parsed(F.col("doc"))
    params = F.array(*[F.struct(F.lit(p).alias("param"), S.first_of(F.col("m"), *keys).alias("value")) for p, keys in S.PARAM_KEYS.items()])
    values = metadata.select("photo_id", document.alias("m")).select("photo_id", F.explode(params).alias("v")).select("photo_id", "v.*").filter("value is not null")
    number = F.col("number")
    hit = F.when(F.col("op") == "text", F.lit(True)).when(F.col("op") == "number", F.abs(number - F.col("lo")) < 1e-9).otherwise(number.between(F.col("lo"), F.col("hi")))
    pinned = rules.groupBy("ord", "name").agg(F.count_distinct("param").alias("pinned"))
    index = indexed(rules)
    levels = sorted(r["level"] for r in index.select("level").distinct().collect())  # sizes of ranges, as powers of two
    met = met_keys(values, levels).join(F.broadcast(index), ["param", "level", "bin", "folded"]).filter(F.coalesce(hit, F.lit(False))).groupBy("photo_id", "ord").agg(F.count_distinct("param").alias("met"))
    full = met.join(F.broadcast(pinned.filter("pinned > 0")), "ord").filter("met = pinned").select("photo_id", "ord", "name")
    # recipes without parameters, as an array that each photo explodes
    every = [(r["ord"], r["name"]) for r in pinned.filter("pinned = 0").collect()]
    free = metadata.select("photo_id", F.inline(F.array(*[F.struct(F.lit(o).cast(rules.schema["ord"].dataType).alias("ord"), F.lit(n).alias("name")) for o, n in every]))) if every else full.limit(0)
    labels = full.unionByName(free).groupBy("photo_id").agg(F.min_by("name", "ord").alias("first"), F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("all"))
    return metadata.select("photo_id").join(labels, "photo_id", "left").select("photo_id", "first", F.coalesce(F.array_join(F.transform("all", lambda x: x["name"]), ","), F.lit("")).alias("every"))


#: Levels of the rule index that are no bin's width: texts, and ranges without bounds.
TEXT, WIDEST = 10_000, 10_001
#: Rows of rules, one a parameter and alternative, that a broadcast may hold.
MOST_RULES = 100_000

# fixed values: label, group, keys in order of preference, format
PANEL = [
    ("Shutter", "Exposure", ["ExifIFD:ExposureTime"], S.shutter), ("Aperture", "Exposure", ["ExifIFD:FNumber"], lambda v: F.concat(F.lit("ƒ/"), v)), ("ISO", "Exposure", ["ExifIFD:ISO"], None),
    ("Exp. comp", "Exposure", ["ExifIFD:ExposureCompensation"], lambda v: F.concat(v, F.lit(" EV"))), ("Program", "Exposure", ["ExifIFD:ExposureProgram"], None), ("Metering", "Exposure", ["ExifIFD:MeteringMode"], None), ("Flash", "Exposure", ["ExifIFD:Flash"], None),
    ("Lens", "Lens", ["ExifIFD:LensModel", "Composite:LensID"], None), ("Focal length", "Lens", ["ExifIFD:FocalLength"], None), ("35mm equiv.", "Lens", ["ExifIFD:FocalLengthIn35mmFormat"], None),
    ("Film simulation", "Film / Recipe", ["FujiFilm:FilmMode"], None), ("Dynamic range", "Film / Recipe", ["FujiFilm:DevelopmentDynamicRange", "FujiFilm:AutoDynamicRange", "FujiFilm:DynamicRangeSetting"], S.dynamic_range),
    ("White balance", "Film / Recipe", ["FujiFilm:WhiteBalance", "ExifIFD:WhiteBalance"], None), ("WB shift", "Film / Recipe", ["FujiFilm:WhiteBalanceFineTune"], None), ("Highlight tone", "Film / Recipe", ["FujiFilm:HighlightTone"], None),
    ("Shadow tone", "Film / Recipe", ["FujiFilm:ShadowTone"], None), ("Color", "Film / Recipe", ["FujiFilm:Saturation"], None), ("Sharpness", "Film / Recipe", ["FujiFilm:Sharpness"], None),
    ("Noise reduction", "Film / Recipe", ["FujiFilm:NoiseReduction", "FujiFilm:HighISONoiseReduction"], None), ("Clarity", "Film / Recipe", ["FujiFilm:Clarity"], None), ("Grain", "Film / Recipe", ["FujiFilm:GrainEffectRoughness"], None),
    ("Grain size", "Film / Recipe", ["FujiFilm:GrainEffectSize"], None), ("Color chrome", "Film / Recipe", ["FujiFilm:ColorChromeEffect"], None), ("CC FX blue", "Film / Recipe", ["FujiFilm:ColorChromeFXBlue"], None),
    ("AF area", "Autofocus", ["FujiFilm:AFAreaMode", "FujiFilm:AFMode"], None), ("Focus mode", "Autofocus", ["FujiFilm:FocusMode"], None), ("Camera focus check", "Autofocus", ["FujiFilm:FocusWarning"], None), ("Camera blur check", "Autofocus", ["FujiFilm:BlurWarning"], None),
    ("Camera", "Camera", ["IFD0:Model"], None), ("Firmware", "Camera", ["IFD0:Software"], None), ("Shutter type", "Camera", ["FujiFilm:ShutterType"], None), ("Captured", "Camera", ["ExifIFD:DateTimeOriginal", "ExifIFD:CreateDate"], None),
    ("Size", "File", ["System:FileSize", "File:FileSize"], S.megabytes), ("Dimensions", "File", ["Composite:ImageSize"], None), ("Type", "File", ["File:FileType"], None), ("Modified", "File", ["System:FileModifyDate", "File:FileModifyDate"], None),
]


def panel(metadata: DataFrame) -> DataFrame:
    """(photo_id, group, label, value, place) of every field that a document has, as the panel shows it."""
    rows = metadata.select("photo_id", S.parsed(F.col("doc")).alias("m"))
    fields = []
    for place, (label, group, keys, form) in enumerate(PANEL):
        value = S.first_of(F.col("m"), *keys)
        fields.append(F.struct(F.lit(group).alias("group"), F.lit(label).alias("label"), (form(value) if form else value).alias("value"), F.lit(place).alias("place")))
    return rows.select("photo_id", F.explode(F.array(*fields)).alias("f")).select("photo_id", "f.*").filter("value is not null")


def focus_points(metadata: DataFrame) -> DataFrame:
    """(photo_id, status, x, y, width, height, half) of each document: whether it has a focus point, where, and the patch around it."""
    rows = metadata.select("photo_id", S.parsed(F.col("doc")).alias("m"))
    at = lambda k: F.try_element_at(F.col("m"), F.lit(k)).try_cast("int")
    size = S.oriented(at("File:ImageWidth"), at("File:ImageHeight"), F.coalesce(at("IFD0:Orientation"), F.lit(1)))
    rows = rows.select("photo_id", S.focus_status(F.col("m")).alias("status"), S.focus_point(F.col("m")).alias("p"), size.alias("s"), S.by_suffix(F.col("m"), ":AFAreaPointSize").try_cast("int").alias("box"))
    return rows.select("photo_id", "status", "p.x", "p.y", "s.width", "s.height", F.when(F.col("status") == "point", S.patch_half(F.col("s.width"), F.col("s.height"), F.col("box"))).alias("half"))


def label_counts(labels: DataFrame) -> DataFrame:
    """How many photos each first label has, the most used first."""
    counts = labels.groupBy(F.coalesce("first", F.lit("__unknown__")).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("n"), "label")).cast("long"))
