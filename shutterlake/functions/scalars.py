"""Scalar functions of the catalog as Column expressions, and the same by name for Spark SQL."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F, types as T

# fixed values: recipe parameters and the metadata keys that carry them, in order of preference
PARAM_KEYS = {
    "film": ["FujiFilm:FilmMode"], "color": ["FujiFilm:Saturation"], "wb": ["FujiFilm:WhiteBalance"], "wb_shift": ["FujiFilm:WhiteBalanceFineTune"],
    "highlight": ["FujiFilm:HighlightTone"], "shadow": ["FujiFilm:ShadowTone"], "sharpness": ["FujiFilm:Sharpness"], "nr": ["FujiFilm:NoiseReduction", "FujiFilm:HighISONoiseReduction"],
    "clarity": ["FujiFilm:Clarity"], "grain": ["FujiFilm:GrainEffectRoughness"], "grain_size": ["FujiFilm:GrainEffectSize"],
    "dr": ["FujiFilm:DevelopmentDynamicRange", "FujiFilm:AutoDynamicRange"], "chrome": ["FujiFilm:ColorChromeEffect"], "chrome_blue": ["FujiFilm:ColorChromeFXBlue"],
}


def trimmed(text: Column) -> Column:
    """text without white space, of any alphabet's kind, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leading_number(text: Column) -> Column:
    """The signed number at the head of a text; null if there is none."""
    return F.regexp_extract(trimmed(text), r"^[+-]?[0-9.]*", 0).try_cast("double")


def same_text(a: Column, b: Column) -> Column:
    """Equality of trimmed texts, ASCII case apart."""
    return ascii_lower(trimmed(a)) == ascii_lower(trimmed(b))


def same_number(a: Column, b: Column) -> Column:
    return F.abs(a - b) < 1e-9


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def kind_of(name: Column) -> Column:
    """jpeg, raf, or null for other files."""
    return F.when(extension(name).isin("jpg", "jpeg"), "jpeg").when(extension(name) == "raf", "raf")


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def photo_id(path: Column) -> Column:
    """16 hex digits of a path's hash."""
    return F.lpad(F.lower(F.hex(F.xxhash64(path))), 16, "0")


def normalized_name(name: Column) -> Column:
    """Trimmed, lower case; null if nothing is left."""
    return F.nullif(F.lower(trimmed(name)), F.lit(""))


def xmp_rating(text: Column) -> Column:
    """The rating in an XMP text, as an attribute or else as an element; null outside 0 to 5."""
    forms = [F.regexp_extract(text, p, 1) for p in (r'xmp:Rating="(\d+)"', r"<xmp:Rating>(\d+)</xmp:Rating>")]
    value = F.coalesce(*[F.nullif(x, F.lit("")) for x in forms]).try_cast("int")
    return F.when(value.between(0, 5), value)


def xml_escaped(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c[0]), F.lit(c[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")], text)


def xmp_packet(rating: Column, tags: Column) -> Column:
    """A minimal XMP packet that carries a rating and tags."""
    items = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("<rdf:li>"), xml_escaped(t), F.lit("</rdf:li>"))), "")
    subject = F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, F.concat(F.lit("<dc:subject><rdf:Bag>"), items, F.lit("</rdf:Bag></dc:subject>"))).otherwise("")
    return F.concat(F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmp:Rating="'), rating.cast("string"), F.lit('">'), subject, F.lit("</rdf:Description></rdf:RDF></x:xmpmeta>"))


def hex_colour(text: Column) -> Column:
    """The three bytes of #rrggbb; null for anything else."""
    part = lambda i: F.conv(F.substring(text, i, 2), 16, 10).cast("int")
    return F.when(text.rlike("^#[0-9A-Fa-f]{6}$"), F.array(part(2), part(4), part(6)))


def is_artifact(name: Column) -> Column:
    """Names of derived face images: 16 hex digits, -f, a number, a revision if any, .jpg or a temporary file's ending."""
    return name.rlike(r"^[0-9a-f]{16}-f\d+(r\d+)?\.(jpg|tmp.*)$")


def clipping_fingerprint(highlight: Column, shadow: Column, highlight_colour: Column, shadow_colour: Column) -> Column:
    """One string that changes when any clipping setting does."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x), 2, "0")), ", "), F.lit("]"))
    return F.concat_ws("-", highlight.cast("string"), shadow.cast("string"), listed(highlight_colour), listed(shadow_colour))


def shutter(text: Column) -> Column:
    n = text.try_cast("double")
    return F.when(n.isNull(), F.concat(text, F.lit("s"))).when(n >= 1, F.concat(text, F.lit("s"))).otherwise(F.concat(F.lit("1/"), F.floor(1 / n + 0.5).cast("string"), F.lit("s")))


def dynamic_range(text: Column) -> Column:
    return F.when(text.rlike(r"^\d+$"), F.concat(F.lit("DR"), text)).when(text.endswith("%"), F.concat(F.lit("Auto (DR"), F.substring(text, F.lit(1), F.length(text) - 1), F.lit(")"))).otherwise(text)


def megabytes(text: Column) -> Column:
    n = text.try_cast("double")
    return F.when(n.isNull(), text).otherwise(F.format_string("%.2f MB", n / 1048576))


def capture_ms(taken: Column, subseconds: Column, mtime_s: Column) -> Column:
    """Epoch milliseconds of YYYY:MM:DD HH:MM:SS with sub-second digits, read as if in UTC; else the file's seconds."""
    parts = [F.regexp_extract(taken, r"^(\d{4}):(\d\d):(\d\d) (\d\d):(\d\d):(\d\d)", i).try_cast("int") for i in range(1, 7)]
    day = F.concat_ws("-", *[F.regexp_extract(taken, r"^(\d{4}):(\d\d):(\d\d) ", i) for i in (1, 2, 3)])
    days = F.unix_date(day.try_cast("date")).cast("long")
    ms = F.rpad(F.substring(F.regexp_replace(F.coalesce(subseconds, F.lit("")), r"\D", ""), 1, 3), 3, "0").cast("long")
    return F.coalesce(((days * 24 + parts[3]) * 3600 + parts[4] * 60 + parts[5]).cast("long") * 1000 + ms, mtime_s * 1000)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    return F.unix_date(F.make_date(y, m, d))


def oriented(width: Column, height: Column, orientation: Column) -> Column:
    """(width, height) as displayed."""
    turned = orientation.between(5, 8)
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def oriented_point(x: Column, y: Column, orientation: Column) -> Column:
    """A normalized sensor point as displayed, for the eight EXIF orientations."""
    o = F.coalesce(orientation, F.lit(1))
    px = F.when(o.isin(2, 3), 1 - x).when(o.isin(5, 8), y).when(o.isin(6, 7), 1 - y).otherwise(x)
    py = F.when(o.isin(3, 4), 1 - y).when(o.isin(5, 6), x).when(o.isin(7, 8), 1 - x).otherwise(y)
    return F.struct(px.alias("x"), py.alias("y"))


def by_suffix(document: Column, suffix: str) -> Column:
    """The value of the first key, in alphabetical order, that ends with suffix."""
    hits = F.map_filter(document, lambda k, v: k.endswith(suffix))
    return F.element_at(hits, F.try_element_at(F.array_sort(F.map_keys(hits)), F.lit(1)))


def focus_point(document: Column) -> Column:
    """The autofocus point as displayed, 0 to 1; null without pixel or dimensions."""
    pixel = F.split(F.trim(F.coalesce(by_suffix(document, ":FocusPixel"), F.try_element_at(document, F.lit("FocusPixel")))), r"\s+")
    at = lambda i: F.try_element_at(pixel, F.lit(i)).try_cast("double")
    size = lambda side: F.coalesce(*[F.try_element_at(document, F.lit(k)).try_cast("double") for k in (f"File:Image{side}", f"File:Image {side}")])
    unit = lambda v, of: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / of))
    w, h = size("Width"), size("Height")
    known = at(1).isNotNull() & at(2).isNotNull() & (w > 0) & (h > 0)
    return F.when(known, oriented_point(unit(at(1), w), unit(at(2), h), F.try_element_at(document, F.lit("IFD0:Orientation")).try_cast("int")))


def focus_status(document: Column) -> Column:
    """manual, tracking, no_af, or point: whether a photo has an autofocus point to score."""
    manual = F.lower(by_suffix(document, ":FocusMode")).contains("manual")
    return F.when(manual, "manual").when(by_suffix(document, ":AFAreaMode").contains("Tracking"), "tracking").when(focus_point(document).isNull(), "no_af").otherwise("point")


def patch_half(width: Column, height: Column, point_size: Column) -> Column:
    """Half the edge of the patch whose sharpness is measured."""
    long = F.greatest(width, height)
    size = F.when(point_size.between(1, 6), point_size).otherwise(3)
    return F.least(F.greatest(F.floor(long * 0.026 * (size / 3)), F.lit(24)), F.greatest(F.floor(long * 0.05), F.lit(24))).cast("long")


def square_crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """(x, y, side) in pixels of a square with a quarter's margin around a normalized box, inside the image."""
    side = F.least(F.greatest(F.greatest(w * width, h * height) * 1.5, F.lit(1.0)), width.cast("double"), height.cast("double"))
    inside = lambda centre, of: F.greatest(F.lit(0.0), F.least(centre - side / 2, of - side))
    return F.struct(F.floor(inside((x + w / 2) * width, width)).alias("x"), F.floor(inside((y + h / 2) * height, height)).alias("y"), F.floor(side).alias("side"))


def letterbox(width: Column, height: Column, edge: int = 640) -> Column:
    """Scale and scaled size of an image that has to fit a square."""
    scale = F.least(edge / width, edge / height)
    fit = lambda v: F.least(F.lit(edge), F.greatest(F.lit(1), F.floor(v * scale + 0.5))).cast("int")
    return F.struct(scale.alias("scale"), fit(width).alias("width"), fit(height).alias("height"))


def from_letterbox(x: Column, y: Column, w: Column, h: Column, scale: Column, width: Column, height: Column) -> Column:
    """A box in letterbox pixels as a normalized box of the image."""
    clip = lambda v, of: F.greatest(F.lit(0.0), F.least(v / scale, of.cast("double")))
    left, top = clip(x, width), clip(y, height)
    return F.struct((left / width).alias("x"), (top / height).alias("y"), (F.least(w / scale, width - left) / width).alias("w"), (F.least(h / scale, height - top) / height).alias("h"))


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes x, y, w, h in two prefixed column sets; 0 if the union is empty."""
    c = lambda p, n: F.col(f"{p}{n}")
    over = lambda p, s: F.greatest(F.lit(0.0), F.least(c(a, p) + c(a, s), c(b, p) + c(b, s)) - F.greatest(c(a, p), c(b, p)))
    both = over("x", "w") * over("y", "h")
    union = c(a, "w") * c(a, "h") + c(b, "w") * c(b, "h") - both
    return F.when(union > 0, both / union).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one of them has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 1e-12, dot(a, b) / size).otherwise(0.0)


def l2_normalized(a: Column) -> Column:
    size = F.sqrt(dot(a, a))
    return F.when(size > 1e-12, F.transform(a, lambda x: x / size)).otherwise(a.cast("array<double>"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.least(F.lit(255), F.floor(0.2126 * r + 0.7152 * g + 0.0722 * b + 0.5)).cast("int")


def first_of(document: Column, *keys: str) -> Column:
    """The first value of these keys that is not empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(document, F.lit(k)), F.lit("")) for k in keys])


def parsed(doc: Column) -> Column:
    """A metadata document as a map of texts; null or unreadable: empty."""
    return F.coalesce(F.from_json(doc, "map<string,string>"), F.create_map().cast("map<string,string>"))


def has_metadata(document: Column) -> Column:
    return F.size(document) > 1


def payload(kind: Column, text: Column) -> Column:
    """An action's payload: numbers of a rating, texts of tags, both null for others."""
    rate, tags = F.from_json(text, "from int, to int"), F.from_json(text, "from array<string>, to array<string>")
    return F.struct(F.when(kind == "rate", rate).alias("rate"), F.when(kind == "tags", tags).alias("tags"))


def tags_of(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def toggled(tags: Column, tag: Column) -> Column:
    own = F.coalesce(tags, F.array().cast("array<string>"))
    return F.when(F.array_contains(own, tag), F.array_remove(own, tag)).otherwise(F.array_append(own, tag))


def guarded(value: Column, low: float, high: float, default: float) -> Column:
    return F.when(value.between(low, high), value).otherwise(default)


def glass_time(draw_ms: Column, glass_ms: Column, hidden: Column) -> Column:
    """(latency, occluded): the time on screen where the page was visible and it came within a second, else the draw time."""
    seen = ~hidden & (glass_ms - draw_ms <= 1000)
    return F.struct(F.when(seen, glass_ms).otherwise(draw_ms).alias("latency_ms"), (~seen).alias("occluded"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def floats_of(blobs: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of 512-byte blobs; null for other lengths."""
    return blobs.map(lambda b: np.frombuffer(b, "<f4") if b is not None and len(b) == 512 else None)


@F.pandas_udf(T.BinaryType())
def blob_of(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: np.asarray(v, "<f4").tobytes() if v is not None else None)


#: SQL functions: name and parameters, type, body; each says what the Column function named in TWINS says.
SQL_FUNCTIONS = [
    ("trimmed(text STRING)", "STRING", r"regexp_replace(text, r'(?U)^\s+|\s+$', '')"),
    ("leading_number(text STRING)", "DOUBLE", r"try_cast(regexp_extract(trimmed(text), r'^[+-]?[0-9.]*', 0) AS DOUBLE)"),
    ("ascii_folded(text STRING)", "STRING", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"),
    ("same_text(a STRING, b STRING)", "BOOLEAN", "ascii_folded(trimmed(a)) = ascii_folded(trimmed(b))"),
    ("same_number(a DOUBLE, b DOUBLE)", "BOOLEAN", "abs(a - b) < 1e-9"),
    ("file_extension(name STRING)", "STRING", r"lower(regexp_extract(name, r'\.([^.]*)$', 1))"),
    ("catalog_kind(name STRING)", "STRING", "CASE WHEN file_extension(name) IN ('jpg', 'jpeg') THEN 'jpeg' WHEN file_extension(name) = 'raf' THEN 'raf' END"),
    ("catalog_stem(name STRING)", "STRING", r"regexp_replace(name, r'\.[^.]*$', '')"),
    ("photo_id(path STRING)", "STRING", "lpad(lower(hex(xxhash64(path))), 16, '0')"),
    ("catalog_name(name STRING)", "STRING", "nullif(lower(trimmed(name)), '')"),
    ("xmp_number(text STRING)", "INT", r"""try_cast(coalesce(nullif(regexp_extract(text, r'xmp:Rating="(\d+)"', 1), ''), nullif(regexp_extract(text, r'<xmp:Rating>(\d+)</xmp:Rating>', 1), '')) AS INT)"""),
    ("xmp_rating(text STRING)", "INT", "CASE WHEN xmp_number(text) BETWEEN 0 AND 5 THEN xmp_number(text) END"),
    ("xml_escape(text STRING)", "STRING", "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"),
    ("hex_colour(text STRING)", "ARRAY<INT>", "CASE WHEN text RLIKE '^#[0-9A-Fa-f]{6}$' THEN transform(array(2, 4, 6), i -> CAST(conv(substring(text, i, 2), 16, 10) AS INT)) END"),
    ("is_artifact(name STRING)", "BOOLEAN", r"name RLIKE r'^[0-9a-f]{16}-f\d+(r\d+)?\.(jpg|tmp.*)$'"),
    ("colour_listed(c ARRAY<INT>)", "STRING", "concat('[', array_join(transform(c, x -> lpad(hex(x), 2, '0')), ', '), ']')"),
    ("clipping_fingerprint(h INT, s INT, hc ARRAY<INT>, sc ARRAY<INT>)", "STRING", "concat_ws('-', CAST(h AS STRING), CAST(s AS STRING), colour_listed(hc), colour_listed(sc))"),
    ("shutter(text STRING)", "STRING", "CASE WHEN try_cast(text AS DOUBLE) < 1 THEN concat('1/', CAST(floor(1 / try_cast(text AS DOUBLE) + 0.5D) AS STRING), 's') ELSE concat(text, 's') END"),
    ("dynamic_range(text STRING)", "STRING", r"CASE WHEN text RLIKE r'^\d+$' THEN concat('DR', text) WHEN endswith(text, '%') THEN concat('Auto (DR', substring(text, 1, length(text) - 1), ')') ELSE text END"),
    ("megabytes(text STRING)", "STRING", "CASE WHEN try_cast(text AS DOUBLE) IS NULL THEN text ELSE format_string('%.2f MB', try_cast(text AS DOUBLE) / 1048576) END"),
    ("days_from_civil(y INT, m INT, d INT)", "INT", "unix_date(make_date(y, m, d))"),
    ("oriented(width INT, height INT, orientation INT)", "STRUCT<width: INT, height: INT>", "CASE WHEN orientation BETWEEN 5 AND 8 THEN named_struct('width', height, 'height', width) ELSE named_struct('width', width, 'height', height) END"),
    ("oriented_point(x DOUBLE, y DOUBLE, o INT)", "STRUCT<x: DOUBLE, y: DOUBLE>", "named_struct('x', CASE WHEN o IN (2, 3) THEN 1 - x WHEN o IN (5, 8) THEN y WHEN o IN (6, 7) THEN 1 - y ELSE x END, 'y', CASE WHEN o IN (3, 4) THEN 1 - y WHEN o IN (5, 6) THEN x WHEN o IN (7, 8) THEN 1 - x ELSE y END)"),
    ("patch_half(width INT, height INT, point_size INT)", "BIGINT", "CAST(least(greatest(floor(greatest(width, height) * 0.026D * (CASE WHEN point_size BETWEEN 1 AND 6 THEN point_size ELSE 3 END / 3)), 24), greatest(floor(greatest(width, height) * 0.05D), 24)) AS BIGINT)"),
    ("luma(r DOUBLE, g DOUBLE, b DOUBLE)", "INT", "CAST(least(255, floor(0.2126D * r + 0.7152D * g + 0.0722D * b + 0.5D)) AS INT)"),
    ("has_metadata(document MAP<STRING, STRING>)", "BOOLEAN", "size(document) > 1"),
    ("tags_of(text STRING)", "ARRAY<STRING>", "coalesce(from_json(text, 'array<string>'), CAST(array() AS ARRAY<STRING>))"),
    ("toggled(tags ARRAY<STRING>, tag STRING)", "ARRAY<STRING>", "CASE WHEN array_contains(coalesce(tags, CAST(array() AS ARRAY<STRING>)), tag) THEN array_remove(tags, tag) ELSE array_append(coalesce(tags, CAST(array() AS ARRAY<STRING>)), tag) END"),
    ("guarded(value DOUBLE, low DOUBLE, high DOUBLE, fallback DOUBLE)", "DOUBLE", "CASE WHEN value BETWEEN low AND high THEN value ELSE fallback END"),
    ("vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, v) -> s + v)"),
    ("vector_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)", "DOUBLE", "CASE WHEN sqrt(vector_dot(a, a)) * sqrt(vector_dot(b, b)) > 1e-12 THEN vector_dot(a, b) / (sqrt(vector_dot(a, a)) * sqrt(vector_dot(b, b))) ELSE 0.0D END"),
    ("glass_time(draw_ms DOUBLE, glass_ms DOUBLE, hidden BOOLEAN)", "STRUCT<latency_ms: DOUBLE, occluded: BOOLEAN>", "named_struct('latency_ms', CASE WHEN NOT hidden AND glass_ms - draw_ms <= 1000 THEN glass_ms ELSE draw_ms END, 'occluded', NOT (NOT hidden AND glass_ms - draw_ms <= 1000))"),
    ("rate_payload(kind STRING, text STRING)", "STRUCT<`from`: INT, `to`: INT>", "CASE WHEN kind = 'rate' THEN from_json(text, 'from int, to int') END"),
]
#: SQL functions whose Column function has another name; helpers of others have none.
TWINS = {"file_extension": "extension", "catalog_kind": "kind_of", "catalog_stem": "stem_of", "catalog_name": "normalized_name", "xml_escape": "xml_escaped", "ascii_folded": "ascii_lower", "vector_dot": "dot", "vector_cosine": "cosine"}


def register(spark: SparkSession) -> None:
    """The scalars that Spark SQL can call by name, as SQL functions of the session."""
    for head, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
