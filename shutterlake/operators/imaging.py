"""Analytics over rasters: histograms, clipping, sharpness, transforms, and the per-image batch jobs.

Pixels come in long form (photo_id, x, y, r, g, b) for SQL, or as Spark's image rows for the batch jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from shutterlake.functions import scalars as S

HIGHLIGHT, SHADOW, BLOCK = 250, 5, 4
#: Pixels along a tile's side.
TILE = 64


def histograms(pixels: DataFrame) -> DataFrame:
    """(photo_id, channel, bin, n): counts of red, green, blue and luma, of bins that occur."""
    luma = S.luma(F.col("r"), F.col("g"), F.col("b"))
    rows = pixels.select("photo_id", F.explode(F.create_map(F.lit("r"), F.col("r").cast("int"), F.lit("g"), F.col("g").cast("int"), F.lit("b"), F.col("b").cast("int"), F.lit("luma"), luma)).alias("channel", "bin"))
    return rows.groupBy("photo_id", "channel", "bin").agg(F.count("*").alias("n"))


def smoothed(counts: DataFrame, bins: int = 256) -> DataFrame:
    """Histograms with every bin, smoothed over five bins (fewer at the edges), and scaled by the largest interior one, 1 at most."""
    keys = counts.select("photo_id", "channel").distinct().select("photo_id", "channel", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = keys.join(counts, ["photo_id", "channel", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = W.partitionBy("photo_id", "channel")
    smooth = full.withColumn("smooth", F.avg("n").over(own.orderBy("bin").rowsBetween(-2, 2)))
    top = F.greatest(F.lit(1.0), F.max(F.when(F.col("bin").between(2, bins - 3), F.col("smooth"))).over(own))
    return smooth.withColumn("scaled", F.least(F.lit(1.0), F.col("smooth") / top))


def clipping(pixels: DataFrame, highlight: int = HIGHLIGHT, shadow: int = SHADOW, block: int = BLOCK) -> DataFrame:
    """(photo_id, bx, by, kind) of blocks with a clipped pixel: 1 for highlights (any channel), 2 for shadows (all channels), whichever is last in raster order. Pixels past the last whole block count to it."""
    kind = F.when(F.greatest("r", "g", "b") >= highlight, 1).when(F.greatest("r", "g", "b") <= shadow, 2)
    sizes = pixels.groupBy("photo_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    rows = pixels.withColumn("kind", kind).filter("kind is not null").join(sizes, "photo_id")
    at = lambda c, size: F.least(F.floor(F.col(c) / block), F.greatest(F.floor(F.col(size) / block), F.lit(1)) - 1).cast("int")
    return rows.groupBy("photo_id", at("x", "w").alias("bx"), at("y", "h").alias("by")).agg(F.max_by("kind", F.col("y") * F.col("w") + F.col("x")).alias("kind"))


def clipped_share(pixels: DataFrame, highlight: int = HIGHLIGHT, shadow: int = SHADOW) -> DataFrame:
    high, low = F.greatest("r", "g", "b") >= highlight, F.greatest("r", "g", "b") <= shadow
    return pixels.groupBy("photo_id").agg((F.count_if(high) / F.count("*")).alias("highlights"), (F.count_if(low & ~high) / F.count("*")).alias("shadows"))


def tiled(pixels: DataFrame, value: str, tile: int = TILE) -> DataFrame:
    """(photo_id, tx, ty, x, y, v): pixels dealt to tiles with a border of one pixel: those at a tile's edge are in the next tile too, as its neighbours. About 1 + 4 / tile rows a pixel."""
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    tx, ty, n = F.floor(x / tile), F.floor(y / tile), F.lit(tile)
    at = lambda dx, dy: F.struct((tx + dx).cast("long").alias("tx"), (ty + dy).cast("long").alias("ty"))
    edges = [(F.pmod(x, n) == 0, -1, 0), (F.pmod(x, n) == tile - 1, 1, 0), (F.pmod(y, n) == 0, 0, -1), (F.pmod(y, n) == tile - 1, 0, 1)]
    places = F.array_compact(F.array(at(0, 0), *[F.when(edge, at(dx, dy)) for edge, dx, dy in edges]))
    return pixels.select("photo_id", F.inline(places), x.alias("x"), y.alias("y"), F.col(value).cast("double").alias("v"))


def _laplacians(tiles: np.ndarray, x: np.ndarray, y: np.ndarray, v: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of tiles, Laplacians) of those pixels of their own tile that have all four neighbours there. tiles: the number of each pixel's tile; x, y: from 0 within the bordered tile."""
    side = int(max(x.max(), y.max())) + 3
    key = (tiles * side + y + 1) * side + x + 1
    order = np.argsort(key, kind="stable")
    key, v, own, tiles = key[order], v[order], own[order], tiles[order]
    total, whole = -4 * v, own.copy()
    for step in (1, -1, side, -side):
        at = np.minimum(np.searchsorted(key, key + step), len(key) - 1)
        whole &= key[at] == key + step
        total = total + v[at]
    return tiles[whole], total[whole]


def sharpness(pixels: DataFrame, value: str = "val", tile: int = TILE) -> DataFrame:
    """(photo_id, score, n): the population variance of the 4-neighbour Laplacian over interior pixels, n of them.

    One numpy pass over each bordered tile; tiles give moments, which are merged by image. A task holds a batch and one tile.
    """
    rows = tiled(pixels, value, tile)
    schema = f"photo_id {rows.schema['photo_id'].dataType.simpleString()}, n long, s double, m2 double"

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(t: pa.Table) -> pa.RecordBatch:
            tx, ty, x, y, v = (t.column(c).to_numpy() for c in ("tx", "ty", "x", "y", "v"))
            photos = t.column("photo_id").combine_chunks()
            first = np.flatnonzero(np.concatenate([[True], (tx[1:] != tx[:-1]) | (ty[1:] != ty[:-1]) | changed(photos)]))
            number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(tx))))
            own = (x // tile == tx) & (y // tile == ty)
            of, lap = _laplacians(number, x - tx * tile + 1, y - ty * tile + 1, v, own)
            n, s = np.bincount(of, minlength=len(first)), np.bincount(of, weights=lap, minlength=len(first))
            m2 = np.bincount(of, weights=(lap - (s / np.maximum(n, 1))[of]) ** 2, minlength=len(first))
            return pa.RecordBatch.from_arrays([photos.take(pa.array(first)), pa.array(n, pa.int64()), pa.array(s.astype(float)), pa.array(m2.astype(float))], ["photo_id", "n", "s", "m2"])

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows:
                # all but the last tile, which may go on
                last = [held.column(c)[-1] for c in ("photo_id", "tx", "ty")]
                same = pc.and_(pc.and_(pc.equal(held.column("tx"), last[1]), pc.equal(held.column("ty"), last[2])), pc.equal(held.column("photo_id"), last[0]) if last[0].is_valid else pc.is_null(held.column("photo_id")))
                whole = held.num_rows - int(pc.sum(pc.fill_null(same, False)).as_py())
                if whole:
                    yield given(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield given(held)

    parts = rows.repartition("photo_id", "tx", "ty").sortWithinPartitions("photo_id", "tx", "ty").mapInArrow(told, schema)
    sums = parts.groupBy("photo_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("m2") + F.when(F.col("n") > 0, F.col("s") * F.col("s") / F.col("n")).otherwise(0.0)).alias("q"))
    score = F.when(F.col("n") > 0, F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.col("n"))).otherwise(0.0)
    return sums.select("photo_id", score.alias("score"), "n")


def changed(values: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it, from the second on."""
    a, b = values.slice(1), values.slice(0, len(values) - 1)
    return pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False).astype(bool) | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))


def similarity_fit(points: DataFrame, key: str) -> DataFrame:
    """(key, a, b, tx, c, d, ty): the least-squares rotation, scale and shift that takes the points (x, y) to (u, v); the shift alone where all points coincide."""
    sums = points.groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("u").alias("mu"), F.avg("v").alias("mv"), *[F.covar_pop(p, q).alias(p + q) for p in "xy" for q in "uv"], (F.var_pop("x") + F.var_pop("y")).alias("var"))
    flat = F.col("var") <= 1e-7
    p = F.when(flat, 1.0).otherwise((F.col("xu") + F.col("yv")) / F.col("var"))
    q = F.when(flat, 0.0).otherwise((F.col("xv") - F.col("yu")) / F.col("var"))
    return sums.select(key, p.alias("a"), (-q).alias("b"), (F.col("mu") - (p * F.col("mx") - q * F.col("my"))).alias("tx"), q.alias("c"), p.alias("d"), (F.col("mv") - (q * F.col("mx") + p * F.col("my"))).alias("ty"))


def raster(image: pd.Series | dict) -> np.ndarray:
    """An image row of Spark's reader as height x width x 3, red first."""
    data = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])
    return np.repeat(data, 3, 2) if image["nChannels"] == 1 else data[:, :, 2::-1]


def laplacian_variance(rgb: np.ndarray, cx: int, cy: int, half: int) -> float:
    """Sharpness of the square patch around a point, moved inside the image; 0 for tiny images."""
    h, w = rgb.shape[:2]
    if w < 4 or h < 4:
        return 0.0
    side = min(2 * half, w - 2, h - 2)
    x0, y0 = max(1, min(max(0, cx - half), w - 2 - side)), max(1, min(max(0, cy - half), h - 2 - side))
    grey = rgb[y0 - 1 : y0 + side + 1, x0 - 1 : x0 + side + 1].astype(np.float64).mean(2)
    lap = grey[1:-1, :-2] + grey[1:-1, 2:] + grey[:-2, 1:-1] + grey[2:, 1:-1] - 4 * grey[1:-1, 1:-1]
    return float(lap.var())


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images under a path: origin, width, height and the raster, by Spark's own reader."""
    return spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(path).select("image.*")


def exposure_job(rows: DataFrame) -> DataFrame:
    """(origin, red, green, blue, luma, highlights, shadows, mask_width, mask): histograms, clipped shares and the mask of clipped blocks of each image, one decode for all.

    mask: row by row one number a block, 0 for none, 1 for highlights, 2 for shadows, of the block's clipped pixels the last in raster order.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for _, row in batch.iterrows():
                rgb = raster(row)
                grey = np.minimum(255, np.floor(rgb @ np.array([0.2126, 0.7152, 0.0722]) + 0.5)).astype(int)
                counts = [np.bincount(rgb[:, :, c].ravel(), minlength=256) for c in range(3)] + [np.bincount(grey.ravel(), minlength=256)]
                top = rgb.max(2)
                out.append((row["origin"], *[c.tolist() for c in counts], float((top >= HIGHLIGHT).mean()), float((top <= SHADOW).mean()), *clipping_mask(top)))
            yield pd.DataFrame(out, columns=["origin", "red", "green", "blue", "luma", "highlights", "shadows", "mask_width", "mask"])

    return rows.mapInPandas(run, "origin string, red array<long>, green array<long>, blue array<long>, luma array<long>, highlights double, shadows double, mask_width int, mask array<int>")


def clipping_mask(top: np.ndarray, block: int = BLOCK) -> tuple[int, list[int]]:
    """(blocks in a row, kinds of all blocks) from each pixel's brightest channel. Pixels past the last whole block count to it."""
    h, w = top.shape
    columns, lines = max(1, w // block), max(1, h // block)
    y, x = np.nonzero((top >= HIGHLIGHT) | (top <= SHADOW))  # in raster order
    at = np.minimum(y // block, lines - 1) * columns + np.minimum(x // block, columns - 1)
    last = np.full(lines * columns, -1)
    np.maximum.at(last, at, y * w + x)
    seen = last >= 0
    mask = np.zeros(lines * columns, int)
    mask[seen] = np.where(top.ravel()[last[seen]] >= HIGHLIGHT, 1, 2)
    return columns, mask.tolist()


def focus_job(rows: DataFrame, points: DataFrame) -> DataFrame:
    """(origin, status, score): sharpness at the focus point of each image; points: (origin, status, x, y, half)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = []
            for _, row in batch.iterrows():
                rgb = raster(row) if row["status"] == "point" else None
                scores.append(None if rgb is None else laplacian_variance(rgb, int(row["x"] * rgb.shape[1]), int(row["y"] * rgb.shape[0]), int(row["half"])))
            yield pd.DataFrame({"origin": batch["origin"], "status": batch["status"].replace("point", "ok"), "score": scores})

    return rows.join(points, "origin").mapInPandas(run, "origin string, status string, score double")


def scaled(rgb: np.ndarray, height: int, width: int) -> np.ndarray:
    """The raster at another size, each pixel the nearest one."""
    y, x = (np.arange(height) * rgb.shape[0]) // height, (np.arange(width) * rgb.shape[1]) // width
    return rgb[y][:, x]


def embed_job(rows: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int, shape: tuple[int, int] = (112, 112), batch_size: int = 64) -> DataFrame:
    """(origin, embedding): a user's model over each image, loaded once a worker; vectors of length 1, of size numbers.

    make_model gives a function from images x height x width x 3 numbers, batch_size images at most, to images x size numbers. Images are scaled to shape before.
    """
    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rasters = [scaled(raster(dict(zip(batch.columns, row))), *shape).ravel().astype(np.float32).tolist() for row in batch.itertuples(index=False)]
            yield pd.DataFrame({"origin": batch["origin"], "raster": rasters})

    def make() -> Callable[[np.ndarray], np.ndarray]:
        model = make_model()

        def predict(images: np.ndarray) -> np.ndarray:
            v = np.asarray(model(images), np.float32).reshape(len(images), -1)[:, :size]
            return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

        return predict

    embed = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=[[*shape, 3]])
    return rows.mapInPandas(decoded, "origin string, raster array<float>").select("origin", embed("raster").alias("embedding"))


def photo_metadata_job(metadata: DataFrame, rows: DataFrame) -> DataFrame:
    """(photo_id, capture_ms, width, height): capture time of each document and its image's displayed size; rows: (photo_id, width, height, mtime)."""
    m = metadata.select("photo_id", S.parsed(F.col("doc")).alias("m")).join(rows, "photo_id")
    at = lambda *k: S.first_of(F.col("m"), *k)
    size = S.oriented(F.col("width"), F.col("height"), F.coalesce(at("IFD0:Orientation").try_cast("int"), F.lit(1)))
    return m.select("photo_id", S.capture_ms(at("ExifIFD:DateTimeOriginal", "ExifIFD:CreateDate"), at("ExifIFD:SubSecTimeOriginal"), F.col("mtime")).alias("capture_ms"), size.alias("s")).select("photo_id", "capture_ms", "s.*")
