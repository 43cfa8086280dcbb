"""Pages as images, through outside engines that the caller brings: documents to pages, pages to words, two-column pages once more column by column."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qforge.operators import layout
from qforge.sources.external import fanned
from qforge.storage import settled

BOX = "line_id int, left double, right double, top double, bottom double, text string"

Words = Callable[[bytes], Iterable[dict]]


def rendered(documents: DataFrame, key: str, content: str, render: Callable[[bytes], Iterable[bytes]], in_flight: int = 1) -> DataFrame:
    """(key, page, image, error): the pages of documents, numbered from 1; a document that can't be rendered is one row with an error."""
    got = fanned(documents, [key], content, lambda x: ({"image": image} for image in render(bytes(x))), "image binary", in_flight)
    return got.select(key, (F.col("nth") + 1).alias("page"), "image", "error")


def page_texts(images: DataFrame, keys: list[str], read: Words, crop: Callable[[bytes, int | None, int | None], bytes], vision: Callable[[bytes], str | None] | None = None, in_flight: int = 1) -> DataFrame:
    """(keys, text, engine, error): a row a page of ``images`` (keys, image).

    A vision service is asked first, if there is one; where it fails or says nothing the next engine reads words with their boxes. Pages whose lines stand in two columns are cropped at the gutter, and
    each column is read again for itself, left then right; others are read band by band. ``crop`` gets an image and where it starts and ends (None: the edge). Of a page that no engine could read
    the text is empty and the error told.
    """
    images = settled(images.select(*keys, "image"), "images")
    text = lambda x: [{"said": vision(bytes(x))}]
    seen = settled(fanned(images, keys, "image", text, "said string", in_flight).filter("trim(said) <> ''").select(*keys, "said"), "vision") if vision else None
    left = images.join(seen.select(*keys), keys, "left_anti") if vision else images
    boxes = settled(fanned(left, keys, "image", lambda x: read(bytes(x)), BOX, in_flight), "boxes")
    page = F.to_json(F.struct(*keys))
    words = boxes.filter("error is null").withColumn("_page", page)
    split = settled(layout.column_split(words.repartition("_page"), "_page"), "splits")  # one shuffle serves its lines, windows and pages
    whole = layout.banded(words.join(split.filter("split is null"), "_page", "left_semi"), "_page").select("_page", "text", F.lit("bands").alias("engine"), F.lit(None).cast("string").alias("error"))

    halves = left.withColumn("_page", page).join(split.filter("split is not null"), "_page").select("_page", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), F.struct("image", "split").alias("half"))

    def half(x: dict) -> Iterable[dict]:
        yield {"image": crop(bytes(x["half"]["image"]), None, int(x["half"]["split"])) if x["side"] == 0 else crop(bytes(x["half"]["image"]), int(x["half"]["split"]), None)}

    cropped = fanned(halves.withColumn("asks", F.struct("side", "half")), ["_page", "side"], "asks", half, "image binary", in_flight)
    again = settled(fanned(cropped.filter("error is null"), ["_page", "side"], "image", lambda x: read(bytes(x)), BOX, in_flight).unionByName(cropped.filter("error is not null").drop("image"), allowMissingColumns=True), "columns")
    lines = again.groupBy("_page", "side", "line_id").agg(F.min("top").alias("top"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("left", "text")))), lambda w: w["text"]), " ").alias("text"), F.max("error").alias("error"))
    column = lines.groupBy("_page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("side", "top", "line_id", "text")))), lambda x: x["text"]), "\n").alias("text"), F.max("error").alias("error"))
    column = column.select("_page", "text", F.lit("columns").alias("engine"), "error")
    read_ = whole.unionByName(column).groupBy("_page").agg(F.max(F.struct("text", "engine", "error")).alias("r"))
    failed = boxes.filter("error is not null").select(page.alias("_page"), F.col("error").alias("_failed"))
    by_boxes = left.select(*keys, page.alias("_page")).join(read_, "_page", "left").join(failed, "_page", "left").select(*keys, F.coalesce("r.text", F.lit("")).alias("text"), F.col("r.engine").alias("engine"), F.coalesce("r.error", "_failed").alias("error"))
    if not vision:
        return by_boxes
    return seen.select(*keys, F.trim("said").alias("text"), F.lit("vision").alias("engine"), F.lit(None).cast("string").alias("error")).unionByName(by_boxes)
