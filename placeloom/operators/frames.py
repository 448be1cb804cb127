"""Text from video frames: OCR tables to clean lines, and duplicates across frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import frame_number, frame_time, sample_times
from ..functions.text import LEAST_CONFIDENCE, LEAST_LINE, fix_price, is_noise, text_key, trim_space

MOST_FRAMES = 60


def words(frames: DataFrame, key: list[str], tsv: str = "tsv") -> DataFrame:
    """Word rows of OCR tables: ``key, pos, block, par, line, conf, text``.

    An OCR table is text with a header and 12 columns between tabs; rows of level 5 with a confidence of 0 or
    more and some text are words.
    """
    lines = frames.select(*key, F.posexplode(F.split(tsv, "\n")).alias("pos", "row")).where("pos > 0")
    # generated, not projected: filters are merged into projections, which would split each row, and trim each text, once per condition
    cells = lines.select(*key, "pos", F.explode(F.array(F.split("row", "\t"))).alias("c")).where(F.size("c") >= 12)
    whole = lambda i: F.coalesce(F.col("c")[i].try_cast("int"), F.col("c")[i].try_cast("double").cast("int"))
    fields = F.struct(whole(0).alias("level"), whole(2).alias("block"), whole(3).alias("par"), whole(4).alias("line"), whole(10).alias("conf"), trim_space(F.col("c")[11]).alias("text"))
    out = cells.select(*key, "pos", F.explode(F.array(fields)).alias("f")).select(*key, "pos", "f.*")
    return out.where("level = 5 and not coalesce(conf < 0, false) and text <> ''").drop("level")


def clean_lines(word_rows: DataFrame, key: list[str], least_confidence: int = LEAST_CONFIDENCE) -> DataFrame:
    """``key, line_no, text``: confident words that aren't noise, joined by block, paragraph and line in reading order; short lines go.

    A line's words are gathered, so a line is the largest group.
    """
    good = word_rows.where((F.col("conf") >= least_confidence) & ~is_noise("text")).withColumn("text", fix_price("text"))
    grouped = good.groupBy(*key, "block", "par", "line").agg(F.min("pos").alias("line_no"), F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("w"))
    joined = grouped.select(*key, "line_no", trim_space(F.array_join("w.text", " ")).alias("text"))
    return joined.where(F.length("text") >= LEAST_LINE)


def unique_across_frames(lines: DataFrame, group: list[str], frame: str, pos: str, text: str = "text") -> DataFrame:
    """Each text on the first frame of its group that shows it, as it stood there; same text means same key."""
    return _first(lines.withColumn("__key__", text_key(text)), [*group, "__key__"], frame, pos).drop("__key__")


def collapsed(lines: DataFrame, group: list[str], frame: str, pos: str, text: str = "text") -> DataFrame:
    """A group's distinct trimmed texts in order, as one array; keys shorter than two characters go."""
    keyed = lines.withColumn("__key__", text_key(text)).where(F.length("__key__") >= 2)
    first = _first(keyed, [*group, "__key__"], frame, pos)
    row = F.struct(F.col(frame), F.col(pos), trim_space(text).alias("t"))
    return first.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]).alias("texts"))


def _first(rows: DataFrame, keys: list[str], frame: str, pos: str) -> DataFrame:
    """The first row of each key, by partial aggregation before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    whole = F.min_by(F.struct(*rest), F.struct(frame, pos)).alias("__row__")
    return rows.groupBy(*keys).agg(whole).select(*keys, "__row__.*").select(*rows.columns)


def aggregated(frames: DataFrame, group: list[str], frame: str, attributes: list[str]) -> DataFrame:
    """For each array attribute of a group's frames the distinct values, in order of frames and where they came first."""
    row = F.array_sort(F.collect_list(F.struct(F.col(frame), *attributes)))
    got = frames.groupBy(*group).agg(row.alias("__rows__"))
    empty = F.array().cast("array<string>")

    def seen(name: str) -> Column:
        values = F.flatten(F.transform("__rows__", lambda x: F.coalesce(x[name], empty)))
        return F.filter(F.array_distinct(values), lambda v: v.isNotNull() & (v != ""))

    flat = [seen(name).alias(name) for name in attributes]
    return got.select(*group, *flat)


def distinct_frames(frames: DataFrame, video: str, index: str, content: str, most: int | None = None) -> DataFrame:
    """Frames of a video whose content wasn't seen before (by MD5), in order, ``most`` at most; ``digest`` and the original index stay."""
    marked = frames.withColumn("digest", F.md5(content))
    first = _first(marked, [video, "digest"], index, "digest")
    if most is None:
        return first
    rank = F.row_number().over(Window.partitionBy(video).orderBy(index))
    return first.withColumn("__nth__", rank).where(F.col("__nth__") <= most).drop("__nth__")


def frame_files(files: DataFrame, duration: str | None = None, interval: float = 1.0, path: str = "path") -> DataFrame:
    """Frame files with ``number`` and ``seconds`` from their names."""
    out = files.withColumn("number", frame_number(path))
    limit = F.col(duration) if duration else F.lit(float("inf"))
    return out.withColumn("seconds", frame_time("number", limit, interval))


def frame_series(posts: DataFrame, duration: str, key: str = "id", most: int = 30) -> DataFrame:
    """``key, frame, seconds``: evenly spaced frames of each post's video."""
    return posts.select(key, F.posexplode(sample_times(duration, most)).alias("frame", "seconds"))


def carousel_text(slides: DataFrame, post: str, slide: str, texts: str, transcript: str, most: int = 4) -> DataFrame:
    """Texts and transcripts of a post's first slides, in order: ``texts`` (array) and ``transcript`` (joined by blank lines)."""
    near = slides.where(F.col(slide) < most)
    got = near.groupBy(post).agg(F.array_sort(F.collect_list(F.struct(F.col(slide), F.col(texts).alias("t"), F.col(transcript).alias("s")))).alias("__rows__"))
    empty = F.array().cast("array<string>")
    said = F.filter(F.transform("__rows__", lambda x: x["s"]), lambda v: v.isNotNull() & (v != ""))
    return got.select(post, F.flatten(F.transform("__rows__", lambda x: F.coalesce(x["t"], empty))).alias("texts"), F.array_join(said, "\n\n").alias("transcript"))


def in_frame_order(results: DataFrame, video: str, index: str, text: str) -> DataFrame:
    """``video, texts``: what was read of each video's frames, whatever order the results came in; frames of one index by their text, nulls left out."""
    read = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(index).alias("i"), F.col(text).alias("t")))))
    return results.groupBy(video).agg(F.transform(read, lambda x: x["t"]).alias("texts"))
