"""Device tiers, budgets, feedback on budgets, and source choice, as column expressions."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.constants import BACKENDS, BUDGETS, GOP_WALK, MAX_INDEXED_BYTES, SEEK_MARGIN_MS, Budget
from tidemark.functions.scoring import half_up


def tier(webgpu: Column, webgl: Column, cores: Column, memory_gb: Column) -> Column:
    """low, medium or high; unknown memory never lowers a tier."""
    return (
        F.when(~webgpu & ~webgl, "low")
        .when(memory_gb.isNotNull() & (memory_gb <= 2), "low")
        .when(cores <= 2, "low")
        .when(webgpu & (cores >= 8) & (memory_gb.isNull() | (memory_gb >= 8)), "high")
        .otherwise("medium")
    )


def budget(tier_name: Column, save_data: Column | None = None) -> Column:
    """The budget of a tier as a struct, reduced where data is to be saved."""

    def pick(field: str) -> Column:
        value = F.lit(getattr(Budget(), field))
        for name, own in BUDGETS.items():
            value = F.when(tier_name == name, getattr(own, field)).otherwise(value)
        return value

    made = {f.name: pick(f.name) for f in fields(Budget)}
    if save_data is not None:
        less = {
            "survey_frames": F.greatest(F.lit(6), half_up(made["survey_frames"] * 0.6)),
            "max_frames": F.greatest(F.lit(16), half_up(made["max_frames"] * 0.5)),
            "max_ms": half_up(made["max_ms"] * 0.6),
        }
        made |= {k: F.when(save_data, v).otherwise(made[k]) for k, v in less.items()}
    return F.struct(*[v.cast("long").alias(k) for k, v in made.items()])


def preferred_backend(webgpu: Column, webgl: Column, wasm: Column) -> Column:
    return F.when(webgpu, "webgpu").when(webgl, "webgl").when(wasm, "wasm").otherwise("cpu")


def usable_probe(result: Column) -> Column:
    """A probe that threw (null) or found nothing is false, never an error."""
    return F.coalesce(result, F.lit(False))


def notes(gpu_present: Column, webgpu: Column, webgl: Column, webcodecs: Column) -> Column:
    """What a user should know of a device, as an array of texts in a fixed order; empty if nothing is amiss."""
    said = [
        F.when(gpu_present & ~webgpu, "a GPU interface is there, but no adapter could be had"),
        F.when(~webcodecs, "no codec interface: frames are taken by seeking, which is slower"),
        F.when(~webgpu & ~webgl, "no GPU backend: inference runs on the processor, and slower"),
    ]
    return F.array_compact(F.array(*said))


def sampling_gap(min_gap_ms: Column, resolution: Column) -> Column:
    """The least gap between samples: never finer than the source resolves (null: unknown)."""
    return F.greatest(min_gap_ms.cast("long"), half_up(resolution))


def cores_of(reported: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(reported, F.lit(2)))


def backend_chain(preferred: Column) -> Column:
    """Backends to try in order: all for 'auto', else the preferred one and those after it."""
    known = F.array(*[F.lit(b) for b in BACKENDS])
    at = F.array_position(known, preferred).cast("int")
    return F.when(preferred == "auto", known).when(at > 0, F.slice(known, F.greatest(at, F.lit(1)), len(BACKENDS))).otherwise(known)


def describe(tier_name: Column, backend: Column, cores: Column, memory_gb: Column, webcodecs: Column) -> Column:
    memory = F.when(memory_gb.isNotNull(), F.concat(F.format_string("%.0f", memory_gb.cast("double")), F.lit(" GB")))
    parts = F.array(F.concat(tier_name, F.lit(" tier")), backend, F.concat(cores.cast("string"), F.lit(" cores")), memory, F.when(webcodecs, "WebCodecs"))
    return F.array_join(F.array_compact(parts), " - ")


def governed(max_frames: Column, min_gap_ms: Column, target_ms: Column, p50_ms: Column, samples: Column) -> Column:
    """The budget after latency feedback as struct<max_frames, min_gap_ms, throttled, factor>. Always from the original budget."""
    over = p50_ms / F.greatest(F.lit(1), target_ms)
    on = (samples >= 6) & (p50_ms > 0) & (over > 1.5)
    factor = F.least(F.lit(3.0), over)
    return F.struct(
        F.when(on, F.greatest(F.lit(16), half_up(max_frames / factor))).otherwise(max_frames).cast("long").alias("max_frames"),
        F.when(on, half_up(min_gap_ms * F.least(F.lit(2.0), factor))).otherwise(min_gap_ms).cast("long").alias("min_gap_ms"),
        F.coalesce(on, F.lit(False)).alias("throttled"),
        F.when(on, factor).otherwise(F.lit(1.0)).alias("factor"),
    )


def resolution_floor(floor_ms: Column, duplicates: Column, duration_ms: Column) -> Column:
    """The gap floor after frames were delivered twice: it grows by 1.6 a duplicate after the second, up to an eighth of the video."""
    wider = floor_ms * F.pow(F.lit(1.6), F.greatest(duplicates - 2, F.lit(0)).cast("double"))
    most = F.greatest(floor_ms.cast("double"), duration_ms / 8.0)
    return F.when(duplicates <= 2, floor_ms.cast("long")).otherwise(half_up(F.least(wider, most)))


def source_kind(local: Column, byte_length: Column, webcodecs: Column, iso_bmff: Column) -> Column:
    """struct<kind, reason> of the frame source; an unknown length passes."""
    element = lambda why: F.struct(F.lit("video-element").alias("kind"), F.lit(why).alias("reason"))
    return (
        F.when(~webcodecs, element("no codec API"))
        .when(~local, element("remote"))
        .when(~iso_bmff, element("container"))
        .when(F.coalesce(byte_length, F.lit(0)) > MAX_INDEXED_BYTES, element("size"))
        .otherwise(F.struct(F.lit("webcodecs").alias("kind"), F.lit("indexed").alias("reason")))
    )


def looks_like_iso_bmff(content: Column) -> Column:
    """Whether the bytes 'ftyp' begin anywhere from byte 4 to 4 bytes before byte 64."""
    return F.decode(F.substring(content, 5, 60), "ISO-8859-1").contains("ftyp")


def accepts_mime(mime: Column) -> Column:
    kind = F.coalesce(mime, F.lit(""))
    return (kind == "") | kind.startswith("video/")


def accepts_url(url: Column) -> Column:
    """Whether trimmed text is a URL over http or https."""
    return F.coalesce(F.lower(F.try_parse_url(F.trim(url), F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


def resolution_ms(frame_ms: Column, keyframe_gap_ms: Column, keyframes: Column) -> Column:
    """How finely a source can be sampled: by frames unless a group of pictures is too long to walk."""
    coarse = (keyframes >= 2) & (keyframe_gap_ms / F.greatest(F.lit(1.0), frame_ms) > GOP_WALK)
    return F.when(coarse, keyframe_gap_ms).otherwise(frame_ms)


def crops(width: Column, height: Column, fit: str) -> Column:
    """Crop rectangles array<struct<x, y, side>> of a frame; empty where the frame is squashed whole."""
    side = F.least(width, height)
    y = half_up((height - side) / 2)
    square = lambda x: F.struct(x.cast("long").alias("x"), y.alias("y"), side.cast("long").alias("side"))
    none = F.array().cast("array<struct<x:bigint,y:bigint,side:bigint>>")
    if fit == "centerCrop":
        return F.array(square(half_up((width - side) / 2)))
    if fit == "multiCrop":
        wide = width / F.greatest(F.lit(1), height) > 1.5
        return F.when(wide, F.array(square(F.lit(0)), square(F.greatest(F.lit(0), width - side)))).otherwise(none)
    return none


def resolved_duration(duration_ms: Column, seekable_end_ms: Column, discovered_ms: Column) -> Column:
    """The first finite, positive duration that a source tells; null for a live source."""
    known = lambda x: F.when((x > 0) & ~F.isnan(x.cast("double")) & (x.cast("double") != float("inf")), x.cast("double"))
    return F.coalesce(known(duration_ms), known(seekable_end_ms), known(discovered_ms))


def seek_target(ts_ms: Column, duration_ms: Column) -> Column:
    """Where a seek goes: within the video, and never onto its very end."""
    return F.greatest(F.lit(0), F.least(ts_ms, duration_ms - SEEK_MARGIN_MS))


def probe_result(duration_ms: Column, readable: Column) -> Column:
    """struct<ok, kind, message, duration_ms>: a probe's success, or why it failed."""
    failed = lambda kind, why: F.struct(F.lit(False).alias("ok"), F.lit(kind).alias("kind"), F.lit(why).alias("message"), F.lit(None).cast("double").alias("duration_ms"))
    return (
        F.when(readable == "tainted", failed("cors", "pixels can't be read"))
        .when(readable != "ok", failed("decode", "no frame could be read"))
        .when(duration_ms.isNull(), failed("live", "the video has no end"))
        .otherwise(F.struct(F.lit(True).alias("ok"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("message"), duration_ms.cast("double").alias("duration_ms")))
    )
