"""Small reference tables (fixed row counts) with overrides by dotted key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelscope.functions import constants as K


def _override(overrides: dict, key: str, default):
    return overrides.get(key, default)


def load_dims(spark: SparkSession, overrides: dict | None = None) -> dict[str, DataFrame]:
    """encoders, video_platforms, gif_platforms, gif_stages, bpp_floors.

    Overrides look like ``{"encoder_minimums.libx264": 3, "platforms.discord.fps": 60}``.
    """
    o = overrides or {}
    encoders = [(e, _override(o, f"encoder_minimums.{e}", v)) for e, v in K.ENCODER_MIN_KBPS.items()]
    fields = ("max_width", "max_height", "fps", "kbps")
    platforms = [
        (p[0], *[_override(o, f"platforms.{p[0]}.{f}", v) for f, v in zip(fields, p[1:])]) for p in K.VIDEO_PLATFORMS
    ]
    return {
        "encoders": spark.createDataFrame(encoders, "encoder string, min_kbps int"),
        "video_platforms": spark.createDataFrame(
            platforms, "platform string, max_width int, max_height int, cap_fps int, cap_kbps int"
        ),
        "gif_platforms": spark.createDataFrame(
            list(K.GIF_PLATFORMS),
            "platform string, max_width int, max_height int, max_duration int, colors int, lossy int",
        ),
        "gif_stages": spark.createDataFrame(
            [(i, *s) for i, s in enumerate(K.GIF_STAGES)],
            "stage int, name string, colors int, fps_mult double, res_mult double, lossy int, dither string",
        ),
        "bpp_floors": spark.createDataFrame(list(K.MIN_BPP.items()), "codec_key string, min_bpp double"),
    }


def with_dim(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join a fixed-size dimension (a handful of rows), broadcast."""
    return df.join(F.broadcast(dim), key, "left")
