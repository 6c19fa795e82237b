"""Limits, ladders and rule tables the operators apply. All are plain data."""

from __future__ import annotations

MIB = 1024 * 1024

# ---- encoder and frame-rate limits -------------------------------------------------
ENCODER_MIN_KBPS = {
    "libx264": 10,
    "libx265": 15,
    "h264_nvenc": 8,
    "h264_amf": 8,
    "h264_qsv": 8,
    "h264_videotoolbox": 8,
}
DEFAULT_ENCODER_MIN_KBPS = 10
PRESETS = ("ultrafast", "superfast", "veryfast", "faster", "fast", "medium", "slow", "slower", "veryslow")
MIN_FPS = 20.0
MIN_WIDTH = 1280
MIN_HEIGHT = 720
FPS_STEPS = (0.8, 0.6, 0.5)
SAFETY_MARGIN = 1.1
MAX_SIZE_MB = 10.0
AUDIO_STEPS = ((160.0, 192), (112.0, 128), (80.0, 96), (56.0, 64), (40.0, 48))
ENCODE_TIME_FACTOR = {
    "ultrafast": 0.3, "superfast": 0.5, "veryfast": 0.8, "faster": 1.2, "fast": 1.8,
    "medium": 3.0, "slow": 5.0, "slower": 8.0, "veryslow": 12.0,
}
PRIORITY_BONUS = {"maximum": 3.0, "perceptual": 2.5, "balanced": 2.0, "adaptive": 2.5, "size": 1.0}
MIN_BPP = {"h264_8bit": 0.023, "h264_10bit": 0.020, "hevc_8bit": 0.018, "hevc_10bit": 0.015}
CODEC_BASE_BPP = {"hevc_10bit": 0.017, "hevc_8bit": 0.019, "h264_10bit": 0.021, "h264_8bit": 0.025}

# ---- platform caps: name, max_width, max_height, fps, kbps -------------------------
VIDEO_PLATFORMS = (
    ("instagram", 1080, 1080, 30, 1000),
    ("twitter", 1280, 720, 30, 1200),
    ("tiktok", 1080, 1920, 30, 1500),
    ("youtube_shorts", 1080, 1920, 30, 2000),
    ("facebook", 1280, 720, 30, 1000),
    ("discord", 1920, 1080, 30, 1000),
)
# name, max_width, max_height, max_duration, colours, lossy
GIF_PLATFORMS = (
    ("twitter", 506, 506, 15, None, None),
    ("discord", 400, 400, 15, 192, 40),
    ("slack", 360, 360, 12, 160, 60),
)
# name, colours, fps multiplier, resolution multiplier, lossy, dither
GIF_STAGES = (
    ("Maximum Quality", 256, 1.0, 1.0, 0, "floyd_steinberg"),
    ("High Quality", 224, 0.98, 0.98, 20, "floyd_steinberg"),
    ("Medium High Quality", 192, 0.95, 0.95, 40, "floyd_steinberg"),
    ("Medium Quality", 160, 0.94, 0.92, 60, "bayer"),
    ("Standard Quality", 128, 0.9, 0.88, 80, "bayer"),
    ("Low Quality", 96, 0.88, 0.8, 120, "bayer"),
)
GIF_GUARDRAIL = {
    "duration_seconds": 45.0,
    "frame_budget": 900.0,
    "segment_duration_ratio": 0.5,
    "segment_frame_budget_ratio": 0.6,
    "palette_fps_cap": 14.0,
    "palette_max_colors": 208,
    "fps_multiplier": 0.5,
    "color_multiplier": 0.7,
}
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv", ".webm", ".m4v", ".3gp", ".ogv")
SOURCE_EXTENSIONS = (".mp4", ".mov", ".mkv", ".webm", ".avi")

# ---- error keyword rules, first match wins: category, severity, retryable, keyword groups
# A rule matches when every group has at least one keyword in the lower-cased message.
ERROR_RULES = (
    ("bitrate_validation", "error", True, (("bitrate",), ("minimum", "floor"))),
    ("segmentation", "error", True, (("segmentation",),)),
    ("encoder", "error", True, (("encoder", "ffmpeg"),)),
    ("timeout", "warning", True, (("timeout", "timed out"),)),
    ("memory", "error", False, (("memory", "out of memory"),)),
    ("permission", "error", False, (("permission", "access denied"),)),
    ("network", "warning", True, (("network", "connection"),)),
    ("file_validation", "warning", False, (("invalid", "corrupt", "format"),)),
)
ERROR_DEFAULT = ("general", "error", True)

# ---- evaluator stderr rules, first match wins: category, retryable, severity, literals
STDERR_RULES = (
    ("file_not_found", False, "critical", ("no such file", "file not found", "cannot open")),
    ("invalid_format", False, "critical", ("invalid data found", "invalid argument", "unsupported format")),
    ("permission_error", False, "high", ("permission denied", "access denied")),
    ("disk_space", False, "high", ("no space left", "disk full")),
    ("vmaf_not_available", False, "critical",
     ("libvmaf.*not found", "vmaf.*not available", "unknown filter.*vmaf")),
    ("vmaf_model_error", True, "high", ("vmaf.*model.*not found", "vmaf.*model.*error")),
    ("vmaf_resolution_mismatch", True, "medium", ("vmaf.*resolution.*mismatch", "vmaf.*dimension.*error")),
    ("vmaf_filter_parameter_error", True, "high",
     ("no option name near", "invalid filter.*vmaf", "malformed.*vmaf", "syntax error.*vmaf")),
    ("vmaf_log_path_error", True, "medium", ("log_path.*error", "cannot.*write.*log", "log.*permission")),
    ("vmaf_computation_timeout", True, "medium", ("vmaf.*timeout", "vmaf.*killed", "vmaf.*interrupted")),
    ("vmaf_filter_error", True, "medium", ("libvmaf", "vmaf filter")),
    ("resource_busy", True, "medium", ("resource temporarily unavailable", "device busy")),
    ("network_error", True, "medium", ("connection refused", "network unreachable", "timeout")),
    ("memory_error", True, "high", ("memory allocation failed", "out of memory")),
    ("ssim_filter_error", True, "medium", ("ssim filter", "ssim stats")),
    ("codec_not_available", False, "high", ("encoder.*not found", "codec.*not available")),
)
STDERR_BY_RETURNCODE = {1: ("generic_ffmpeg_error", True, "medium"), 2: ("invalid_arguments", False, "high")}
STDERR_UNKNOWN = ("unknown_error", True, "medium")
AUTO_RECOVERABLE = (
    "vmaf_filter_parameter_error", "vmaf_log_path_error", "resource_busy", "memory_error",
    "vmaf_computation_timeout",
)

# ---- words that point to a hardware encoder failure (longer phrases contain these) ----
HARDWARE_WORDS = {
    "amd_amf": ("amf",),
    "nvidia_nvenc": ("nvenc", "cannot load nvcuda.dll", "cuda driver not found", "no nvidia device found"),
    "intel_quicksync": ("qsv", "mfx session"),
    "general": ("hardware", "hwaccel", "gpu", "device not found", "encoder not found", "codec not supported"),
}
HARDWARE_CODES = (4294967274, -22, -12, -2)
