"""Word lists, lookup tables, thresholds and formats.

These must equal the catalog's published values for results to be right, so
they are stated here plainly and nowhere else.
"""

# --- listing -------------------------------------------------------------
VIDEO_EXTENSIONS = [
    ".mov", ".avi", ".mkv", ".mp4", ".mpeg", ".mpg", ".wmv", ".flv",
    ".webm", ".m4v", ".asf", ".vob", ".ts", ".m2ts", ".mts",
]
SYSTEM_DIRS = [
    ".@__thumb", "@Recycle", ".@Recycle", "@Recently-Snapshot",
    ".@Recently-Snapshot", "#recycle", ".AppleDouble", "__pycache__",
    ".git", ".svn",
]
EXTRAS_DIRS = [
    "trailer", "trailers", "extra", "extras", "featurette", "featurettes",
    "behind the scenes", "behindthescenes", "behind-the-scenes",
    "behind_the_scenes", "deleted scenes", "deletedscenes",
    "deleted-scenes", "deleted_scenes", "deleted scene", "deletedscene",
    "interview", "interviews", "short", "shorts", "scene", "scenes",
    "other", "others", "bonus", "bonuses", "bts", "sample", "samples",
]
EXTRAS_SUFFIXES = [
    "trailer", "behindthescenes", "bts", "deleted", "featurette",
    "interview", "scene", "short", "other", "bonus", "extra", "sample",
]
MIN_PROBE_SIZE_BYTES = 100 * 1024 * 1024
SKIP_REASON = "below_min_size"

# --- probe ---------------------------------------------------------------
CONTAINER_BY_EXT = {
    ".mp4": "mp4", ".m4v": "mp4", ".mov": "mov", ".mkv": "mkv",
    ".webm": "webm", ".avi": "avi", ".wmv": "wmv", ".asf": "asf",
    ".flv": "flv", ".mpg": "mpeg", ".mpeg": "mpeg", ".vob": "vob",
    ".ts": "mpegts", ".m2ts": "mpegts", ".mts": "mpegts",
}
HDR_TRANSFERS = ["smpte2084", "arib-std-b67"]
HDR_SPACES = ["bt2020nc", "bt2020c"]
DV_SIDE_DATA = "DOVI configuration record"

# --- tiers, thresholds, presets --------------------------------------------
UHD_MIN_HEIGHT = 1440
HD_MIN_HEIGHT = 720
# bucket -> (target Mbps, flag-above Mbps)
BITRATE_MBPS = {
    "480p": (1.5, 3.0), "720p": (3.0, 6.0), "1080p": (5.0, 10.0),
    "1440p": (9.0, 18.0), "2160p": (16.0, 32.0),
}
# bucket -> expected output MB per hour
OUTPUT_MB_PER_HOUR = {
    "480p": 600.0, "720p": 2500.0, "1080p": 5000.0,
    "1440p": 8000.0, "2160p": 12000.0,
}
SECONDS_PER_FILE = {"SD": 300, "HD": 900, "UHD": 3600, "UHD-FILM": 2400}
# name -> height band (inclusive, None = open) and the defaults a job takes
PRESETS = {
    "SD": dict(min_height=None, max_height=719, target="av1+mkv", quality=24,
               encoder_preset="veryslow", keep_langs="en,und", hw_decode=False),
    "HD": dict(min_height=720, max_height=1439, target="av1+mkv", quality=21,
               encoder_preset="veryslow", keep_langs="en,und", hw_decode=False),
    "UHD": dict(min_height=1440, max_height=None, target="av1+mkv", quality=15,
                encoder_preset="veryslow", keep_langs="en,und", hw_decode=True),
    "UHD-FILM": dict(min_height=1440, max_height=None, target="av1+mkv", quality=21,
                     encoder_preset="slow", keep_langs="en,und", hw_decode=True),
}
SLOW_DECODE_CODECS = []
RELAXED_UHD_QUALITY = 21
BLOAT_RATIO = 0.90
BLOAT_CHECKPOINTS = [0.10, 0.20, 0.30, 0.50]
STALL_SECONDS = 300

# --- rules -----------------------------------------------------------------
LEGACY_CODECS = [
    "mpeg2video", "mpeg4", "msmpeg4v1", "msmpeg4v2", "msmpeg4v3", "vc1",
    "wmv1", "wmv2", "wmv3", "h263", "rv10", "rv20", "rv30", "rv40", "theora",
]
LEGACY_CONTAINERS = ["avi", "wmv", "asf", "flv", "mpeg", "vob", "mpegts"]
MODERN_CODECS = ["h264", "hevc", "av1", "vp9"]
MIB = 1048576.0

# --- tracks ----------------------------------------------------------------
# one-hop code pairs; on purpose not symmetric
LANGUAGE_PAIRS = {
    "en": "eng", "eng": "en", "ja": "jpn", "jpn": "ja",
    "de": "ger", "ger": "de", "deu": "de",
    "fr": "fre", "fre": "fr", "fra": "fr",
    "es": "spa", "spa": "es", "it": "ita", "ita": "it",
    "ru": "rus", "rus": "ru", "zh": "chi", "chi": "zh", "zho": "zh",
    "ko": "kor", "kor": "ko", "pt": "por", "por": "pt",
    "nl": "dut", "dut": "nl", "nld": "nl",
}
LOSSLESS_CODECS = ["truehd", "mlp", "flac"]
CODEC_RANK = {
    "truehd": 100, "mlp": 100, "flac": 90, "dts": 80, "eac3": 60,
    "opus": 55, "ac3": 50, "aac": 45, "mp3": 30,
}
CODEC_RANK_DEFAULT = 10
IMAGE_SUBTITLE_CODECS = ["hdmv_pgs_subtitle", "dvd_subtitle", "dvb_subtitle", "xsub"]
# synthesised slot kind -> output settings
SYNTH_SETTINGS = {
    "opus51": dict(codec="libopus", channels=6, bitrate_k=384, title="Opus 5.1 (compat)"),
    "aac20": dict(codec="aac", channels=2, bitrate_k=256, title="AAC 2.0 (compat)"),
}

# --- targets and names -----------------------------------------------------
TARGETS = {
    "av1+mkv": ("av1", "mkv"), "hevc+mp4": ("hevc", "mp4"), "h264+mp4": ("h264", "mp4"),
}
CANONICAL_TOKEN = {"av1": "AV1", "hevc": "HEVC", "h264": "H.264"}
LEGACY_TOKENS = [r"MPEG[. _-]?2(?:video)?", "XviD", "DivX", "VC-?1", "VP9", "WMV[0-9]?"]
FOREIGN_TOKENS = {
    "av1": [r"H\.?264", r"H\.?265", "HEVC", "x264", "x265", "AVC"] + LEGACY_TOKENS,
    "hevc": [r"H\.?264", "x264", "AVC", "AV1", "SVT-?AV1"] + LEGACY_TOKENS,
    "h264": [r"H\.?265", "HEVC", "x265", "AV1", "SVT-?AV1"] + LEGACY_TOKENS,
}
LOST_METADATA_TOKENS = {
    "av1": ["HDR10Plus", r"HDR10\+", r"Dolby[. _-]?Vision", "DoVi", "DV"],
}
REENCODE_TOKEN = "REENCODE"

# --- ledger ----------------------------------------------------------------
STALL_MARK = "encoder stalled"
STALL_LIMIT = 2
ERROR_TOKENS = [
    ("encoder stalled", "encoder_stalled"), ("timeout", "timeout"),
    ("timed out", "timeout"), ("recycle move failed", "recycle_failed"),
    ("backup failed", "backup_failed"),
    ("original not removed", "original_not_removed"),
    ("probe missing", "probe_missing"),
    ("source no longer exists", "source_missing"),
    ("user declined", "user_declined"), ("dolby vision", "dolby_vision"),
    ("no encoder available", "no_encoder"),
]
ERROR_TOKEN_DEFAULT = "ffmpeg_failed"

# --- leftover audit ----------------------------------------------------------
AUDIT_EXTENSIONS = [
    ".mkv", ".mp4", ".m4v", ".mov", ".avi", ".wmv", ".ts", ".m2ts", ".webm",
]
AUDIT_OUTPUT_MARK = ".AV1.REENCODE"
AUDIT_ORIGINAL_MARKS = [
    ".HEVC", ".H.265", ".H265", ".x265", ".x.265", ".AVC", ".H.264",
    ".H264", ".x264", ".MPEG2", ".MPEG-2", ".VC1", ".VC-1", ".VP9",
]

# patterns of names; WHITE_SPACE, with (?U), is Unicode white space plus the four separators
NOT_WORD_BEFORE = "(?<![A-Za-z0-9])"
NOT_WORD_AFTER = "(?![A-Za-z0-9])"
WHITE_SPACE = r"[\s\x1c-\x1f]"
NAMES_HDR = NOT_WORD_BEFORE + r"HDR(?:10|2000)?(?![A-Za-z0-9+])"
SEPARATOR_STEPS = [
    (r"\.{2,}", "."),
    (WHITE_SPACE + "{2,}", " "),
    (r"\[" + WHITE_SPACE + r"*\]", ""),
    (r"\(" + WHITE_SPACE + r"*\)", ""),
    (WHITE_SPACE + r"+\.|\." + WHITE_SPACE + "+", "."),
    (WHITE_SPACE + "+-|-" + WHITE_SPACE + "+", "-"),
    (r"\.-|-\.", "-"),
    (NOT_WORD_BEFORE + r"\+" + NOT_WORD_AFTER, ""),
    (r"\.{2,}", "."),
]
