"""Table schemas, as DDL text."""

AUDIO_TRACK = (
    "index int, codec string, language string, channels int, channel_layout string, "
    "bitrate bigint, title string, default boolean")
SUBTITLE_TRACK = (
    "index int, codec string, language string, forced boolean, default boolean, title string")

PROBE = (
    "path string, size bigint, mtime double, duration_seconds double, container string, "
    "format_name string, video_codec string, width int, height int, frame_rate double, "
    "pixel_format string, bit_depth int, video_bitrate bigint, color_primaries string, "
    "color_transfer string, color_space string, is_hdr boolean, "
    f"audio_tracks array<struct<{AUDIO_TRACK.replace(' ', ':').replace(',:', ', ')}>>, "
    f"subtitle_tracks array<struct<{SUBTITLE_TRACK.replace(' ', ':').replace(',:', ', ')}>>, "
    "creation_time timestamp, dv_profile int")

# One probe document as the prober writes it. Numbers that may come quoted are text.
PROBE_DOC = (
    "format struct<format_name:string, duration:string, size:string, bit_rate:string, "
    "tags:map<string,string>>, "
    "streams array<struct<index:int, codec_type:string, codec_name:string, width:string, "
    "height:string, pix_fmt:string, r_frame_rate:string, bit_rate:string, channels:string, "
    "channel_layout:string, color_primaries:string, color_transfer:string, color_space:string, "
    "side_data_list:array<struct<side_data_type:string, dv_profile:string>>, "
    "tags:struct<language:string, title:string>, "
    "disposition:struct<default:int, forced:int>>>")

LISTING = "path string, size bigint, mtime double"
SKIPPED = "path string, size bigint, mtime double, reason string, last_seen_at double"
DECISION = (
    "id bigint, path string, decided_at double, rules_fired array<string>, target string, "
    "projected_savings_mb double, status string, output_path string, "
    "actual_savings_mb double, error string, run_id bigint")
RUN = (
    "id bigint, kind string, started_at double, ended_at double, root string, "
    "args map<string,string>, summary map<string,bigint>")
