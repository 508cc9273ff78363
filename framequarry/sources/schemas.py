"""Fixed schemas of recordings; optional columns are null where a recording has none."""

from __future__ import annotations

FRAMES_META = "camera_timestamp_ns bigint, exposure_us double, gain double, camera_frame_id bigint, camera_counter bigint, `index` int, host_time_utc timestamp, host_monotonic_s double, filename string"

MANIFEST = """camera struct<model: string, serial: string, vendor: string, firmware: string, interface: string>,
acquisition_requested struct<pixel_format: string, bit_depth: int, width: int, height: int, offset_x: int, offset_y: int, requested_fps: double>,
camera_state_at_start map<string, string>, camera_state_at_end map<string, string>,
capture struct<started_utc: string, finished_utc: string, frames_offered: bigint, frames_written: bigint, frames_dropped: bigint, span_s: double, effective_fps: double>,
pixel_values struct<dtype: string, bit_depth: int, alignment: string, max_value: int>, software map<string, string>"""

RELEASE = """release string, bursts array<struct<burst: string, zip: string, zip_bytes: bigint, zip_sha256: string, raw_bytes: bigint, frames: int, width: int, height: int,
pixel_format: string, fps: double, files: array<struct<path: string, bytes: bigint, sha256: string>>>>"""

OVERLAY = """format string, version int, shape array<int>, vessels array<struct<id: string, points: array<array<double>>, radius: array<double>, `group`: string, props: map<string, string>>>,
junctions array<struct<x: double, y: double, kind: string>>, masks array<struct<name: string>>, summary string, segmenter string, source string, made_utc string, seconds double"""

FRAMES = "burst string, `index` int, height int, width int, bit_depth int, pixels binary"
