"""Technical qualities read from media files themselves: MP4 and Matroska headers, and audio by its kind.

Only headers are read, by seeking, so a file's size doesn't matter.  The files must be on a file system that every executor
has mounted; other files, and those that can't be read, have nulls.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import scoring

# Names of codecs.
MP4_VIDEO = {"avc1": "H.264", "avc3": "H.264", "hvc1": "H.265", "hev1": "H.265", "av01": "AV1", "vp09": "VP9", "mp4v": "MPEG-4"}
MP4_AUDIO = {"mp4a": "AAC", "fLaC": "FLAC", "Opus": "Opus", "ac-3": "AC3", "alac": "ALAC", ".mp3": "MP3"}
MKV_VIDEO = {"V_MPEG4/ISO/AVC": "H.264", "V_MPEGH/ISO/HEVC": "H.265", "V_AV1": "AV1", "V_VP9": "VP9", "V_MPEG4/ISO/ASP": "MPEG-4"}
MKV_AUDIO = {"A_AAC": "AAC", "A_FLAC": "FLAC", "A_DTS": "DTS", "A_AC3": "AC3", "A_OPUS": "Opus", "A_VORBIS": "Vorbis"}
AUDIO_KINDS = {"mp3": "MP3", "flac": "FLAC", "ogg": "Vorbis", "wav": "PCM", "opus": "Opus"}
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}
SEGMENT, INFO, TRACKS, TRACK, VIDEO, AUDIO = 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE0, 0xE1
CODEC_ID, PIXEL_WIDTH, PIXEL_HEIGHT, TIME_SCALE, DURATION, CLUSTER = 0x86, 0xB0, 0xBA, 0x2AD7B1, 0x4489, 0x1F43B675
HEADER_BYTES = 64 << 20

FIELDS = "path string, width int, height int, video_codec string, audio_codec string, audio_bitrate bigint, duration_secs bigint"


def _boxes(f: BinaryIO, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the boxes from here to an end; the contents are left to the caller."""
    while f.tell() + 8 <= end:
        at = f.tell()
        size, kind = struct.unpack(">I4s", f.read(8))
        if size == 1:
            size = struct.unpack(">Q", f.read(8))[0]
        begin = f.tell()
        upto = end if size == 0 else at + size
        if upto < begin or upto > end:
            return
        yield kind, begin, upto
        f.seek(upto)


def mp4(f: BinaryIO, size: int) -> dict:
    out: dict = {}

    def walk(end: int) -> None:
        for kind, begin, upto in _boxes(f, end):
            f.seek(begin)
            if kind in CONTAINERS:
                walk(upto)
            elif kind == b"mvhd" and upto - begin >= 32:
                head = f.read(32)
                scale, length = struct.unpack(">IQ", head[20:32]) if head[0] == 1 else struct.unpack(">II", head[12:20])
                out["duration_secs"] = length // scale if scale else None
            elif kind == b"stsd":
                f.seek(begin + 8)
                for entry, at, _ in _boxes(f, upto):
                    name, body = entry.decode("latin-1"), f.read(28)
                    if name in MP4_VIDEO and len(body) == 28:
                        out["width"], out["height"] = struct.unpack(">HH", body[24:28])
                        out["video_codec"] = MP4_VIDEO[name]
                    elif name in MP4_AUDIO and len(body) == 28:
                        channels, rate = struct.unpack(">H", body[16:18])[0], struct.unpack(">I", body[24:28])[0] >> 16
                        out["audio_codec"], out["audio_bitrate"] = MP4_AUDIO[name], channels * rate * 16
                    f.seek(at)

    walk(size)
    return out


def _number(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """A number of variable length, with its mark if it is to be kept, and the place behind it."""
    first = data[at]
    n = 9 - first.bit_length() if first else 9
    value = int.from_bytes(data[at : at + n], "big")
    return (value if keep else value & ((1 << 7 * n) - 1)), at + n


def mkv(data: bytes) -> dict:
    out: dict = {"scale": 1_000_000}

    def walk(at: int, end: int, track: dict | None) -> None:
        while at < end:
            kind, at = _number(data, at, True)
            size, begin = _number(data, at, False)
            if kind == CLUSTER:
                return
            upto = min(begin + size, end)
            body = data[begin:upto]
            if kind in (SEGMENT, INFO, TRACKS):
                walk(begin, upto, None)
            elif kind == TRACK:
                found: dict = {}
                walk(begin, upto, found)
                if "width" in found:
                    out.update({"width": found["width"], "height": found.get("height"), "video_codec": MKV_VIDEO.get(found.get("codec"), found.get("codec"))})
                elif "audio" in found:
                    out["audio_codec"] = MKV_AUDIO.get(found.get("codec"), found.get("codec"))
            elif kind == TIME_SCALE:
                out["scale"] = int.from_bytes(body, "big")
            elif kind == DURATION and len(body) in (4, 8):
                out["ticks"] = struct.unpack(">f" if len(body) == 4 else ">d", body)[0]
            elif track is not None and kind == CODEC_ID:
                track["codec"] = body.rstrip(b"\0").decode("latin-1")
            elif track is not None and kind in (VIDEO, AUDIO):
                track["audio" if kind == AUDIO else "video"] = True
                walk(begin, upto, track)
            elif track is not None and kind in (PIXEL_WIDTH, PIXEL_HEIGHT):
                track["width" if kind == PIXEL_WIDTH else "height"] = int.from_bytes(body, "big")
            at = upto

    walk(0, len(data), None)
    if "ticks" in out:
        out["duration_secs"] = int(out["ticks"] * out["scale"] / 1e9)
    return out


def probe(path: str) -> dict:
    """What the headers of one file say; empty for files that can't be read or have none."""
    ext = path.rsplit(".", 1)[-1].lower()
    try:
        with open(path, "rb") as f:
            if ext in ("mp4", "m4a", "m4v", "mov"):
                size = f.seek(0, 2)
                f.seek(0)
                return mp4(f, size)
            if ext == "mkv":
                return mkv(f.read(HEADER_BYTES))
    except (OSError, IndexError, struct.error, RecursionError):
        return {}
    return {"audio_codec": AUDIO_KINDS[ext]} if ext in AUDIO_KINDS else {}


def backend(choice: str, dry_run: bool, external: bool) -> str:
    """`native` or `external`: as chosen, or with `auto` the external one where it is there and the run isn't a dry one."""
    if choice not in ("auto", "native", "external"):
        raise ValueError(choice)
    return ("external" if external and not dry_run else "native") if choice == "auto" else choice


def file_quality(files: DataFrame) -> DataFrame:
    """(path, width, height, video_codec, audio_codec, audio_bitrate, duration_secs, resolution_label, quality_score) of files (path)."""
    import pandas as pd

    names = [x.split()[0] for x in FIELDS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": p, **(probe(p) if p is not None else {})} for p in batch["path"]]
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    found = files.select("path").mapInPandas(read, FIELDS)
    score = scoring.quality_score(F.col("height"), F.col("video_codec"), F.lit(None).cast("bigint"), F.col("audio_codec"))
    return found.withColumns({"resolution_label": scoring.resolution_label(F.col("height")), "quality_score": score})
