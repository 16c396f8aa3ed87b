"""Orders as whole evidence records: every input of the record rules, as a function of the order's key.

The expressions are plain SQL that both engines read, so a query and its SQL see the same records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import EVIDENCE_SQL, evidence

_K = "evidence_id"


def _pick(modulus: int, *values: str, times: int = 1) -> str:
    """One of some texts, by the key; what is over takes the last."""
    cases = " ".join(f"when {n} then '{v}'" for n, v in enumerate(values[:-1]))
    return f"case ({_K} * {times}) % {modulus} {cases} else '{values[-1]}' end"


def _whole(modulus: int, times: int, where: str = "true") -> str:
    return f"case when {where} then cast(({_K} * {times}) % {modulus} as int) else 0 end"


def _flag(modulus: int, times: int = 1) -> str:
    return f"({_K} * {times}) % {modulus} = 0"


#: Columns that replace or extend those of the evidence view.
COLUMNS = {
    "source_type": _pick(12, "Camera Photo", "Screenshot", "Messaging Export", "Edited / Exported", "Unknown", "Map Screenshot", "Browser Screenshot", "Screenshot / Export", "Graphic Asset", "Malformed / Unsupported Asset", "Camera Photo"),
    "structure_status": _pick(11, "Animated", "Suspicious", "Normal"),
    "format_trust": _pick(7, "Weak", "Header-only", "Verified", times=3),
    "has_exif": f"{_K} % 4 <> 1",
    "timestamp_source": _pick(6, "Native EXIF Original", "Embedded EXIF", "Filename Pattern", "Filesystem Modified Time", "Unavailable", "Native EXIF Original", times=5),
    "software": _pick(9, "Adobe Photoshop 24", "GIMP 2.10", "Firmware 1.2", "Unknown", "N/A", times=7),
    "hidden_codes": _whole(3, 1, f"({_K} * 5) % 13 = 0"),
    "hidden_embeds": _whole(2, 1, f"{_K} % 8 = 3"),
    "time_conflicts": _whole(3, 1, f"{_K} % 9 = 4"),
    "visible_urls": _whole(3, 1, f"{_K} % 5 = 1"),
    "visible_text": _flag(3, 2),
    "app": _pick(4, "Unknown", "WhatsApp", "Google Maps", "Telegram", times=3),
    "environment": _pick(3, "Desktop browser", "Mobile", "Unknown"),
    "width": f"case when {_K} % 17 = 0 then 0 else cast(300 + ({_K} * 37) % 2000 as int) end",
    "height": f"case when {_K} % 17 = 0 then 0 else cast(300 + ({_K} * 53) % 3000 as int) end",
    "stego": _pick(10, "Possible payload", "No strong signal", "", times=3),
    "pixel_score": _whole(101, 3, f"{_K} % 6 = 0"),
    "lsb_strings": _whole(2, 1, f"{_K} % 15 = 0"),
    "quality_flag": _pick(12, "Alpha residue", "Very dark frame", "blur", "", times=5),
    "duplicate_group": f"case when ({_K} * 7) % 5 = 1 then 'G' || cast({_K} % 40 as string) else '' end",
    "mtime_gap_days": _whole(900, 13),
    "derived_latitude": f"case when {_K} % 4 < 2 then 30 + ({_K} % 300) / 1e2 end",
    "derived_longitude": f"case when {_K} % 4 < 2 then 31 + ({_K} % 200) / 1e2 end",
    "derived_geo_confidence": _whole(101, 11, f"{_K} % 4 < 2"),
    "map_labels": _whole(3, 1, f"{_K} % 7 < 2"),
    "place_candidates": _whole(4, 1, f"{_K} % 10 < 3"),
    "map_intelligence": _whole(101, 17, f"{_K} % 2 = 0"),
    "map_url": _flag(9, 2),
    "route": _flag(14, 3),
    "copy_verified": f"{_K} % 3 <> 0",
    "scene_confidence": _whole(101, 19),
    "image_confidence": _whole(101, 23, f"{_K} % 3 <> 1"),
    "ai_flags": _whole(3, 1, f"{_K} % 13 < 3"),
    "basis": _pick(5, "filename", "ocr/text", "visual-map-colors", "map-url", "", times=2),
    "link_text": f"case when {_K} % 40 = 0 then 'See item ' || cast({_K} + 1 as string) || ' of the batch' else '' end",
}

RECORDS_SQL = f"{EVIDENCE_SQL}, records as (select * exclude ({', '.join(c for c in COLUMNS if c in ('source_type', 'derived_geo_confidence'))}), " + ", ".join(f"{e} {c}" for c, e in COLUMNS.items()) + " from evidence)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).withColumns({c: F.expr(e) for c, e in COLUMNS.items()})
