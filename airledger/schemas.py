"""Column layouts of session logs, corrections, rosters and profiles."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


#: One transmission; exports keep this order.
TRANSMISSION = _struct(
    id=_L, timestamp=_S, matched=_B, matched_callsign=_S, operator_name=_S, raw_text=_S, confidence=_D, match_score=_D,
    clip_duration=_D, candidate=_S, unmatched_reason=_S, corrected=_B, original_callsign=_S, via_alias=_B, late=_B, source=_S,
    escalated=_B, escalation_pending=_B, position=_S, traffic=_S, traffic_cleared=_B, suggested_callsign=_S, suggestion_score=_D,
)
RECORD = T.StructType([T.StructField("type", _S), *TRANSMISSION.fields])
CORRECTION = _struct(timestamp=_S, entry_id=_L, candidate=_S, from_callsign=_S, to_callsign=_S, raw_text=_S, confidence=_D, clip_duration=_D)
#: Keys a correction line must have, null or not.
CORRECTION_KEYS = ("timestamp", "entry_id", "candidate", "from_callsign", "to_callsign", "raw_text")
PROFILE = _struct(centroid=T.ArrayType(_D), count=_L, samples=T.ArrayType(T.ArrayType(_D)))
