"""Table schemas, built without a session so that modules can be imported anywhere."""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<int>": T.ArrayType(T.IntegerType())}


def schema(text: str) -> T.StructType:
    """A StructType of "name kind, name kind"."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (part.split() for part in text.split(","))])


RELEASE = schema("audio_id string, text string, channel string, duration double, n_samples long, tokens array<int>, encoder string, sampling_rate int")
TOKEN_STORE = schema("audio_id string, tokens array<int>, n_samples long, duration double, text string, channel string, expected_frames long")
HYPOTHESIS = schema("audio_id string, text string, error string")
SIGNALS = schema("audio_id string, duration double, channel string, n_frames int, mel_l1 double, si_sdr double, speaker_sim double")
PREPARED = schema("input_ids array<int>, speech_start_idx int, length int, audio_id string, reject string")
EVAL_ROWS = schema("idx int, category string, model string, seed int, text string, phones string, n_phone_tokens int, n_codes int, duration_s double, hit_eos boolean, at_min_floor boolean, at_max_tokens boolean, rate_ratio double, duration_verdict string, unique_ratio double, repeat_frac double, max_run int, degeneracy_verdict string, wav string")
