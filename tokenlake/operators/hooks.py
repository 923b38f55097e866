"""Interfaces of model-backed operators, with deterministic stubs. A stub's output is no model's result.

A hook is made once per worker by a factory and called on batches, so a model is loaded once and need not pickle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.functions.arrays import DECODE_RATE, FRAME_RATE, HOP, VOCABULARY
from tokenlake.operators.sampling import exact_length_batches


def stub_encoder() -> Callable[[np.ndarray], np.ndarray]:
    """Batch of equal-length clips [B, T] to codes [B, max(1, T // HOP)]: a hash of each frame's samples."""

    def encode(batch: np.ndarray) -> np.ndarray:
        frames = max(1, batch.shape[1] // HOP)
        return np.array([[int.from_bytes(hashlib.md5(np.round(x[f * HOP : (f + 1) * HOP], 6).tobytes()).digest()[:2], "big") % VOCABULARY for f in range(frames)] for x in batch], dtype=np.int32)

    return encode


def stub_decoder() -> Callable[[list[int]], np.ndarray]:
    """Codes to a waveform at DECODE_RATE: one sine per frame."""

    def decode(codes: list[int]) -> np.ndarray:
        per = DECODE_RATE // FRAME_RATE
        t = np.arange(per) / DECODE_RATE
        return np.concatenate([0.3 * np.sin(2 * np.pi * (100 + c % 4000) * t) for c in codes]) if len(codes) else np.empty(0)

    return decode


def encode(clips: DataFrame, factory: Callable = stub_encoder, *, max_batch: int = 8, samples: str = "samples") -> DataFrame:
    """clips (audio_id, n_samples, samples) with tokens. A batch holds clips of one length only; nothing is padded."""
    batched = exact_length_batches(clips, max_batch)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = factory()(np.stack(pdf[samples].to_list()))
        return pd.DataFrame({"audio_id": pdf["audio_id"], "n_samples": pdf["n_samples"], "tokens": [c.tolist() for c in codes]})

    return batched.groupBy("n_samples", "batch").applyInPandas(run, "audio_id string, n_samples long, tokens array<int>")


def decode(rows: DataFrame, factory: Callable = stub_decoder) -> DataFrame:
    """rows (audio_id, tokens) with the decoded samples at DECODE_RATE."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = factory()
        for pdf in batches:
            yield pd.DataFrame({"audio_id": pdf["audio_id"], "samples": [one(list(t)).tolist() for t in pdf["tokens"]]})

    return rows.select("audio_id", "tokens").mapInPandas(run, "audio_id string, samples array<double>")


def said(result) -> str:
    """The text of what a recogniser returns: a string, an object or a dict with `text`, or a list of these joined by spaces."""
    if isinstance(result, str):
        return " ".join(result.split())
    if isinstance(result, list | tuple):
        return " ".join(filter(None, map(said, result)))
    text = result.get("text") if isinstance(result, dict) else getattr(result, "text", None)
    if text is None:
        raise TypeError(f"no text in a {type(result).__name__}")
    return " ".join(str(text).split())


def latents(clips: DataFrame, factory: Callable, samples: str = "samples") -> DataFrame:
    """audio_id, latents ([D][F], before quantisation) of single clips; the factory's function takes a 1-D array, gives a 2-D one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = factory()
        for pdf in batches:
            yield pd.DataFrame({"audio_id": pdf["audio_id"], "latents": [np.asarray(one(np.asarray(x, dtype=np.float64))).tolist() for x in pdf[samples]]})

    return clips.select("audio_id", samples).mapInPandas(run, "audio_id string, latents array<array<double>>")


def intrusive_metrics(pairs: DataFrame, factories: dict[str, Callable], reference: str = "reference", estimate: str = "estimate") -> DataFrame:
    """audio_id and a column per metric, such as PESQ or STOI: null where its library is absent or fails on the clip."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have = {}
        for name, factory in factories.items():
            try:
                have[name] = factory()
            except ImportError:
                have[name] = None

        def value(one, r, e):
            try:
                return float(one(np.asarray(r), np.asarray(e))) if one is not None else None
            except Exception:  # a metric that refuses a clip is no failure of the run
                return None

        for pdf in batches:
            out = {"audio_id": pdf["audio_id"]}
            for name, one in have.items():
                out[name] = pd.Series([value(one, r, e) for r, e in zip(pdf[reference], pdf[estimate], strict=True)], dtype="float64")
            yield pd.DataFrame(out)

    return pairs.select("audio_id", reference, estimate).mapInPandas(run, "audio_id string, " + ", ".join(f"`{n}` double" for n in factories))


def transcribe(rows: DataFrame, factory: Callable, samples: str = "samples") -> DataFrame:
    """audio_id, text, error. A clip that fails has an empty text and its error, and counts as done."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = factory()
        for pdf in batches:
            out = []
            for audio_id, x in zip(pdf["audio_id"], pdf[samples], strict=True):
                try:
                    out.append((audio_id, said(one(x)), None))
                except Exception as e:  # one bad clip must not end the run
                    out.append((audio_id, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["audio_id", "text", "error"])

    return rows.select("audio_id", samples).mapInPandas(run, "audio_id string, text string, error string")


def preprocess(clips: DataFrame, samples: str = "samples") -> DataFrame:
    """Mono samples to n_samples and expected_frames; the samples stay, nothing is padded."""
    return clips.withColumn("n_samples", F.size(samples).cast("long")).withColumn("expected_frames", F.greatest(F.lit(1), F.floor(F.col("n_samples") / HOP)).cast("long"))


def downmix(channels: str = "channels"):
    """The mean over channels of an array of equal-length arrays."""
    return F.expr(f"transform({channels}[0], (x, i) -> aggregate({channels}, 0D, (s, c) -> s + c[i]) / size({channels}))")

