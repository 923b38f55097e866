"""Configuration, JSON, manifest and reports."""

import json

import pytest

from tokenlake.operators import sampling
from tokenlake.sources import reports


def test_json_keeps_letters(tmp_path):
    reports.write_json({"a": "واخا", "n": [1, None]}, tmp_path / "x" / "y.json")
    text = (tmp_path / "x" / "y.json").read_text(encoding="utf-8")
    assert "واخا" in text and json.loads(text) == {"a": "واخا", "n": [1, None]}


def test_config(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("seed: 42\nladder: [1, 2]\n")
    assert reports.load_config(tmp_path / "c.yaml") == {"seed": 42, "ladder": [1, 2]}


def test_report_and_html():
    row = {"verdict": "EXPAND", "n_clips": 3, "wer_orig": 1, "wer_recon": 6.5, "delta_wer": 5.5, "cer_orig": 2, "cer_recon": 1, "delta_cer": -1, "lo": 4.0, "hi": 6.0}
    text = reports.audit_report(row)
    assert "EXPAND" in text and "across 5.0" in text and "| WER | 1.00 | 6.50 | +5.50 |" in text and "-1.00" in text
    page = reports.table_html("a<b", [{"t": "<x>", "wav": 'a".wav'}], audio="wav")
    assert "&lt;x&gt;" in page and "a&lt;b" in page and 'src="a&quot;.wav"' in page
    assert reports.table_html("none", [])


def test_manifest(spark):
    df = spark.createDataFrame([(f"c{i}", 1.0 + i % 9, f"ch{i % 2}") for i in range(40)], "audio_id string, duration double, channel string")
    sample = sampling.audit_sample(df, 10)
    got = reports.audit_manifest(sample, 42)
    order = [r.audio_id for r in sampling.stratified_order(df).orderBy("rank").limit(10).collect()]
    assert got["audio_ids"] == order and sum(got["stratum_counts"].values()) == got["n_sampled"] == 10
    one = reports.dropped_record(df.where("duration > 8"), "null or blank text").first()
    assert one.n_dropped == len(one.audio_ids) and one.audio_ids == sorted(one.audio_ids)
